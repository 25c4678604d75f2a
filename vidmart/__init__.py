"""vidmart: a Spark-native video-platform warehouse and popularity-analytics library."""

__version__ = "0.1.0"
