"""Importing the query modules fills the registry."""

from . import q_ingest  # noqa: F401
from . import q_landing  # noqa: F401
from . import q_insight  # noqa: F401
from . import q_warehouse  # noqa: F401
from . import q_profile  # noqa: F401
from . import q_text  # noqa: F401
from . import q_ml  # noqa: F401
from . import q_stream  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
