"""De-duplicated append with bounded state, and an audit of what the watermark discards.

``dropDuplicatesWithinWatermark`` keeps a key only until the watermark has passed its event time
by the delay, so its state is bounded by the delay and not by the table; the price is that rows
at or before the watermark (that of the batch before, in Spark) are discarded unseen. Here none is discarded uncounted: the plan
observes every batch's rows as they arrive, the operator reports the rows that it dropped as late,
and the sink has the rows that were kept, so for every batch

    n_arrived = n_untimed + n_late + n_duplicates + n_kept

A batch's rows and its audit row are written under its batch id and replaced as a whole when the
batch is replayed. For an exact result whatever the disorder, use ``parts.insert_new_sink``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.timefn import ntz_to_instant
from ..session import scratch_path
from .stream import BATCH, file_stream

_TS = "_vm_ts"
AUDIT = f"{BATCH} long, n_arrived long, n_untimed long, n_late long, n_duplicates long, n_kept long, watermark string"


def _once_per_batch(query, seen: dict[int, dict]) -> None:
    """Progress of the batches so far; a batch that came and went unseen is an error, not a gap in the audit."""
    for p in query.recentProgress:
        if p["batchId"] not in seen or p["numInputRows"]:
            seen[p["batchId"]] = p
    if seen and len(seen) != max(seen) - min(seen) + 1:
        raise RuntimeError("progress of a batch was overwritten: raise spark.sql.streaming.numRecentProgressUpdates")


def stream_within_watermark(spark: SparkSession, source: str, schema: StructType, root: str, keys: Sequence[str],
                            ts: str, delay: str, checkpoint: str | None = None,
                            files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Process the landed files that are there: (rows kept, audit by batch).

    Of rows with equal keys whose event times lie within ``delay`` the first batch's is kept.
    Rows without an event time are counted and not kept. The audit has one row for each batch
    that had input."""
    rows_path, audit_path = f"{root}/rows", f"{root}/audit"
    ck = checkpoint or scratch_path(spark, "ckpt-late")
    src = file_stream(spark, source, schema, files_per_trigger)
    time = ntz_to_instant(ts) if dict(src.dtypes)[ts] == "timestamp_ntz" else F.col(ts).cast("timestamp")
    arrived = (src.withColumn(_TS, time)
               .observe("arrived", F.count(F.lit(1)).alias("n"), F.count_if(F.col(_TS).isNull()).alias("untimed")))
    kept = (arrived.where(F.col(_TS).isNotNull()).withWatermark(_TS, delay)
            .dropDuplicatesWithinWatermark(list(keys)).drop(_TS)
            .observe("kept", F.count(F.lit(1)).alias("n")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(rows_path))

    query = (kept.writeStream.foreachBatch(sink).option("checkpointLocation", ck).trigger(availableNow=True).start())
    seen: dict[int, dict] = {}
    while not query.awaitTermination(2):
        _once_per_batch(query, seen)
    _once_per_batch(query, seen)

    audit = []
    for number, p in sorted(seen.items()):
        if not p["numInputRows"]:
            continue
        n, untimed, out = (p["observedMetrics"][o][c] for o, c in (("arrived", "n"), ("arrived", "untimed"), ("kept", "n")))
        late = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
        audit.append((number, n, untimed, late, n - untimed - late - out, out, p["eventTime"].get("watermark")))
    (spark.createDataFrame(audit, AUDIT).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(audit_path))
    fields = StructType([*schema.fields]).add(BATCH, "long")
    audited = spark.read.schema("n_arrived long, n_untimed long, n_late long, n_duplicates long, n_kept long, "
                                f"watermark string, {BATCH} long").parquet(audit_path)
    return spark.read.schema(fields).parquet(rows_path).drop(BATCH), audited.withColumnRenamed(BATCH, "batch_id")
