"""Grounding on streams: a stream-static join with everything else inside the row.

Windows over a query's candidates are not possible on a stream, so each micro-batch is grounded as a batch
(ground_batches), with exactly-once semantics by the sink's batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grounding import Grounder


def ground_batches(stream: DataFrame, grounder: Grounder, path: str, checkpoint: str, column: str = "raw", **options) -> StreamingQuery:
    """Write each micro-batch's rows with their best CURIE under path/batch=<id>; a repeated batch overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        grounder.ground_column(batch, column, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookup_stream(stream: DataFrame, grounder: Grounder, column: str = "raw") -> DataFrame:
    """The stateless part as a streaming plan: each row with the entries that its variants find."""
    from ..functions import text

    keys = stream.withColumn("norm_text", F.explode(text.lookups(column)))
    return keys.join(grounder.terms, "norm_text")
