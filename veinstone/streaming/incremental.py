"""Documents as they arrive: the flag-driven batches of the work lists as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veinstone.operators.keywords import hits, positions


def stream_hits(spark: SparkSession, source: str, schema: StructType, terms: DataFrame, out: str, state: str) -> StreamingQuery:
    """Appends the keyword hits of new files below ``source`` to ``out``, each batch in a folder of its own number, so a batch that runs again replaces itself.

    ``state`` is the stream's checkpoint; what has been seen is not read again.
    """

    def batch(df: DataFrame, number: int) -> None:
        hits(positions(df, terms)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
