"""Resumable runs: results are appended by batch, each batch once whatever is repeated or interrupted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfspark.session import list_folders, read_finished
from shelfspark.sources.ingest import pending


def appended(spark: SparkSession, path: str, schema: StructType | str, without: int | None = None) -> DataFrame:
    """All rows of finished batches below ``path``, with the number of their ``batch``; one that was interrupted counts as none."""
    kind = spark.createDataFrame([], schema).schema
    out = spark.createDataFrame([], kind).withColumn("batch", F.lit(0).cast("long"))
    for name in list_folders(spark, path):
        number = int(name.removeprefix("batch-")) if name.startswith("batch-") else None
        if number is None or number == without:
            continue
        part = read_finished(spark, f"{path}/{name}", kind)
        if part is not None:
            out = out.unionByName(part.withColumn("batch", F.lit(number).cast("long")))
    return out


def append_pending(source: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame], schema: StructType | str, batch: int) -> int:
    """Do ``work`` on the rows of ``source`` whose ``keys`` no other finished batch below ``path`` holds, and write the result as ``batch``.

    ``work`` keeps ``keys`` in its result, of ``schema``. A batch is a folder
    that is written as a whole: done again, it takes the place of what the first
    try left; a try that was cut off leaves nothing that ``appended`` reads. So
    each key is done once, and a run that was stopped goes on with the rest.
    Returns the rows written. Rows with null keys are done in every batch.
    """
    spark = source.sparkSession
    rest = pending(source, appended(spark, path, schema, batch), keys)
    kind = spark.createDataFrame([], schema).schema
    here = f"{path}/batch-{batch:08d}"
    work(rest).select(*[F.col(f.name).cast(f.dataType) for f in kind]).write.mode("overwrite").parquet(here)
    return spark.read.schema(kind).parquet(here).count()


def append_stream(source: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame], schema: StructType | str, checkpoint: str) -> StreamingQuery:
    """append_pending on whatever is new in the streaming ``source``; ends when all that is there now is done.

    The stream's checkpoint says which files were read; a micro-batch that is
    repeated after a failure writes the same folder again.
    """

    def one(rows: DataFrame, number: int) -> None:
        append_pending(rows, path, keys, work, schema, number)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
