"""Results of a stream as files, which no driver has to hold."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session takes a temporary one and a cluster is refused."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/glyphsieve-{tag}-{uuid.uuid4().hex}"


def run_to_files(stream: DataFrame, mode: str, out: str | None = None) -> DataFrame:
    """Run a stream until it has read all that is there, and read its result back: in complete mode the last batch's, else all batches'.
    A run with the folder of one before goes on from there."""
    spark, out = stream.sparkSession, out or scratch_folder(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:  # a batch that is run again writes the same folder again
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)


def run_in_parts(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The result of a stream, made by make from its input, that is run once for each part of a table, in order: rows of later parts arrive later."""
    spark = parts[0].sparkSession
    rows, out = scratch_folder(spark, "parts"), scratch_folder(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(rows)
        found = run_to_files(make(spark.readStream.schema(parts[0].schema).parquet(rows)), mode, out)
    return found
