"""Drop-folder ingestion: new text recordings become channel and sample rows, file by file, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paddock.sources import vbo


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append what arrives in ``folder`` to ``target``/channels, /samples and /diagnostics, then stop when all is read.

    Each batch writes below its own number and overwrites it, so a batch that is run again leaves no
    doubles. A recording is complete when its file is there; there is no late data.
    """

    def batch(files: DataFrame, number: int) -> None:
        for name, table in zip(("channels", "samples", "diagnostics"), vbo.parse(files)):
            table.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[vV][bB][oO]").load(folder)
    files = source.select(F.col("path").alias("recording_id"), text.alias("text"))
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
