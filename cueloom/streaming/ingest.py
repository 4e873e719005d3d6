"""Streaming ingest of caption files: new files of a folder become cues, faulty ones rejects, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cueloom.sources.captions import read_contents


def ingest(spark: SparkSession, folder: str, cues: str, rejects: str, checkpoint: str, glob: str = "*.{srt,vtt,ass,ssa,json,json3}") -> StreamingQuery:
    """Reads what is new in ``folder``, appends to the Parquet tables ``cues`` and ``rejects`` and stops.

    Both tables carry ``batch``. A batch that is run again after a failure first replaces its own partition, so rows come
    once.
    """

    def write(files: DataFrame, batch: int) -> None:
        scan, _ = read_contents(files.select("path", "content"))
        for rows, path in ((scan.cues, cues), (scan.rejects, rejects)):
            rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
