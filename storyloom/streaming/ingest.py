"""Works as they arrive: a file stream through the segmenter, each micro-batch written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyloom.config import ChunkConfig
from storyloom.functions.text import normalize_text
from storyloom.operators.segment import segment


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Parquet files of (work_id, text) that land in `source` become chapters, scenes and chunks below `target`.

    A batch writes to folders of its own number, over what an earlier attempt at it left, so a batch that is run
    again after a failure leaves its rows once."""

    def write(batch: DataFrame, number: int) -> None:
        works = batch.select("work_id", normalize_text(F.col("text")).alias("text")).dropDuplicates(["work_id"])
        for name, rows in segment(works, "work_id", config).items():
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    stream = spark.readStream.schema("work_id long, text string").parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated_candidates(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A candidate stream (motif_id, work_id, start, end, ts) with each span once while the watermark lasts."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["work_id", "motif_id", "start", "end"])
