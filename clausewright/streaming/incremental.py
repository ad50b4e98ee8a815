"""Incremental ingest: chunk files as a stream, prompted once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import providers
from ..operators import chunks as C
from ..sources.files import exists


def chunk_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def extract_stream(stream: DataFrame, provider, model: str, cache: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch asks only what the cache table lacks and appends the raw answers;
    prompts are found by content hash, so a batch run again adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        held = spark.read.parquet(cache) if exists(spark, cache) else None
        prompts = C.prompts(df).dropDuplicates(["prompt"])
        providers.raw_responses(prompts, provider, model, held).write.mode("append").parquet(cache)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
