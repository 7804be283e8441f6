"""The bounded queue over a stream: the k best elements so far, kept as a small table that each micro-batch merges into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankwell.sources.shared import new_path


class StreamingTopK:
    """`answer()` is the top k of all elements that have arrived.

    Each micro-batch writes the merged k rows under its own number below the shared folder, so a batch that is run again
    after a failure starts from the state before it and changes nothing.
    """

    def __init__(self, spark: SparkSession, schema: str, k: int, path: str | None = None):
        self.spark, self.schema, self.k = spark, schema, k
        self.path = path or new_path(spark, "stream")
        self.last = -1

    def _state(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/state-{batch}")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take a micro-batch of (element_id, score) in; rows without a score count for nothing."""
        both = self._state(number - 1).unionByName(batch.filter("score is not null").select("element_id", "score"))
        top = both.dropDuplicates(["element_id"]).orderBy(F.desc("score"), F.asc("element_id")).limit(self.k)
        top.write.mode("overwrite").parquet(f"{self.path}/state-{number}")
        self.last = number

    def start(self, elements: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        """Follow a streaming frame of (element_id, score), each element once."""
        return elements.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint or new_path(self.spark, "checkpoint")).start()

    def answer(self) -> DataFrame:
        return self._state(self.last).orderBy(F.desc("score"), F.asc("element_id"))
