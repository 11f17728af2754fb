"""Counts of each micro-batch in a side table: rows read, and rows that came too late for the watermark."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = "run_id string, batch bigint, n_rows bigint, n_late bigint, watermark string"


class BatchCounts(StreamingQueryListener):
    """Writes a row per batch of the queries that it is told to `follow`. Late rows are those that stateful operators
    dropped; Spark counts them where it drops them, so nothing is read twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.followed = spark, path, set()

    def follow(self, name: str) -> None:
        """Count for the query of this name from now on."""
        self.followed.add(name)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name not in self.followed:
            return
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if not p.numInputRows and not late:
            return
        row = (str(p.runId), p.batchId, p.numInputRows, late, p.eventTime.get("watermark") if p.eventTime else None)
        self.spark.createDataFrame([row], COUNTS).coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts; a batch that ran again has its last row."""
    return spark.read.schema(COUNTS).json(path).dropDuplicates(["run_id", "batch"])
