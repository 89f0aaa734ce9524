"""Progress of ingest streams as rows: what passed in each micro-batch, and how much of the whole that makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from tessella.operators.versions import VersionedTable

ROWS = "stream string, run string, batch long, chunks long, seconds long, stage string"


def observed_stream(chunks: DataFrame, name: str) -> DataFrame:
    """``chunks(length)`` with an observation: how many pass in a micro-batch, and of how many seconds."""
    return chunks.observe(name, F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("seconds"))


def progress_table(spark: SparkSession, path: str) -> VersionedTable:
    """Rows of micro-batches; one that is run again after a failure replaces its row."""
    return VersionedTable(spark, path, T._parse_datatype_string(ROWS), ["stream", "run", "batch"])


class ProgressListener(StreamingQueryListener):
    """Keeps a row a micro-batch that had an observation called ``name``, until ``flush`` writes them.

    Only rows that are not written yet are held, one a micro-batch.
    """

    def __init__(self, name: str):
        self.name, self.rows, self.stages = name, [], {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.stages[str(event.runId)] = "started"

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if (seen := p.observedMetrics.get(self.name)) is not None:
            self.stages[str(p.runId)] = "ingesting"
            self.rows.append((self.name, str(p.id), int(p.batchId), int(seen["chunks"]), int(seen["seconds"]), "ingesting"))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.stages[str(event.runId)] = "failed" if event.exception else "finished"

    def flush(self, table: VersionedTable) -> None:
        """Write the rows held; a micro-batch counts once, by its latest row."""
        rows, self.rows = {r[:3]: r for r in self.rows}, []
        if rows:
            table.add(table.spark.createDataFrame(list(rows.values()), ROWS))


def with_percent(progress: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress rows with ``done``, the seconds so far, and ``percent`` of the ``totals(stream, total)``; the last reaches 100."""
    w = W.partitionBy("stream", "run").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    rows = progress.join(totals, "stream").withColumn("done", F.sum("seconds").over(w))
    return rows.select("stream", "run", "batch", "chunks", "seconds", "done", F.when(F.col("total") > 0, F.least(F.lit(100.0), F.col("done") / F.col("total") * 100)).alias("percent"))
