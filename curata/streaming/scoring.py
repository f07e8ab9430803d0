"""Predictions for rows and files that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*", at_once: int = 1000) -> DataFrame:
    """A stream of path, modificationTime, length and sha256 of the files that come to a folder, at_once a batch. A file's
    bytes are read once, when it arrives."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(folder)
    return found.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))


def into(rows: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] = lambda rows: rows, once: bool = True) -> StreamingQuery:
    """Starts a query that writes score(batch) of each batch of a stream below path, in a folder batch=<number>.

    A batch that is repeated after a failure replaces its folder, so each row is there once, whatever stopped the query and
    however often: restart it with the same path and checkpoint. score gets a plain DataFrame, for example
    `lambda rows: network.predict(rows, fitted, "features")`, whose network goes to the executors by broadcast. once: takes
    what is there now and stops; else it goes on.
    """
    def put(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Progress(StreamingQueryListener):
    """Gives tell one record per finished batch: query, batch, rows, and rows a second."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
