"""Pipeline events folded to counters, in batches or as a stream, and what a stream reports as JSON lines."""

from __future__ import annotations

import json
import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Values above this count as large.
LARGE = 100


def counters(events: DataFrame) -> DataFrame:
    """Per event_type the number of events, of large ones, and totals of value and k; for tables and streams alike.

    Null values count as events but as nothing else; a type whose values are all null has null totals.
    """
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") > LARGE).alias("large"), F.round(F.sum("value"), 4).alias("total"), F.sum("k").cast("long").alias("k_total")
    )


def start_counters(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Folds a stream; each micro-batch writes the counters that it changed, as JSON lines in a folder of its number.

    Counters are running totals, kept in Spark's state store. A batch that is run again overwrites its own folder, so
    that each batch is there once.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").json(f"{path}/batch={batch}")

    return counters(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters as of the last batch that changed them."""
    rows = spark.read.schema("event_type string, events long, large long, total double, k_total long, batch long").json(path)
    newest = Window.partitionBy("event_type").orderBy(F.desc("batch"))
    return rows.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place", "batch")


class JsonLines(StreamingQueryListener):
    """Writes what streams report as JSON lines, one file per event, to a folder that ``spark.read.json`` reads.

    Lines: ``cycle_start`` (query, run), ``cycle_end`` (query, run, batch, rows, milliseconds), and ``error`` or ``stop`` (query, run, message).
    """

    def __init__(self, folder: str):
        local = re.match(r"^\w+:", folder) is None
        self._store, self._base = (fs.LocalFileSystem(), folder) if local else fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", folder))
        self._store.create_dir(self._base)
        self._count = 0

    def _write(self, kind: str, query, run, **more) -> None:
        self._count += 1
        line = json.dumps({"event": kind, "query": str(query), "run": str(run)} | more)
        with self._store.open_output_stream(f"{self._base}/{run}-{self._count:08d}.json", compression=None) as f:
            f.write(f"{line}\n".encode())

    def onQueryStarted(self, event) -> None:
        self._write("cycle_start", event.id, event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write("cycle_end", p.id, p.runId, batch=p.batchId, rows=p.numInputRows, milliseconds=p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write("error" if event.exception else "stop", event.id, event.runId, message=event.exception)
