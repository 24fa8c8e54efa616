"""A log that runs write: progress of streams by a listener, and counts that batch jobs observe, one JSON event each."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

_EVENT = "event_type string, origin struct<update_id:string,batch_id:bigint>, at string, details string"


def _expectations(dataset: str, counts: dict[str, int]) -> list[dict]:
    """Counts of ``audits.expect`` (rows, and failures by rule) as expectations; rows alone give none."""
    rows = counts.get("rows", 0)
    return [{"name": k, "dataset": dataset, "passed": rows - v, "failed": v} for k, v in counts.items() if k != "rows"]


class RunLog(StreamingQueryListener):
    """Writes an event file to ``path`` for each micro-batch of any stream of the session, and for each batch job told to it.

    Used as a context, it listens while the context lasts. An event that is written again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._ended, self._failed = spark, path, {}, []

    def __enter__(self) -> RunLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def _append(self, update_id: str, batch_id: int, at: str, details: dict) -> None:
        event = {"event_type": "flow_progress", "origin": {"update_id": update_id, "batch_id": batch_id}, "at": at, "details": json.dumps(details)}
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{update_id}-{batch_id}.json")
        out = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytearray((json.dumps(event) + "\n").encode()))
        out.close()

    def _end_of(self, run_id: str) -> threading.Event:
        return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        try:
            observed = {name: row.asDict() for name, row in p.observedMetrics.items()}
            details = {
                "input_rows": p.numInputRows,
                "dropped_by_watermark": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
                "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
                "watermark": p.eventTime.get("watermark"),
                "observed": {f"{n}.{k}": v for n, row in observed.items() for k, v in row.items()},
                "expectations": [e for n, row in observed.items() for e in _expectations(n, row)],
            }
            self._append(p.name or str(p.runId), p.batchId, p.timestamp, details)
        except Exception as e:  # the listener's thread would swallow it
            self._failed.append(e)

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def finish(self, query: StreamingQuery, seconds: float = 600) -> None:
        """Waits until a stream has ended and all its events are written; raises what went wrong in either."""
        query.awaitTermination()
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of {query.runId} was heard of")
        if self._failed:
            raise self._failed[0]

    def batch(self, update_id: str, dataset: str, counts: dict[str, int], batch_id: int = 0) -> None:
        """Counts of one batch job, as ``Observation.get`` gives them."""
        details = {"input_rows": counts.get("rows", 0), "dropped_by_watermark": 0, "observed": {f"{dataset}.{k}": v for k, v in counts.items()}, "expectations": _expectations(dataset, counts)}
        self._append(update_id, batch_id, "", details)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log, for ``audits.parse_run_log`` and ``progress``."""
    return spark.read.schema(_EVENT).json(path)


def progress(events: DataFrame) -> DataFrame:
    """(update_id, batches, input_rows, dropped_by_watermark, observed map) of each run; a metric observed in several batches adds up."""
    details = F.from_json("details", "input_rows bigint, dropped_by_watermark bigint, observed map<string,bigint>")
    rows = events.select("origin.update_id", "origin.batch_id", details.alias("d")).select("update_id", "batch_id", "d.*")
    totals = rows.groupBy("update_id").agg(F.count("*").alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum("dropped_by_watermark").alias("dropped_by_watermark"))
    seen = rows.select("update_id", F.explode("observed").alias("k", "v")).groupBy("update_id", "k").agg(F.sum("v").alias("v"))
    seen = seen.groupBy("update_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("observed"))
    return totals.join(seen, "update_id", "left")
