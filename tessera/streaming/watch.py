"""Change events as a stream: which count, how bursts coalesce, and a run per burst."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.paths import skipped
from tessera.sources.vault import Projection

KINDS = ("created", "modified", "deleted", "moved")


def relevant_events(events: DataFrame, ignored_dirs: Sequence[str] = (), ignored_globs: Sequence[str] = ()) -> DataFrame:
    """(ts, path) of changes to documents: a move touches both its ends; folders and reads are left out."""
    moved = F.when(F.col("event_type") == "moved", F.col("dest_path"))
    ends = events.where(F.col("event_type").isin(*KINDS) & ~F.coalesce("is_directory", F.lit(False)))
    paths = ends.select("ts", F.explode(F.array_compact(F.array("path", moved))).alias("path"))
    return paths.where(F.col("path").endswith(".md") & ~skipped(F.col("path"), ignored_dirs, ignored_globs))


def bursts(events: DataFrame, gap: str = "2 seconds", keys: Sequence[str] = (), late: str | None = "1 minute") -> DataFrame:
    """Sessions of events less than `gap` apart: start, end, n_events, and the paths if there are any."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    aggregates = [F.count(F.lit(1)).alias("n_events")]
    if "path" in events.columns:
        aggregates.append(F.array_sort(F.collect_set("path")).alias("paths"))
    # a stream needs a key beside its sessions; a constant one makes them sessions of all events
    grouping = list(keys) or [(F.unix_micros("ts") * 0).alias("all")]
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *grouping).agg(*aggregates)
    return out.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *[c for c in ("n_events", "paths") if c in out.columns])


def watch(events: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Calls run(changed paths, batch id) for each batch of finished bursts; runs never overlap.

    An error leaves the batch uncommitted, so the next start repeats it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(F.explode("paths").alias("path")).distinct()
        if changed.limit(1).count():
            run(changed, batch_id)

    writer = bursts(relevant_events(events), gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def may_start(chunks: DataFrame, vectors: DataFrame, most_missing: int = 200) -> bool:
    """Whether a watcher may start: not with more chunks without vectors than it should embed at once."""
    return chunks.join(vectors, "chunk_id", "left_anti").limit(most_missing + 1).count() <= most_missing


def refusal(projection: Projection, most_missing: int = 200) -> str:
    """Why a watcher may not start on a projection, or "": there is none, it was never filled, or too many vectors are missing."""
    state = projection.manifest()
    if not state:
        return "no projection"
    if not {"documents", "chunks", "vectors"} <= set(state.get("tables", {})):
        return "the projection was never filled"
    if not may_start(projection.read("chunks"), projection.read("vectors"), most_missing):
        return f"more than {most_missing} chunks lack vectors"
    return ""


class Watcher:
    """A stream of changes and its states: idle, starting, then running or refused; stopped, or failed with the error.

    A refused, stopped or failed watcher may be started again; the checkpoint tells where it goes on.
    """

    def __init__(self, projection: Projection, events: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "2 seconds") -> None:
        self.projection, self.events, self.run, self.checkpoint, self.gap = projection, events, run, checkpoint, gap
        self.reason = ""
        self._state = "idle"
        self._query: StreamingQuery | None = None

    @property
    def state(self) -> str:
        """What the stream says, if it has ended by itself."""
        if self._state == "running" and self._query is not None and not self._query.isActive:
            error = self._query.exception()
            self._state, self.reason = ("failed", str(error)[:4000]) if error else ("stopped", "")
        return self._state

    def start(self, once: bool = False) -> str:
        if self.state == "running":
            return self._state
        self._state, self.reason = "starting", refusal(self.projection)
        if self.reason:
            self._state = "refused"
            return self._state
        try:
            self._query = watch(self.events, self.run, self.checkpoint, self.gap, once)
            self._state = "running"
        except Exception as e:  # noqa: BLE001
            self._state, self.reason = "failed", f"{type(e).__name__}: {str(e)[:400]}"
        return self._state

    def stop(self) -> str:
        if self.state == "running":
            self._query.stop()
            self._state = "stopped"
        return self._state

    def status(self) -> dict:
        """The state, its reason, and the progress of the stream if there is one."""
        progress = self._query.lastProgress if self._query is not None else None
        return {"state": self.state, "reason": self.reason, "batches": progress["batchId"] + 1 if progress else 0}
