"""What turns texts to vectors: its protocol, bounded batches, and the table of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Batch sizes and threads of resource profiles.
RESOURCE_PROFILES = {"low": (4, 1), "balanced": (16, 2), "performance": (64, 4)}
#: Growth of a process in one batch beyond which later batches are halved.
GROWTH = 1.25


class Embedder(Protocol):
    """Unit vectors of texts. It must be picklable: tasks run it, and may build their model on first use."""

    model: str
    dimension: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Signed hashes of words and their trigrams, normalised; it needs no model file and is the same everywhere."""

    dimension: int = 384
    model: str = "hash-v1"

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                for part in {word, *(word[k : k + 3] for k in range(max(0, len(word) - 2)))}:
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class OverBudget(RuntimeError):
    """A batch would begin beyond the memory that was granted."""


@dataclass
class BatchController:
    """How many texts the next batch takes: none are begun over the budget or under the floor, and growth halves what follows.

    measure: (MB that the process holds, MB that are free), either None if unknown.
    """

    measure: Callable[[], tuple[float | None, float | None]]
    size: int = RESOURCE_PROFILES["balanced"][0]
    least: int = 1
    budget_mb: float | None = None
    floor_mb: float = 0.0
    _held: float | None = field(default=None, init=False)

    def admit(self, remaining: int) -> int:
        if remaining < 1:
            return 0
        held, free = self.measure()
        if held is not None and self.budget_mb is not None and held > self.budget_mb:
            raise OverBudget(f"the process holds {held:.0f} MB of {self.budget_mb:.0f}")
        if free is not None and free < self.floor_mb:
            raise OverBudget(f"{free:.0f} MB are free, fewer than {self.floor_mb:.0f}")
        self._held = held
        return min(remaining, self.size)

    def done(self) -> None:
        before, (self._held, _) = self._held, self.measure()
        if before is not None and self._held is not None and self._held > GROWTH * before:
            self.size = max(self.least, self.size // 2)


def process_memory() -> tuple[float | None, float | None]:
    """MB that this process holds, and MB that the machine has free; None where the system doesn't tell."""
    try:
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * 4096 / 1e6
        with open("/proc/meminfo") as f:
            free = next(int(line.split()[1]) / 1e3 for line in f if line.startswith("MemAvailable"))
    except (OSError, StopIteration, ValueError):
        return None, None
    return held, free


def embed_rows(inputs: DataFrame, embedder: Embedder, profile: str = "balanced", budget_mb: float | None = None, floor_mb: float = 0.0) -> DataFrame:
    """(chunk_id, embedding, model) of inputs (chunk_id, input), in batches that a controller of each task admits.

    A vector of another length than the embedder's dimension is an error. A task that is refused fails and is tried again
    elsewhere. Null inputs are left out.
    """
    size = RESOURCE_PROFILES[profile][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        control = BatchController(process_memory, size, budget_mb=budget_mb, floor_mb=floor_mb)
        for batch in batches:
            at = 0
            while n := control.admit(batch.num_rows - at):
                got = np.asarray(embedder.embed(batch.column(1).slice(at, n).to_pylist()), np.float32)
                if got.shape != (n, embedder.dimension):
                    raise ValueError(f"vectors of shape {got.shape}, not {(n, embedder.dimension)}")
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * embedder.dimension, pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), lists, pa.array([embedder.model] * n)], names=["chunk_id", "embedding", "model"])
                control.done()
                at += n

    rows = inputs.where("input is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "input")
    return rows.mapInArrow(run, "chunk_id long, embedding array<float>, model string")


def upsert_vectors(vectors: DataFrame, fresh: DataFrame, dimension: int) -> DataFrame:
    """vectors with those of `fresh` replaced or added. A vector of another length fails the job when it is written."""
    checked = fresh.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector isn't of length {dimension}"))))
    return vectors.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(checked)
