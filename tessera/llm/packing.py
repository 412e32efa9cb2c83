"""Lexical retrieval packing: windows filled with a seed document and its unused BM25 neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal, written
from tessera.llm.tokens import CACHE_PIECES, encoder

#: Documents of one shard of the index, by the mean.
SHARD_DOCS = 1500
#: Dimensions of the content vectors that deal documents to shards, and vectors of a shard that fit the tree.
CONTENT, PER_SHARD = 64, 64
#: Parts of the content tree at most, so that what fits it stays bounded (67 MB); beyond it a part is several shards.
MOST_PARTS = 4096
#: A term that more than this share of a shard's documents hold is scored for all of them in one matrix product.
DENSE = 1 / 16
#: Token ids whose content vectors are summed at a time.
SLICE_IDS = 1 << 18
#: Bytes of text and cached pieces of a task that shall be small: more work in less memory.
SMALL = (2 << 20, 150_000)
K1, B = 1.2, 0.75
CODED = "row_key long, spread long, doc_id long, n_tokens long, ids binary, full_crcs binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose value i is the bytes of values[bounds[i]:bounds[i + 1]]."""
    at = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _encode(path: str, end_id: int, window: int, small: bool):
    """Per document: its number of ids, the ids, and the checksums of the windows it fills alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        size, enc.most = SMALL if small else (None, CACHE_PIECES)
        for batch in batches:
            for at, ids, bounds in enc.slices(batch.column(3), size):
                n = len(bounds) - 1
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(n + 1)
                sizes = np.diff(bounds)
                whole = sizes // window
                first = np.repeat(bounds[:-1] - (np.cumsum(whole) - whole) * window, whole) + np.arange(whole.sum()) * window
                wide = memoryview(ids.astype("<u4")).cast("B")
                crcs = np.array([zlib.crc32(wide[4 * i : 4 * (i + window)]) for i in first.tolist()], "<u4")
                full = _binaries(crcs, np.concatenate([[0], np.cumsum(whole)]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, n) for k in range(3)), pa.array(sizes), _binaries(ids.astype(enc.kind), bounds), full],
                    names=["row_key", "spread", "doc_id", "n_tokens", "ids", "full_crcs"],
                )

    return frugal(run)


def _frequencies(kind: str):
    """Partial document frequencies: one row per task and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, here = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
        for batch in batches:
            for x in batch.column(0):
                ids = np.frombuffer(x.as_py(), kind)
                if len(ids) and (most := int(ids.max())) >= len(df):
                    more = most + 1 - len(df)
                    df, here = np.append(df, np.zeros(more, np.int64)), np.append(here, np.zeros(more, bool))
                here[ids] = True
                terms = np.flatnonzero(here)
                df[terms] += 1
                here[terms] = False
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df[terms])], names=["term", "df"])

    return run


def sketch_of(idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coordinate that each id falls in, and its signed weight there: a sketch that keeps dot products of documents."""
    r = np.random.default_rng(11)
    return r.integers(0, CONTENT, len(idf)), (r.integers(0, 2, len(idf)) * 2 - 1) * idf


def content_vectors(column: pa.Array, kind: str, sketch: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A unit vector per document: the sketch of its ids, each weighing its inverse document frequency."""
    out = np.zeros((len(column), CONTENT))
    for i, x in enumerate(column):
        ids = np.frombuffer(x.as_py(), kind)
        for a in range(0, len(ids), SLICE_IDS):
            some = ids[a : a + SLICE_IDS]
            out[i] += np.bincount(sketch[0][some], sketch[1][some], minlength=CONTENT)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class ContentTree:
    """Shards by content: a sample's vectors are halved along their widest direction until a shard is left of each part.

    There are MOST_PARTS parts at most. A leaf that holds more than two shards' share of the sample, as equal documents can't
    be halved, is several shards, and so is each leaf if there are more shards than parts; a hash deals among them.
    """

    def __init__(self, sample: np.ndarray, shards: int) -> None:
        each, shards = -(-shards // MOST_PARTS), min(shards, MOST_PARTS)
        self.axis: list[np.ndarray] = []
        self.cut: list[float] = []
        self.child: list[list[int]] = []
        self.parts: list[int] = []
        per_shard = len(sample) / max(1, shards)
        self.root = self._grow(sample, shards, per_shard)
        self.parts = [n * each for n in self.parts]
        self.base = np.concatenate([[0], np.cumsum(self.parts)]).astype(np.int64)

    def _grow(self, x: np.ndarray, shards: int, per_shard: float) -> int:
        """The number of a node, or -1 - leaf."""
        if shards > 1 and len(x) > 1:
            y = x - x.mean(axis=0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1].astype(np.float32)
            p = x @ axis
            cut = float(np.sort(p)[len(p) * (shards // 2) // shards])
            right = p > cut if (p > cut).sum() >= (p < cut).sum() else p >= cut
            if right.any() and not right.all() and np.ptp(p) > 1e-4:
                bound = float((p[~right].max() + p[right].min()) / 2)
                most = min(shards - 1, max(1, round(shards * right.sum() / len(p))))
                at = len(self.axis)
                self.axis.append(axis)
                self.cut.append(bound)
                self.child.append([0, 0])
                self.child[at] = [self._grow(x[~right], shards - most, per_shard), self._grow(x[right], most, per_shard)]
                return at
        share = len(x) / per_shard if per_shard else 1.0
        self.parts.append(1 if share <= 2 else -(-len(x) // max(1, int(per_shard))))
        return -len(self.parts)

    def shards(self, x: np.ndarray, spread: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root, np.int64)
        axis, cut, child = np.array(self.axis, np.float32), np.array(self.cut), np.array(self.child, np.int64)
        while (live := np.flatnonzero(at >= 0)).size:
            node = at[live]
            at[live] = child[node, (np.einsum("ij,ij->i", x[live], axis[node]) > cut[node]).astype(int)]
        leaf = -1 - at
        return self.base[leaf] + spread % np.array(self.parts, np.int64)[leaf]


def _vectors(kind: str, idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sketch_of(idf)
        for batch in batches:
            x = content_vectors(batch.column(0), kind, sketch)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["v"])

    return frugal(run)


def _deal(kind: str, idf: np.ndarray, tree: ContentTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sketch_of(idf)
        for batch in batches:
            spread = batch.column(1).to_numpy(zero_copy_only=False)
            shard = tree.shards(content_vectors(batch.column(4), kind, sketch), spread)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32))], names=[*batch.schema.names, "shard"])

    return frugal(run)


class Shard:
    """A BM25 inverted index over the whole ids of a shard's documents; sizes are those of the pieces to place."""

    def __init__(self, docs: list[np.ndarray], sizes: list[int], idf: np.ndarray, mean: float) -> None:
        self.sizes, self.n = sizes, len(docs)
        terms, at, weights = [], [], []
        for i, ids in enumerate(docs):
            if not sizes[i]:
                continue  # nothing of it is to be placed
            # a stable sort of 16-bit ids is by radix
            ordered = np.sort(ids, kind="stable")
            begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            term, count = ordered[begins].astype(np.int64), np.diff(np.append(begins, len(ordered)))
            weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * len(ids) / mean))
            terms.append(term)
            at.append(np.full(len(term), i, np.int32))
            weights.append(weight.astype(np.float32))
        term = np.concatenate(terms) if terms else np.empty(0, np.int64)
        held = np.concatenate(at) if at else np.empty(0, np.int32)
        weight = np.concatenate(weights) if weights else np.empty(0, np.float32)
        count = np.bincount(term, minlength=len(idf))
        dense = np.flatnonzero(count > max(1, self.n * DENSE))
        row = np.full(len(idf), -1)
        row[dense] = np.arange(len(dense))
        in_dense = row[term] >= 0
        m = np.zeros((self.n, len(dense)), np.float32)
        m[held[in_dense], row[term[in_dense]]] = weight[in_dense]
        self.common = (m > 0).astype(np.float32) @ m.T
        # a term of one document finds no other
        rest = ~in_dense & (count[term] > 1)
        term, held, weight = term[rest], held[rest], weight[rest]
        self.query = np.split(term, np.searchsorted(held, np.arange(1, self.n))) if self.n else []
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = held[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused pieces whose documents share any term with the seed's, best score first, ties by position."""
        a = self.first[self.query[seed]]
        lengths = self.first[self.query[seed] + 1] - a
        at = np.repeat(a - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        scores = self.common[seed] + np.bincount(self.docs[at], self.weights[at], minlength=self.n).astype(np.float32)
        scores[~unused] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def fill_windows(shard: Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, from, length): each filled with a seed and its neighbours to the last token.

    The last neighbour of a window is cut where the window ends; what remains of it is the seed of
    the next. A seed with no neighbours left takes the next unused piece. The last, partly filled
    window is cut at powers of two, so none needs padding.
    """
    n, sizes = shard.n, shard.sizes
    unused = np.array([s > 0 for s in sizes], bool)
    windows: list[list[tuple[int, int, int]]] = []
    cursor, seed, at = 0, -1, 0
    current: list[tuple[int, int, int]] = []
    room = window
    while True:
        if seed < 0:
            while cursor < n and not unused[cursor]:
                cursor += 1
            if cursor == n:
                break
            seed, at = cursor, 0
            unused[seed] = False
        part = min(room, sizes[seed] - at)
        current.append((seed, at, part))
        room -= part
        if room == 0:
            windows.append(current)
            current, room = [], window
            if at + part < sizes[seed]:
                at += part
            else:
                seed = -1
            continue
        left = seed
        seed = -1
        for j in shard.neighbours(left, unused):
            unused[j] = False
            part = min(room, sizes[j])
            current.append((int(j), 0, part))
            room -= part
            if room == 0:
                windows.append(current)
                current, room = [], window
                if part < sizes[j]:
                    seed, at = int(j), part
                break
    # what is left is less than a window
    pending, size = current, window - room
    while size:
        take = 1 << (size.bit_length() - 1)
        size -= take
        cut: list[tuple[int, int, int]] = []
        while take:
            piece, start, length = pending[0]
            part = min(take, length)
            cut.append((piece, start, part))
            take -= part
            pending = pending[1:] if part == length else [(piece, start + part, length - part), *pending[1:]]
        windows.append(cut)
    return windows


def _pack(kind: str, window: int, idf: np.ndarray, mean: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_key", "doc_id"], kind="stable")
        whole = [np.frombuffer(x, kind) for x in pdf["ids"]]
        ids = [x[len(x) // window * window :] for x in whole]
        doc_ids, totals = pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()
        rows, serial = [], int(key[0]) << 32
        for doc, total, crcs in zip(doc_ids, totals, pdf["full_crcs"], strict=True):
            for i, crc in enumerate(np.frombuffer(crcs, "<u4").tolist()):
                rows.append((doc, i * window, window, crc, total, serial, 0))
                serial += 1
        for pieces in fill_windows(Shard(whole, [len(x) for x in ids], idf, mean), window):
            offset = 0
            for k, start, length in pieces:
                crc = zlib.crc32(ids[k][start : start + length].astype("<u4").tobytes())
                rows.append((doc_ids[k], totals[k] - len(ids[k]) + start, length, crc, totals[k], serial, offset))
                offset += length
            serial += 1
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", small: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (end_id after them) fill windows of their own first; what remains, less than a window, is
    the piece to place. Documents are dealt by content to shards of about SHARD_DOCS, whose number grows with
    the table (`ContentTree`, fitted on PER_SHARD vectors a shard and MOST_PARTS shards at most). Each shard holds a BM25 index over the whole ids of its documents, with document frequencies and mean
    length of all of the table; terms are token ids, so the frequencies that tasks get are
    bounded by the vocabulary. A piece queries with all terms of its document, within its shard: a neighbour that
    another shard holds isn't seen. Then `fill_windows`. Every sequence is `window` long, but for
    those at a shard's end, whose lengths are powers of two.

    With `small`, tasks encode by SMALL slices and caches, for executors whose memory earlier jobs have filled; the result is the same.
    Within a shard documents go by a hash of id and text, so the files' layout doesn't matter, but for which of several shards
    takes a document of a leaf that needs more than one.
    A null or empty text is one piece of the end id. Rows with the same id and text are packed each; their
    pieces repeat. Null ids stay null. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    kind = enc.kind.str
    key = F.xxhash64(id_col, text_col)
    rows = docs.select(
        key.alias("row_key"),
        F.xxhash64(F.monotonically_increasing_id(), key).alias("spread"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    coded = written(rows.mapInArrow(_encode(tokenizer, end_id, window, small), CODED), "coded")
    n, length = coded.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids"))).first()
    counted = coded.select("ids").mapInArrow(_frequencies(kind), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = counted.toPandas()
    idf = np.zeros(max(enc.tok.get_vocab_size(), end_id + 1, int(df["term"].max() if len(df) else 0) + 1))
    idf[df["term"].to_numpy(np.int64)] = np.log1p((n - df["df"] + 0.5) / (df["df"] + 0.5))
    mean = max(1.0, (length or 0) / enc.kind.itemsize / max(n, 1))
    shards = max(1, -(-n // SHARD_DOCS))
    if shards == 1:
        dealt = coded.withColumn("shard", F.lit(0))
    else:
        slots, fitting = 1 << 30, min(shards, MOST_PARTS) * PER_SHARD
        # documents of one key are whole copies, ids included, and count once
        some = coded.where(F.pmod(F.xxhash64("row_key"), F.lit(slots)) < min(slots, -(-fitting * slots // n))).dropDuplicates(["row_key"])
        found = sorted(r["v"] for r in some.select("ids").mapInArrow(_vectors(kind, idf), "v binary").collect())
        tree = ContentTree(np.array([np.frombuffer(v, np.float32) for v in found]).reshape(-1, CONTENT), shards)
        dealt = coded.mapInArrow(_deal(kind, idf, tree), CODED + ", shard int")
    return dealt.groupBy("shard").applyInPandas(_pack(kind, window, idf, mean), PIECES)
