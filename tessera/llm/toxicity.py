"""Toxicity scores of whole texts by a bidirectional gated recurrent network, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import frugal, release, written
from tessera.llm.shingles import mix, text_slices

#: Words of a window, and words from one window's start to the next: what is half a window long is whole in some window.
WINDOW, STRIDE = 48, 24
HIDDEN, WIDTH = 16, 16
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 14
GRAMS = (3, 4, 5)
#: Embedding rows that fewer training texts hold stay zero, so that no text is learned by its rare words.
LEAST_TEXTS = 3
#: Labelled rows that training takes at most, of each label, and characters of them in all; whole texts, by hash of id.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 2500, 64 << 20
#: Gradient steps, whatever the number of rows, texts of a step at most, and windows from which it takes no further text.
STEPS, BATCH, BATCH_WINDOWS, RATE = 400, 64, 512, 0.01
#: Windows that run through the network at a time.
CHUNK = 1024
#: Bytes of text whose words are coded at a time: by a task, and in training, which has the driver's memory.
SLICE_BYTES, TRAIN_BYTES = 2 << 20, 1 << 20
THRESHOLD = 0.7

_WORDS = np.zeros(256, bool)
_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_P = np.uint64(0x100000001B3)

Params = dict[str, np.ndarray]


@dataclass
class Coded:
    """Words of some texts: which distinct word each is, each text's bounds, and the distinct words' rows."""

    which: np.ndarray
    bounds: np.ndarray
    word_rows: np.ndarray
    gram_rows: np.ndarray
    gram_starts: np.ndarray


def code(data: np.ndarray, at: np.ndarray) -> Coded:
    """Words (runs of letters, digits and bytes beyond ASCII) of lower-cased texts, hashed to embedding rows.

    A distinct word has one row for itself and one for each of its character n-grams, its ends marked.
    """
    inside = _WORDS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    begins[edge] = inside[edge]
    first = np.flatnonzero(begins)
    bounds = np.searchsorted(first, at)
    upto = np.concatenate([[0], np.cumsum(inside)])
    kept = data[inside]
    offsets = np.append(upto[first], len(kept))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary
    n = len(distinct)
    ends = np.frombuffer(distinct.buffers()[1], np.int64)[: n + 1]
    chars = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[: ends[-1] if n else 0]
    # each word between marks: 1 before, 2 after
    marked = np.zeros(len(chars) + 2 * n, np.uint64)
    place = np.arange(len(chars)) + np.repeat(np.arange(n) * 2 + 1, np.diff(ends))
    marked[place] = chars
    starts = ends[:-1] + 2 * np.arange(n)
    stops = ends[1:] + 2 * np.arange(1, n + 1)
    marked[starts] = 1
    marked[stops - 1] = 2
    owner = np.repeat(np.arange(n), stops - starts)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int((stops - starts).max()) if n else 0, _P)]))
        whole = np.add.reduceat(marked * power[np.arange(len(marked)) - starts[owner]], starts) if n else np.empty(0, np.uint64)
        rows, owners = [], []
        for g in GRAMS:
            h = np.full(max(0, len(marked) - g + 1), np.uint64(g))
            for k in range(g):
                h = h * _P + marked[k : k + len(h)]
            fits = owner[: len(h)] == owner[g - 1 : g - 1 + len(h)]
            rows.append((mix(h[fits]) % np.uint64(GRAM_ROWS)).astype(np.int32))
            owners.append(owner[: len(h)][fits])
    owners_all, rows_all = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(owners_all, kind="stable")
    gram_starts = np.searchsorted(owners_all[order], np.arange(n + 1))
    return Coded(which, bounds, (mix(whole) % np.uint64(WORD_ROWS)).astype(np.int32), rows_all[order], gram_starts)


def word_inputs(p: Params, c: Coded, block: int = 16_384) -> np.ndarray:
    """Each distinct word's input: its own embedding plus the mean of its n-grams', a block of words at a time."""
    out = p["words"][c.word_rows]
    for a in range(0, len(c.word_rows), block):
        starts = c.gram_starts[a : a + block + 1]
        counts = np.diff(starts)
        rows = c.gram_rows[starts[0] : starts[-1]]
        if not len(rows):
            continue
        sums = np.add.reduceat(p["grams"][rows], np.minimum(starts[:-1] - starts[0], len(rows) - 1), axis=0)
        sums[counts == 0] = 0
        out[a : a + block] += sums / np.maximum(counts, 1)[:, None].astype(out.dtype)
    return out


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of all overlapping windows; a text without words has none."""
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = k * STRIDE
    return text, bounds[text] + start, np.minimum(WINDOW, n[text] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run_direction(gates: np.ndarray, idx: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: bool):
    """Hidden states of one direction (steps x windows x HIDDEN), and what its gradient needs."""
    steps, n = idx.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((steps, n, HIDDEN), np.float32)
    trace = []
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        g = gates[idx[t]]
        a = h @ u
        zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        cand = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        new = cand + z * (h - cand)
        m = mask[t]
        if keep:
            trace.append((t, h, z, r, cand, a[:, 2 * HIDDEN :]))
        h = np.where(m[:, None], new, h)
        out[t] = h
    return out, trace


def forward(p: Params, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows: idx and mask are steps x windows, idx into the rows of x."""
    gf, gb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
    hf, tf = _run_direction(gf, idx, mask, p["uf"], False, keep)
    hb, tb = _run_direction(gb, idx, mask, p["ub"], True, keep)
    h = np.concatenate([hf, hb], axis=2)
    e = h @ p["att"]
    e = np.where(mask, e, np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = (alpha[:, :, None] * h).sum(axis=0)
    logit = pooled @ p["out"] + p["bias"][0]
    return logit, (h, alpha, pooled, tf, tb)


def _back_direction(p: Params, grads: Params, name: str, dh_all, trace, idx, mask, dx, x) -> None:
    u, w = p["u" + name], p["w" + name]
    du, dgates = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
    dh = np.zeros(dh_all.shape[1:], np.float32)
    for t, h, z, r, cand, an in reversed(trace):
        dh = dh + dh_all[t]
        m = mask[t][:, None]
        d = np.where(m, dh, 0)
        dcand = d * (1 - z) * (1 - cand * cand)
        dz = d * (h - cand) * z * (1 - z)
        dr = dcand * an * r * (1 - r)
        dg = np.concatenate([dz, dr, dcand], axis=1)
        da = np.concatenate([dz, dr, dcand * r], axis=1)
        du += h.T @ da
        np.add.at(dgates, idx[t], dg)
        dh = np.where(m, d * z + da @ u.T, dh)
    grads["u" + name] = du
    grads["w" + name] = x.T @ dgates
    grads["b" + name] = dgates.sum(axis=0)
    dx += dgates @ w.T


def backward(p: Params, x, idx, mask, state, dlogit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters above the inputs, and of the inputs x."""
    h, alpha, pooled, tf, tb = state
    grads: Params = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * p["out"][None, :]
    dalpha = (h * dpooled[None]).sum(axis=2)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    grads["att"] = np.einsum("tn,tnh->h", de, h)
    dh = alpha[:, :, None] * dpooled[None] + de[:, :, None] * p["att"]
    dx = np.zeros_like(x)
    _back_direction(p, grads, "f", dh[:, :, :HIDDEN], tf, idx, mask, dx, x)
    _back_direction(p, grads, "b", dh[:, :, HIDDEN:], tb, idx, mask, dx, x)
    return grads, dx


def new_params(seed: int = 5) -> Params:
    r = np.random.default_rng(seed)
    n = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
    p = {"words": n(WORD_ROWS, WIDTH, scale=0.05), "grams": n(GRAM_ROWS, WIDTH, scale=0.1)}
    for d in "fb":
        p["w" + d], p["u" + d] = n(WIDTH, 3 * HIDDEN, scale=0.3), n(HIDDEN, 3 * HIDDEN, scale=0.2)
        p["b" + d] = np.zeros(3 * HIDDEN, np.float32)
    p |= {"att": n(2 * HIDDEN, scale=0.2), "out": n(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
    return p | {"shift": np.zeros(1, np.float32)}


def _layout(c: Coded, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)[:, None]
    mask = step < length[None, :]
    idx = c.which[np.minimum(start[None, :] + step, len(c.which) - 1)]
    return idx, mask


def window_logits(p: Params, c: Coded, x: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = [np.empty(0, np.float32)]
    for a in range(0, len(start), CHUNK):
        idx, mask = _layout(c, start[a : a + CHUNK], length[a : a + CHUNK])
        out.append(forward(p, x, idx, mask)[0])
    return np.concatenate(out)


def text_logits(p: Params, c: Coded) -> np.ndarray:
    """The largest logit of a text's windows; -20, which scores near 0, for a text without words."""
    out = np.full(len(c.bounds) - 1, -np.inf, np.float32)
    text, start, length = windows(c.bounds)
    if len(text):
        np.maximum.at(out, text, window_logits(p, c, word_inputs(p, c), start, length))
    return np.where(np.isneginf(out), np.float32(-20), out)


def coded_texts(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, Coded]]:
    for row, data, at in text_slices(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), size):
        yield row, code(data, at)


class Adam:
    def __init__(self) -> None:
        self.m: Params = {}
        self.v: Params = {}
        self.t = 0

    def step(self, p: Params, grads: Params, rate: float) -> None:
        self.t += 1
        fix = rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m.setdefault(k, np.zeros_like(p[k])), self.v.setdefault(k, np.zeros_like(p[k]))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[k] -= (fix * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


def label_weights(coded: list[Coded], toxic: np.ndarray, clip: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """For each embedding row of words and n-grams: how surely texts with it are more often toxic.

    The log odds of presence among toxic against clean texts, over its standard error, so what few texts hold
    weighs little. Rows that fewer than LEAST_TEXTS texts hold are not numbers.
    """
    seen = {name: np.zeros((2, n)) for name, n in (("words", WORD_ROWS), ("grams", GRAM_ROWS))}
    done = 0
    for c in coded:
        n = len(c.bounds) - 1
        text = np.repeat(np.arange(n), np.diff(c.bounds))
        used = np.unique(text * np.int64(len(c.word_rows) + 1) + c.which)
        text, word = np.divmod(used, np.int64(len(c.word_rows) + 1))
        counts = np.diff(c.gram_starts)[word]
        at = np.repeat(c.gram_starts[word] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        for name, owner, rows in (("words", text, c.word_rows[word]), ("grams", np.repeat(text, counts), c.gram_rows[at])):
            pairs = np.unique(owner.astype(np.int64) * (1 << 20) + rows)
            np.add.at(seen[name], (toxic[done + (pairs >> 20)], pairs & ((1 << 20) - 1)), 1)
        done += n
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    out = []
    for name in ("words", "grams"):
        clean, bad = seen[name]
        odds = np.log((bad + 0.5) / (n1 - bad + 0.5)) - np.log((clean + 0.5) / (n0 - clean + 0.5))
        z = odds / np.sqrt(1 / (bad + 0.5) + 1 / (clean + 0.5))
        out.append(np.where(bad + clean >= LEAST_TEXTS, np.clip(z, -clip, clip) / clip, np.nan).astype(np.float32))
    return out[0], out[1]


def train(texts: list[str], toxic: np.ndarray, seed: int = 5, steps: int = STEPS, start_at_labels: bool = True) -> Params:
    """Weights from labelled texts, where a text is as toxic as its worst window.

    One coordinate of the words' embeddings and one of the n-grams' start at their label weights (unless start_at_labels
    is false). Each step scores all windows of a batch of whole texts, then follows the gradient at each text's
    highest window. The score is THRESHOLD half way between the two labels' logits, at the cut with the fewest errors.
    """
    p, adam, r = new_params(seed), Adam(), np.random.default_rng(seed)
    coded = [c for _, c in coded_texts(pa.array(texts, pa.large_string()), TRAIN_BYTES)]
    live: dict[str, np.ndarray] = {}
    for name, at, weights in zip(("words", "grams"), (0, 1), label_weights(coded, toxic), strict=True):
        live[name] = ~np.isnan(weights)
        if start_at_labels:
            p[name][:, at] = np.nan_to_num(weights)
        p[name][~live[name]] = 0
    groups: list[tuple[Coded, np.ndarray, int]] = []
    done = 0
    for c in coded:
        groups.append((c, toxic[done : done + len(c.bounds) - 1].astype(np.float32), done))
        done += len(c.bounds) - 1
    weight = len(toxic) / max(1, 2 * toxic.sum()), len(toxic) / max(1, 2 * (len(toxic) - toxic.sum()))
    usable = any((np.diff(c.bounds) > 0).any() for c in coded)
    while usable and adam.t < steps:
        for g in r.permutation(len(groups)):
            c, y, _ = groups[g]
            use = np.flatnonzero(np.diff(c.bounds) > 0)
            text, start, length = windows(c.bounds)
            r.shuffle(use)
            for batch in _batches(use, np.bincount(text, minlength=len(c.bounds) - 1)):
                mine = np.flatnonzero(np.isin(text, batch))
                # only the batch's distinct words are embedded and updated
                idx, mask = _layout(c, start[mine], length[mine])
                rows, local = np.unique(idx, return_inverse=True)
                idx = local.reshape(idx.shape)
                part = _subset(c, rows)
                x = word_inputs(p, part)
                logits = np.concatenate([forward(p, x, idx[:, k : k + CHUNK], mask[:, k : k + CHUNK])[0] for k in range(0, idx.shape[1], CHUNK)])
                order = np.lexsort((-logits, text[mine]))
                top = order[np.unique(text[mine][order], return_index=True)[1]]
                idx, mask, label = idx[:, top], mask[:, top], y[text[mine][top]]
                logit, state = forward(p, x, idx, mask, keep=True)
                cost = np.where(label > 0.5, weight[0], weight[1])
                dlogit = ((_sigmoid(logit) - label) * cost / len(label)).astype(np.float32)
                grads, dx = backward(p, x, idx, mask, state, dlogit)
                grads["words"] = np.zeros_like(p["words"])
                np.add.at(grads["words"], part.word_rows, dx)
                counts = np.diff(part.gram_starts)
                grads["grams"] = np.zeros_like(p["grams"])
                np.add.at(grads["grams"], part.gram_rows, np.repeat(dx / np.maximum(counts, 1)[:, None].astype(np.float32), counts, axis=0))
                for name, rows in live.items():
                    grads[name][~rows] = 0
                adam.step(p, grads, RATE * (0.5 if adam.t >= steps // 2 else 1))
    logits = np.concatenate([text_logits(p, c) for c in coded]) if coded else np.empty(0)
    p["shift"] = _threshold(logits, toxic)
    return p


def _batches(texts: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in order, BATCH at a time, or fewer with BATCH_WINDOWS windows; one at least."""
    at = 0
    while at < len(texts):
        upto = np.cumsum(counts[texts[at : at + BATCH]])
        to = at + max(1, int(np.searchsorted(upto, BATCH_WINDOWS, side="right")))
        yield texts[at:to]
        at = to


def _subset(c: Coded, rows: np.ndarray) -> Coded:
    counts = c.gram_starts[rows + 1] - c.gram_starts[rows]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(c.gram_starts[rows] - ends[:-1], counts) + np.arange(ends[-1])
    return Coded(c.which, c.bounds, c.word_rows[rows], c.gram_rows[at], ends)


def _threshold(logits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The logit at which the score shall be THRESHOLD."""
    if not toxic.any() or toxic.all():
        return np.zeros(1, np.float32)
    order = np.argsort(logits, kind="stable")
    s, y = logits[order], toxic[order].astype(bool)
    wrong = np.concatenate([[0], np.cumsum(y)]) / y.sum() + (np.sum(~y) - np.concatenate([[0], np.cumsum(~y)])) / np.sum(~y)
    best = np.flatnonzero(wrong == wrong.min())
    k = best[len(best) // 2]
    low, high = s[max(k - 1, 0)], s[min(k, len(s) - 1)]
    return np.array([(low + high) / 2], np.float32)


def _score(p: Params):
    bias = np.log(THRESHOLD / (1 - THRESHOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, c in coded_texts(batch.column(1)):
                logits = text_logits(p, c).astype(np.float64)
                score = 1 / (1 + np.exp(-np.clip(logits - p["shift"][0] + bias, -30, 30)))
                keys = [c.slice(row, len(score)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(score)), pa.array(score), pa.array(logits >= p["shift"][0]), *keys],
                    names=["doc_id", "score", "toxic", *batch.schema.names[2:]],
                )

    return frugal(run)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, seed: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded sample of labelled rows that aren't held out, in order of a hash of the id."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64(F.lit(seed), "doc_id")
    some = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    chosen = some[0].unionByName(some[1])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the sample holds TRAIN_TOXIC + TRAIN_CLEAN ids at most
    found = written(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")), "training")
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(order, "doc_id"))
    within = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= TRAIN_CHARS).select("doc_id")
    got = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for r in found.join(F.broadcast(within), "doc_id").collect())
    return [t for _, t, _ in got], np.array([y for _, _, y in got], np.int64)


def held_out(doc_id) -> F.Column:
    """Rows kept from learning: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 5, row_col: str | None = None
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and row_col, a long, if one is named.

    The network reads windows of WINDOW words, STRIDE apart, over the whole text; a word enters with its own
    embedding and those of its character n-grams; a gated recurrent layer runs in each direction, attention pools the states, and
    the highest window's logit is the text's. It is trained on the driver from TRAIN_TOXIC and TRAIN_CLEAN
    labelled rows and TRAIN_CHARS characters of them at most that aren't held out (a documented bound; scoring covers
    every row and whole texts). Only the text
    enters a score. predicted is 1 if score >= THRESHOLD.

    Nulls: a null or empty text scores near 0. Null ids are kept, not held out. Labels with nulls are not used; of
    repeated labels the toxic one counts. Without labels of both kinds scores come from an untrained network and
    nothing is predicted toxic. Repeated rows score alike. An empty table gives no rows.
    """
    texts, toxic = training_rows(docs, labels, id_col, text_col, seed)
    both = len(set(toxic.tolist())) == 2
    p = train(texts, toxic, seed) if both else new_params(seed) | {"shift": np.array([25.0], np.float32)}
    del texts
    release()  # the driver's process outlives the training
    also = [] if row_col is None else [row_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also)
    scored = rows.mapInArrow(_score(p), ", ".join(["doc_id long", "score double", "toxic boolean", *(f"{c} long" for c in also)]))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        *also,
    )
