"""Token counts that follow edits: segment trees over pre-tokens, re-encoded only where an edit reaches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal
from tessera.llm.tokens import SLICE_BYTES, WordEncoder, encoder

#: Scrubbing edits: what matches is replaced; mail addresses, then runs of six digits or more. The
#: first member is a string that any match holds, or empty.
EDITS = (
    ("@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<mail>"),
    ("", r"[0-9]{6,}", "<number>"),
)
LEAF_CHARS = 256


def clean(text: str, at: int) -> bool:
    """Whether no pre-token spans `at`: a lone space there, between characters that aren't white space."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def leaves_of(text: str) -> list[str]:
    """The text cut at clean places, LEAF_CHARS apart or more."""
    out, begin, at = [], 0, text.find(" ", LEAF_CHARS)
    while at >= 0:
        if clean(text, at):
            out.append(text[begin:at])
            begin, at = at, at + LEAF_CHARS
        else:
            at += 1
        at = text.find(" ", at)
    out.append(text[begin:])
    return out


class CountTree:
    """Leaves of pre-tokens of one text, with sums of their token and character counts over a binary tree.

    `edit` replaces a range of the present text. It takes the leaves that the range reaches (and a neighbour
    where the range meets its edge), re-encodes the part between the nearest clean places that leave a whole
    word of context on either side, and updates the sums on the path to the root.
    """

    def __init__(self, leaves: list[str], counts: Sequence[int], enc: WordEncoder) -> None:
        self.enc, self.leaves = enc, leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.reencoded = 0
        level = np.zeros((self.size, 2), np.int64)
        level[: len(leaves), 0] = counts
        level[: len(leaves), 1] = [len(x) for x in leaves]
        self.nodes = np.zeros((2 * self.size, 2), np.int64)
        at = self.size
        while at:
            self.nodes[at : 2 * at] = level
            level = level[0::2] + level[1::2] if at > 1 else level
            at //= 2

    @property
    def total(self) -> int:
        return int(self.nodes[1, 0])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if char >= begin + self.nodes[k, 1] and self.nodes[k + 1, 1]:
                begin += int(self.nodes[k, 1])
                k += 1
        return k - self.size, begin

    def _put(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        k = leaf + self.size
        delta = np.array([count, len(text)]) - self.nodes[k]
        while k:
            self.nodes[k] += delta
            k //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end by new."""
        first, begin = self._leaf_at(start)
        last, last_begin = self._leaf_at(max(start, end - 1))
        while first > 0 and not any(clean(self.leaves[first], i) for i in range(1, max(0, start - begin - 1))):
            first -= 1
            begin -= len(self.leaves[first])
            if self.leaves[first]:
                break
        while last < len(self.leaves) - 1 and end > last_begin + len(self.leaves[last]) - 2 * LEAF_CHARS // 4:
            last_begin += len(self.leaves[last])
            last += 1
            if self.leaves[last]:
                break
        old = "".join(self.leaves[first : last + 1])
        x, y = start - begin, end - begin
        made = old[:x] + new + old[y:]
        low, seen = max(0, x - 1), 0
        while low > 0:
            if clean(old, low):
                seen += 1
                if seen == 2:
                    break
            low -= 1
        high, seen = min(y + 1, len(old)), 0
        while high < len(old):
            if clean(old, high):
                seen += 1
                if seen == 2:
                    break
            high += 1
        before, after = old[low:high], made[low : high + len(made) - len(old)]
        self.reencoded += len(after)
        count = sum(int(self.nodes[self.size + k, 0]) for k in range(first, last + 1))
        count += len(self.enc.whole(after)) - len(self.enc.whole(before))
        for k in range(first + 1, last + 1):
            self._put(k, "", 0)
        self._put(first, made, count)


def planned(text: str, edits: Sequence[tuple[str, str, str]] = EDITS) -> list[tuple[int, int, str]]:
    """The edits of a text from its end to its start, none touching another; where matches overlap the earlier pattern's counts."""
    taken: list[tuple[int, int, str]] = []
    for need, pattern, new in edits:
        if need in text:
            found = [(m.start(), m.end(), new) for m in re.finditer(pattern, text) if m.end() > m.start()]
            k, free = 0, []
            for edit in found:
                # both lists are in order and without overlaps in themselves
                while k < len(taken) and taken[k][1] <= edit[0]:
                    k += 1
                if k == len(taken) or taken[k][0] >= edit[1]:
                    free.append(edit)
            taken = sorted(taken + free)
    return taken[::-1]


SCHEMA = "doc_id long, n_tokens long, n_edits long, edited_tokens long, edited_chars long, reencoded_chars long"


def _count(path: str, edits: Sequence[tuple[str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1).cast(pa.large_string())
            upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(keys):
                # texts of some SLICE_BYTES, one at least
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                texts = [t or "" for t in column.slice(at, to - at).to_pylist()]
                leaves = [leaves_of(t) for t in texts]
                flat = pa.array([x for group in leaves for x in group], pa.large_string())
                counts = np.concatenate([np.diff(bounds) for _, _, bounds in enc.slices(flat)])
                rows, done = [], 0
                for text, group in zip(texts, leaves, strict=True):
                    tree = CountTree(group, counts[done : done + len(group)], enc)
                    done += len(group)
                    before, todo = tree.total, planned(text, edits)
                    for start, end, new in todo:
                        tree.edit(start, end, new)
                    rows.append((before, len(todo), tree.total, int(tree.nodes[1, 1]), tree.reencoded))
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), *columns], names=names)
                at = to

    return frugal(run)


def edited_counts(
    docs: DataFrame, tokenizer: str, edits: Sequence[tuple[str, str, str]] = EDITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_edits, edited_tokens, edited_chars, reencoded_chars.

    Counts each whole text once, by leaves of a CountTree, then applies the edits (by default, scrubbing of
    mail addresses and long numbers) to the tree. edited_tokens is what encoding the edited text anew
    would count; reencoded_chars tells how little of it was. No shuffle; a task holds some SLICE_BYTES of text at a time, and
    one text at least. A text without clean places, as one without spaces, is a single leaf.

    A null or empty text has no tokens and no edits. Null ids and repeated rows are kept. An empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(tokenizer, tuple(edits)), SCHEMA)
