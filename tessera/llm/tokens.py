"""Token ids of whole texts, as a tokenizers file gives them, computed once per distinct word of a batch."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split into pieces at a time.
SLICE_BYTES = 8 << 20
#: Pieces that the cache of a Python worker holds at most; the older half goes first.
CACHE_PIECES = 500_000

_encoders: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """The encoder of this process for a file; a worker keeps it between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


# kinds of bytes; a Latin letter beyond ASCII has two bytes of kind LETTER
WHITE, LETTER, DIGIT, MARK, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:0x80] = MARK
_KIND[0x1C:0x20] = OTHER  # white space to some
_KIND[[0x20, *range(0x09, 0x0E)]] = WHITE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_KIND[0x30:0x3A] = DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOW_SECOND = np.arange(256, dtype=np.uint8)
_LOW_SECOND[[*range(0x80, 0x97), *range(0x98, 0x9F)]] += 0x20


class WordEncoder:
    """Encodes texts piece by piece where that is exact, word by word or whole where it is not.

    Two kinds of file are known. In the one (`spaced`) a byte-level pre-tokenizer makes runs of letters, of digits
    and of marks, each with a single space before it, and runs of white space without their last character, if a word follows. In the
    other white space is dropped, letters are lower-cased, and digits are single. Runs of ASCII and of Latin-1 letters are
    found for all bytes at once, and a distinct run goes to the vocabulary's merges; a word with any other
    character, an apostrophe or an added token goes through the whole encoder. Texts with white space
    beyond ASCII, and files of another kind, are encoded as whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # pieces are cached here
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm
        steps = [p.get("type") for p in pre.get("pretokenizers", [])]
        self.dropped = steps == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("behavior") == "Removed"
        self.special = [a["content"].encode() for a in spec.get("added_tokens", []) if a["content"]]
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4") if self.wide else np.dtype("<u2")
        self.table = byte_alphabet()
        self.code = "I" if self.wide else "H"
        self.space = self.table[0x20]
        self.most = CACHE_PIECES
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _odd(self, piece: str) -> bytes | None:
        """The ids of a word with an odd character, or None where only the whole text tells."""
        if self.spaced and any(c.isspace() for c in piece.removeprefix(" ")):
            return None
        return self._pack(self.tok.encode(piece, add_special_tokens=False).ids)

    def of_pieces(self, pieces: Sequence[str], odd: np.ndarray) -> list[bytes | None]:
        """The ids of each piece, from the cache where it has them. Odd ones are words for the whole encoder, others go to the merges as they are."""
        young, old, tokenize, code, space = self.young, self.old, self.model.tokenize, self.code, self.space
        found = list(map(young.get, pieces))
        for i in [i for i, x in enumerate(found) if x is None]:
            piece = pieces[i]
            x = old.get(piece)
            if x is None:
                if odd[i]:
                    x = self._odd(piece)
                    if x is None:
                        continue
                elif piece.isalpha() and piece.isascii():
                    x = array(code, [t.id for t in tokenize(piece)]).tobytes()
                elif self.dropped and not piece.strip(" \t\n\x0b\x0c\r"):
                    x = b""
                else:
                    shown = space + piece[1:] if piece[1:].isalpha() and piece.isascii() and piece[0] == " " else piece.encode().decode("latin-1").translate(self.table)
                    x = array(code, [t.id for t in tokenize(shown)]).tobytes()
            found[i] = x
            if len(piece) < 64:
                young[piece] = x
        if len(young) > self.most // 2:
            self.young, self.old = {}, young
        return found

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, where pieces begin, where odd words hold an odd character) of concatenated texts; no piece spans texts."""
        n = len(data)
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        second = data[lead + 1]
        latin = lead[(second != 0x97) & (second != 0xB7)]
        kind[latin] = kind[latin + 1] = LETTER
        fresh = np.zeros(n + 1, bool)
        fresh[at] = True
        white = kind == WHITE
        begins = np.empty(n, bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= fresh[:n]
        odd = np.flatnonzero((kind == OTHER) | (data == 0x27))
        if self.special:
            joined = data.tobytes()
            hits = [m.start() for t in self.special for m in re.finditer(re.escape(t), joined)]
            odd = np.concatenate([odd, np.array(hits, np.int64)])
        shown = data
        if self.dropped:
            begins |= kind == DIGIT
            shown = _LOWER[data]
            shown[latin + 1] = _LOW_SECOND[data[latin + 1]]
        if len(odd):
            # a word with an odd character is one piece
            starts = begins & ~white
            starts[1:] &= white[:-1] | fresh[1:n]
            word = np.cumsum(starts) - 1
            strange = np.zeros(int(word[-1]) + 2, bool)
            strange[word[odd]] = True
            inside = strange[word] & ~white
            begins &= ~inside | starts
            if self.dropped:
                shown[inside] = data[inside]
        if self.spaced:
            # the last of a run of white space is apart if a word follows, and a space goes with that word
            ends = white.copy()
            ends[:-1] &= ~white[1:]
            ends &= ~fresh[1:]
            begins |= ends
            joins = np.flatnonzero(ends & (data == 0x20)) + 1
            begins[joins] = False
        return shown, np.flatnonzero(begins), odd

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if not len(data):
            return np.empty(0, self.kind), np.zeros(n + 1, np.int64)
        shown, begins, strange = self._pieces(data, at)
        strange = np.searchsorted(begins, strange, side="right") - 1
        begins = np.append(begins, len(data))
        ends = np.searchsorted(begins, at)
        pieces = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(shown))
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        del pieces, shown, begins  # as large as the texts
        is_odd = np.zeros(len(coded.dictionary), bool)
        is_odd[which[strange]] = True
        ids = self.of_pieces(coded.dictionary.to_pylist(), is_odd)
        odd = [i for i, x in enumerate(ids) if x is None]
        for i in odd:
            ids[i] = b""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(ids), self.kind)
        starts = np.cumsum(sizes) - sizes
        counts = sizes[which]
        upto = np.concatenate([[0], np.cumsum(counts)])
        index = np.int32 if upto[-1] < 1 << 30 else np.int64
        place = np.repeat((starts[which] - upto[:-1]).astype(index), counts)
        place += np.arange(upto[-1], dtype=index)
        out, bounds = pool[place], upto[ends]
        del place
        if odd:
            lost = np.zeros(len(ids), bool)
            lost[odd] = True
            bad = np.unique(np.searchsorted(ends, np.flatnonzero(lost[which]), side="right") - 1)
            parts = [out[bounds[i] : bounds[i + 1]] for i in range(n)]
            for i in bad:
                parts[i] = self.whole(texts[int(i)].as_py())
            out = np.concatenate(parts) if parts else out
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, bounds

    def slices(self, texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) for runs of rows: row i of a run has ids[bounds[i]:bounds[i+1]].

        Nulls count as empty. A run holds about `size` bytes of text, SLICE_BYTES if it isn't given, and one text at least.
        """
        size = size or SLICE_BYTES
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + size, side="right")))
            part = texts.slice(at, to - at).cast(pa.large_string())
            part = pc.fill_null(part, "") if part.null_count else part
            if self.spaced or self.dropped:
                ids, bounds = self._slice(part)
            else:
                each = [self.whole(t) for t in part.to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
                ids = np.concatenate(each) if each else np.empty(0, self.kind)
            yield at, ids, bounds
            at = to
