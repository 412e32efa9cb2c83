"""Heading-aware chunks of document bodies, one Arrow pass per document batch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$", re.MULTILINE)
_GAP = re.compile(r"\n\s*\n+")
CHUNKS = "document_id long, position int, heading_path array<string>, section_name string, text string"


def split_oversized(text: str, limit: int) -> list[str]:
    """Pieces of at most `limit` characters, cut at blank lines only; a longer paragraph stays whole."""
    pieces = []
    while text:
        cuts = [m.start() for m in _GAP.finditer(text) if m.start() <= limit] if 0 < limit < len(text) else []
        if not cuts or cuts[-1] <= 0:
            pieces.append(text)
            break
        pieces.append(text[: cuts[-1]].rstrip())
        text = text[cuts[-1] :].lstrip()
    return pieces


def sections(body: str) -> Iterator[tuple[list[str], str, str]]:
    """(heading path, section name, text) in order: what precedes the first heading, then each heading's own text."""
    body = body.strip()
    marks = list(_HEAD.finditer(body))
    before = body[: marks[0].start()].strip() if marks else body
    if before:
        yield [], "", before
    path: dict[int, str] = {}
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        level, name = len(m[1]), m[2].strip()
        path = {k: v for k, v in path.items() if k < level} | {level: name}
        yield list(path.values()), name, body[m.end() : after.start() if after else len(body)].strip()


def document_chunks(body: str, title: str, limit: int) -> list[tuple[list[str], str, str]]:
    """The chunks of one document; a section without a heading is under the title, if there is one."""
    return [(path or ([title] if title else []), name, piece) for path, name, text in sections(body) for piece in split_oversized(text, limit)]


def chunk_documents(docs: DataFrame, limit: int = 2000) -> DataFrame:
    """(document_id, position, heading_path, section_name, text, text_hash, char_count) from (document_id, title, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc, at, *chunk)
                for doc, title, body in zip(pdf["document_id"], pdf["title"], pdf["body"], strict=True)
                for at, chunk in enumerate(document_chunks(body or "", title or "", limit))
            ]
            yield pd.DataFrame(rows, columns=["document_id", "position", "heading_path", "section_name", "text"])

    made = docs.select("document_id", "title", "body").mapInPandas(run, CHUNKS)
    return made.withColumn("text_hash", F.sha2("text", 256)).withColumn("char_count", F.length("text"))
