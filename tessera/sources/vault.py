"""Documents in a folder of Markdown files, and the versioned projection tables made from them."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import META, classify, skipped
from tessera.functions.text import body_tags, document_title, frontmatter_tags, heading_outline, wikilinks
from tessera.settings import SCHEMA_VERSION, Settings
from tessera.sources.working import plain_unions

_BLOCK = re.compile(r"\A---[ \t]*\n(.*?)^---[ \t]*$\n?", re.DOTALL | re.MULTILINE)
PARSED = "path string, content_hash string, mtime_ns long, size_bytes long, title string, frontmatter string, tags array<string>, aliases array<string>, body string"


def _strings(value: object) -> list[str]:
    return [str(v).strip() for v in value if v is not None] if isinstance(value, list) else [value.strip()] if isinstance(value, str) else []


def split_frontmatter(text: str) -> tuple[dict, str]:
    """(frontmatter, body); a malformed block is dropped and reads as empty."""
    import yaml

    m = _BLOCK.match(text)
    if not m:
        return {}, text
    try:
        front = yaml.safe_load(m[1])
    except yaml.YAMLError:
        front = None
    return front if isinstance(front, dict) else {}, text[m.end() :]


def contained(root: str, candidate: str) -> str:
    """The real path of a regular file under root; a link, what resolves outside root and what is no regular file are errors.

    For local folders; to be called right before a file is opened, as a path may change after it was listed.
    """
    base = os.path.realpath(root, strict=True)
    if os.path.islink(candidate):
        raise ValueError("a link isn't followed")
    real = os.path.realpath(candidate, strict=True)
    if os.path.commonpath([base, real]) != base or real == base:
        raise ValueError("the path is outside the root")
    if not os.path.isfile(real):
        raise ValueError("the path isn't a regular file")
    return real


def relative_path(path: str) -> str:
    """A path relative to the root, without leading slashes; empty ones and those with a `..` part are errors."""
    clean = path.strip().lstrip("/")
    if not clean or ".." in clean.split("/"):
        raise ValueError("the path must be relative to the root")
    return clean


def safe_message(error: BaseException, root: str, most: int = 500) -> str:
    """An error's text without the root's path, cut at `most` characters."""
    return str(error).replace(root.rstrip("/"), "<root>")[:most] if root.rstrip("/") else str(error)[:most]


def _links(root: str) -> list[str]:
    """Relative paths of links under a local root, files and folders; a remote store has none."""
    base = re.sub(r"^file:/*", "/", root)
    if re.match(r"^[a-z0-9]+:", base) or not os.path.isdir(base):
        return []
    return [os.path.relpath(os.path.join(at, n), base) for at, folders, files in os.walk(base) for n in (*folders, *files) if os.path.islink(os.path.join(at, n))]


def scan(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """(path, content, mtime_ns, size_bytes) of the documents under root, paths relative to it.

    Links are pruned, and files that can't be read or vanish are left out. So are empty files, which Spark's file sources
    skip; they would have no chunks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    files = files.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = files.select(path.alias("path"), "content", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"))
    pruned = F.lit(False)
    for link in _links(root):
        pruned = pruned | (F.col("path") == link) | F.col("path").startswith(link + "/")
    return rows.where(~pruned & ~skipped(F.col("path"), settings.ignored_dirs, settings.ignored_globs))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            front, body = split_frontmatter(bytes(r.content).decode("utf-8", "replace"))
            aliases = [a for key in ("aliases", "alias") for a in _strings(front.get(key)) if a]
            title = front.get("title") if isinstance(front.get("title"), str) else None
            rows.append((r.path, r.content_hash, r.mtime_ns, r.size_bytes, title, json.dumps(front, default=str), _strings(front.get("tags")), list(dict.fromkeys(aliases)), body))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])


def parse(files: DataFrame) -> DataFrame:
    """Documents with title, tags, aliases, wikilinks, headings and classes of their paths."""
    rows = files.withColumn("content_hash", F.sha2("content", 256)).mapInPandas(_parse, PARSED)
    body = F.col("body")
    out = rows.select(
        "path", "content_hash", "mtime_ns", "size_bytes", "frontmatter", "aliases", "body",
        document_title(F.col("title"), body, F.col("path")).alias("title"),
        F.array_distinct(F.concat(frontmatter_tags(F.col("tags")), body_tags(body))).alias("tags"),
        wikilinks(body).alias("wikilinks"),
        heading_outline(body).alias("headings"),
        classify(F.col("path")).alias("meta"),
    )
    return out.select("*", *(F.col(f"meta.{m}").alias(m) for m in META)).drop("meta").withColumn("updated_at_ns", F.col("mtime_ns"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, updated (hash or time differs), removed or skipped, by one full outer join."""
    a = old.select("path", F.col("content_hash").alias("h0"), F.col("mtime_ns").alias("t0"), F.lit(True).alias("was"))
    b = new.select("path", F.col("content_hash").alias("h1"), F.col("mtime_ns").alias("t1"), F.lit(True).alias("is"))
    same = F.col("h0").eqNullSafe(F.col("h1")) & F.col("t0").eqNullSafe(F.col("t1"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "skipped").otherwise("updated")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def reuse_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """new (document_id, position, input) with chunk_id of an old chunk of equal input, or null: the k-th of the new, by position,
    takes the k-th of the old, largest id first."""
    from pyspark.sql import Window

    key = ["document_id", "input"]
    a = old.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("chunk_id").desc()))).select(*key, "turn", "chunk_id")
    b = new.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("position")))
    return b.join(a, [*key, "turn"], "left").drop("turn")


class Projection:
    """Tables of one projection directory: a new version is written beside the old, then the manifest points to it.

    Manifests are numbered and never replaced: the highest number is the one that counts, so there is one at any time, and of
    two writers that begin with the same manifest the second fails.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        plain_unions(spark)
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._staged: dict[str, str] = {}

    def _number(self) -> int:
        if not self._fs.exists(self._path(self.root)):
            return -1
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)))
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=-1)

    def manifest(self) -> dict:
        n = self._number()
        if n < 0:
            return {}
        state = json.loads(self.spark.read.text(f"{self.root}/manifest-{n}.json", wholetext=True).first()[0])
        if state["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the projection has the newer schema {state['schema_version']}")
        return state

    def _put(self, state: dict) -> dict:
        n = self._number() + 1
        part = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps({"schema_version": SCHEMA_VERSION} | state).encode()))
        stream.close()
        if not self._fs.rename(part, self._path(f"{self.root}/manifest-{n}.json")):
            self._fs.delete(part, False)
            raise RuntimeError("another run has written the projection")
        return state

    def set_state(self, state: str) -> dict:
        """The manifest with another state; its tables stay."""
        return self._put({"recipe": {}, "tables": {}} | self.manifest() | {"state": state})

    def new_path(self, name: str) -> str:
        return f"{self.root}/{uuid.uuid4().hex}/{name}"

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table that no reader sees before publish, and reads it back."""
        path = self.new_path(name)
        df.write.parquet(path)
        self._staged[name] = path[len(self.root) + 1 :]
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(self, names: Sequence[str], recipe: dict[str, str] | None = None, state: str = "ready") -> dict:
        """All the staged tables named, or none: one manifest points to them and to those that stay."""
        old = self.manifest()
        tables = old.get("tables", {}) | {n: self._staged.pop(n) for n in names}
        return self._put({"state": state, "recipe": old.get("recipe", {}) if recipe is None else recipe, "tables": tables})

    def write(self, tables: dict[str, DataFrame], recipe: dict[str, str] | None = None) -> dict:
        for name, df in tables.items():
            self.stage(name, df)
        return self.publish(list(tables), recipe)

    def read(self, name: str) -> DataFrame:
        tables = self.manifest().get("tables", {})
        if name not in tables:
            raise KeyError(f"no table {name!r} in the projection")
        return self.spark.read.parquet(f"{self.root}/{tables[name]}")


#: Parts of a recipe whose change makes vectors stale.
STALE_KEYS: Sequence[str] = ("chunker", "document_recipe", "model", "dimension")


def stale_models(models: DataFrame, wanted: str) -> DataFrame:
    """One row of (model)s: low, high, and whether any vector is of another model than wanted; no vectors aren't stale."""
    low, high = F.min("model"), F.max("model")
    return models.agg(low.alias("low"), high.alias("high"), F.coalesce((low != wanted) | (high != wanted), F.lit(False)).alias("stale"))


def needs_reembed(stored: dict[str, str], wanted: dict[str, str], n_vectors: int) -> bool:
    return n_vectors > 0 and any(stored.get(k) != wanted.get(k) for k in STALE_KEYS)
