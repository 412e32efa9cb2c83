"""The link graph: targets, resolution, neighbours, mentions, communities, related pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import in_profile, link_target
from tessera.functions.text import informative_terms
from tessera.operators.parts import connected_parts
from tessera.sources.working import materialised

# Names too general to be a mention.
GENERIC_KEYS = (
    "index", "log", "plan", "brief", "context", "questions", "decisions", "current-state", "next-actions", "architecture", "readme", "notes", "todo",
    "summary", "overview",
)
MAX_MENTION_ROWS, MAX_MENTION_DOCS = 400, 40


def link_rows(docs: DataFrame) -> DataFrame:
    """(source, target_text, key, hint): one row per distinct raw target of a document (document_id, wikilinks)."""
    raw = docs.select(F.col("document_id").alias("source"), F.explode("wikilinks").alias("target_text")).distinct()
    return raw.withColumn("t", link_target(F.col("target_text"))).where("t.key <> ''").select("source", "target_text", "t.key", "t.hint")


def link_keys(docs: DataFrame) -> DataFrame:
    """(document_id, key): the lower stem of the path, and lower aliases."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    names = F.concat(F.array(stem), F.transform("aliases", F.lower)) if "aliases" in docs.columns else F.array(stem)
    return docs.select("document_id", F.explode(names).alias("key")).where("key <> ''").distinct()


def _joined(folder, hint):
    """A hint relative to its page's folder, lower-cased, with `.` and `..` resolved; `..` at the top stays."""
    steps = F.filter(F.split(F.concat_ws("/", F.when(folder != "", folder), hint), "/"), lambda p: (p != "") & (p != "."))
    back = F.lit("..")
    take = lambda done, step: F.when(
        (step == back) & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != back), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    ).otherwise(F.concat(done, F.array(step)))
    return F.lower(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), take), "/"))


def resolve_links(links: DataFrame, docs: DataFrame, only_unresolved: bool = False) -> DataFrame:
    """links (link_id, source, key, hint) with target (document id or null).

    By hint: the path relative to the source's folder, then from the root, then the shortest path that ends with it. Else
    by key: of other documents with it, one in the same folder, then one of the same project, then the lowest id.
    With only_unresolved, links whose `target` is set stay as they are.

    All are equi-joins. A key may be the name of a tenth of the documents, so a link doesn't meet them all: the two lowest
    ids (one may be the source itself) of each (key, folder), (key, project) and key are what three joins meet.
    Suffixes of paths are exploded, as many as a path has parts, for hints only.
    """
    if only_unresolved:
        done = links.where("target is not null")
        return done.unionByName(resolve_links(links.where("target is null").drop("target"), docs).select(*links.columns))
    path = F.lower(F.regexp_replace("path", r"\.md$", ""))
    folder = F.lower(F.regexp_replace("path", "/?[^/]*$", ""))
    info = docs.select("document_id", path.alias("full"), folder.alias("folder"), "project_id")
    origin = info.select(F.col("document_id").alias("source"), F.col("folder").alias("from_folder"), F.col("project_id").alias("from_project"))
    rows = links.join(origin, "source", "left")

    bare = F.regexp_replace("hint", "^/+|/+$", "")
    hinted = rows.where("hint is not null and hint <> ''").select("link_id", F.lower(bare).alias("tail"), _joined(F.col("from_folder"), F.col("hint")).alias("near"))
    wanted = hinted.select("link_id", F.posexplode(F.array("near", "tail")).alias("turn", "full"))
    exact = wanted.join(info.select("full", "document_id"), "full").select("link_id", "turn", F.lit(0).alias("far"), "document_id")
    parts = F.split("full", "/")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    shortest = F.min(F.struct(F.length("full").alias("far"), "document_id")).alias("best")
    tails = info.select("document_id", "full", F.explode(ends).alias("tail")).where("tail <> ''").groupBy("tail").agg(shortest)
    ending = hinted.join(tails, "tail").select("link_id", F.lit(2).alias("turn"), "best.far", "best.document_id")
    by_hint = exact.unionByName(ending).groupBy("link_id").agg(F.min(F.struct("turn", "far", "document_id"))["document_id"].alias("hinted"))

    named = link_keys(docs).join(info.select("document_id", "folder", "project_id"), "document_id")

    def lowest(*by: str) -> DataFrame:
        """The lowest two documents of each group, by two partial minima."""
        first = named.groupBy(*by).agg(F.min("document_id").alias("one"))
        second = named.join(first, list(by)).where("document_id > one").groupBy(*by).agg(F.min("document_id").alias("two"))
        return first.join(second, list(by), "left")

    def pick(one, two):
        return F.when(F.col(one) != F.col("source"), F.col(one)).otherwise(F.col(two))

    asked = rows.select("link_id", "key", "source", "from_folder", "from_project")
    ways = (
        (lowest("key", "folder").withColumnRenamed("folder", "from_folder"), ["key", "from_folder"], "folder"),
        (lowest("key", "project_id").where("project_id is not null").withColumnRenamed("project_id", "from_project"), ["key", "from_project"], "project"),
        (lowest("key"), ["key"], "any"),
    )
    for table, on, name in ways:
        table = table.withColumnsRenamed({"one": f"{name}_one", "two": f"{name}_two"})
        asked = asked.join(table, on, "left")
    by_key = asked.select("link_id", F.coalesce(*(pick(f"{n}_one", f"{n}_two") for _, _, n in ways)).alias("named"))
    out = links.join(by_hint, "link_id", "left").join(by_key, "link_id", "left")
    return out.withColumn("target", F.coalesce("hinted", "named")).drop("hinted", "named")


def neighbours(links: DataFrame, seeds: DataFrame, hops: int = 1, max_nodes: int = 50, direction: str = "both") -> DataFrame:
    """(query_id, document_id, hop, turn) reachable from seeds (query_id, document_id) by resolved links (source, target).

    At each hop outgoing neighbours in order of id come before incoming ones; a query takes max_nodes at most. Seeds and
    what was found before are left out, so cycles end.
    """
    edges = links.where("target is not null").select("source", "target").distinct()
    ways = []
    if direction in ("out", "both"):
        ways.append(edges.select(F.col("source").alias("document_id"), F.col("target").alias("to"), F.lit(0).alias("way")))
    if direction in ("in", "both"):
        ways.append(edges.select(F.col("target").alias("document_id"), F.col("source").alias("to"), F.lit(1).alias("way")))
    steps = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    seen = seeds.select("query_id", "document_id", F.lit(0).alias("hop"), F.lit(0).alias("turn")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        reached = front.select("query_id", "document_id").join(steps, "document_id").groupBy("query_id", "to").agg(F.min("way").alias("way"))
        reached = reached.withColumnRenamed("to", "document_id").join(seen.select("query_id", "document_id"), ["query_id", "document_id"], "left_anti")
        used = seen.where("hop > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("used"))
        order = Window.partitionBy("query_id").orderBy("way", "document_id")
        front = (
            reached.join(used, "query_id", "left")
            .withColumn("turn", F.row_number().over(order) + F.coalesce("used", F.lit(0)))
            .where(F.col("turn") <= max_nodes)
            .select("query_id", "document_id", F.lit(hop).alias("hop"), "turn")
        )
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def project_scope(docs: DataFrame, links: DataFrame, project: str, hops: int = 1, max_linked: int = 40) -> DataFrame:
    """(document_id): a project's pages and the curated pages they link to; the cap comes before the filter."""
    own = docs.where(in_profile(f"project:{project}")).select("document_id")
    near = neighbours(links, own.select(F.lit(0).alias("query_id"), "document_id"), hops, max_linked, "out")
    curated = docs.where(in_profile("answer")).select("document_id")
    return own.unionByName(near.select("document_id").join(curated, "document_id", "left_semi")).distinct()


def mention_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(document_id, phrase): titles and keys distinctive enough to look for, lower-cased."""
    pages = docs.where(in_profile("answer")).select("document_id", "title").join(keys, "document_id")
    rows = pages.select("document_id", F.explode(F.array("title", F.translate("key", "-", " "))).alias("p")).select("document_id", F.trim("p").alias("phrase"))
    terms = informative_terms(F.col("phrase"))
    low = F.lower("phrase")
    good = (F.length("phrase") >= 5) & ~low.isin(*GENERIC_KEYS) & (terms > 0) & ~((terms == 1) & (F.length("phrase") < 8))
    return rows.where(good).select("document_id", low.alias("phrase")).distinct()


def mentions(found: DataFrame, keys: DataFrame, owner: DataFrame) -> DataFrame:
    """(chunk_id, document_id) from phrase occurrences (id, phrase), mention keys with normalised `phrase`, and owner
    (id, owner_id) of chunks: other documents' chunks, the first MAX_MENTION_ROWS by id, unless over MAX_MENTION_DOCS documents.

    A phrase may be the key of a tenth of the documents and stand in all chunks, so these never meet: a phrase's first
    MAX_MENTION_ROWS chunks are among those of each of its keys but for the key's own. With over MAX_MENTION_DOCS + 1 owners it is too
    wide for every key. Else a key meets those chunks; one that owns some of them, where more follow, all chunks of its phrase: such keys are
    MAX_MENTION_DOCS + 1 at most for a phrase.
    """
    keys = keys.select("document_id", "phrase").distinct()
    said = materialised(found.select("id", "phrase").join(owner.select("id", "owner_id"), "id"), "said")
    head = said.withColumn("turn", F.row_number().over(Window.partitionBy("phrase").orderBy("id"))).where(F.col("turn") <= MAX_MENTION_ROWS)
    head = materialised(head.select("phrase", "id", "owner_id"), "said_first")
    sizes = head.groupBy("phrase").agg(F.countDistinct("owner_id").alias("owners"), (F.count(F.lit(1)) == MAX_MENTION_ROWS).alias("full"))
    near = head.join(sizes.where(F.col("owners") <= MAX_MENTION_DOCS + 1), "phrase").join(keys, "phrase")
    near = materialised(near.select("document_id", "phrase", "id", "owner_id", "full"), "met")
    owns = near.where("full and owner_id = document_id").select("document_id", "phrase").distinct()
    further = said.join(owns, "phrase").select("document_id", "phrase", "id", "owner_id")
    hits = near.join(owns, ["document_id", "phrase"], "left_anti").drop("full").unionByName(further).where("owner_id <> document_id")
    order = Window.partitionBy("document_id", "phrase").orderBy("id")
    first = hits.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= MAX_MENTION_ROWS)
    wide = first.groupBy("document_id", "phrase").agg(F.countDistinct("owner_id").alias("docs")).where(F.col("docs") > MAX_MENTION_DOCS)
    return first.join(wide, ["document_id", "phrase"], "left_anti").select(F.col("id").alias("chunk_id"), "document_id").distinct()


def community_edges(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b), both directions: resolved links between pages that aren't hubs."""
    hubs = docs.where("is_route_map or page_role = 'route-map'").select("document_id")
    ends = links.where("target is not null and target <> source").select("source", "target")
    ends = ends.join(hubs.withColumnRenamed("document_id", "source"), "source", "left_anti")
    ends = ends.join(hubs.withColumnRenamed("document_id", "target"), "target", "left_anti")
    one = ends.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


#: Sweeps of label propagation at most, and edges of a part that one task settles.
SWEEPS = 20


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Label propagation within one connected part: pages in order of id take their neighbours' most frequent label, ties the lowest."""
    pages, at = np.unique(pdf["a"].to_numpy(), return_inverse=True)
    to = np.searchsorted(pages, pdf["b"].to_numpy())
    order = np.argsort(at, kind="stable")
    near, first = to[order], np.searchsorted(at[order], np.arange(len(pages) + 1))
    label = np.arange(len(pages))
    for _ in range(SWEEPS):
        moved = False
        for n in range(len(pages)):
            votes = np.sort(label[near[first[n] : first[n + 1]]])
            begins = np.flatnonzero(np.append(True, votes[1:] != votes[:-1]))
            best = votes[begins[np.argmax(np.diff(np.append(begins, len(votes))))]]
            moved |= bool(best != label[n])
            label[n] = best
        if not moved:
            break
    # a community goes by its lowest page
    _, lowest, of = np.unique(label, return_index=True, return_inverse=True)
    return pd.DataFrame({"document_id": pages, "community_id": pages[lowest[of]]})


def communities(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, community_id) by label propagation in order of id, SWEEPS sweeps at most.

    Labels never cross connected parts, so parts are found first, in logarithmic rounds whatever their diameter, and
    settled apart, each in a task; a page without links is its own community. The order of pages within a part is what the rule
    says, so a part is one task's work: it holds two longs an edge and one a page, and a sweep costs its edges.
    """
    edges = community_edges(links, docs)
    part = connected_parts(edges)
    settled = edges.join(part.withColumnRenamed("node", "a"), "a").groupBy("part").applyInPandas(_settle, "document_id long, community_id long")
    return docs.select("document_id").join(settled, "document_id", "left").select("document_id", F.coalesce("community_id", "document_id").alias("community_id"))


def related_pages(seeds: DataFrame, links: DataFrame, mention: DataFrame, chunk_owner: DataFrame, community: DataFrame, limit: int = 10) -> DataFrame:
    """(seed, document_id, weight, relation, rank): pages related to each seed.

    Weights: a link row to the page 3, from it 2, a mention of it 2, by it 1, same community 1 (200 lowest ids).
    """
    named = mention.select("chunk_id", F.col("document_id").alias("about")).join(chunk_owner.select(F.col("id").alias("chunk_id"), F.col("owner_id").alias("by")), "chunk_id").select("about", "by").distinct()
    s = seeds.select(F.col("document_id").alias("seed"))
    resolved = links.where("target is not null")
    group = community.join(s, community["document_id"] == s["seed"]).select("seed", "community_id")
    # the first 201 of a community hold the first 200 beside any seed, so seeds don't meet whole communities
    lowest = community.withColumn("turn", F.row_number().over(Window.partitionBy("community_id").orderBy("document_id"))).where("turn <= 201").drop("turn")
    same = group.join(lowest, "community_id").where("document_id <> seed")
    order = Window.partitionBy("seed").orderBy("document_id")
    same = same.withColumn("turn", F.row_number().over(order)).where("turn <= 200")
    ways = [
        (resolved.join(s, resolved["source"] == s["seed"]).select("seed", F.col("target").alias("document_id")), 3, "links-to"),
        (resolved.join(s, resolved["target"] == s["seed"]).select("seed", F.col("source").alias("document_id")), 2, "linked-from"),
        (named.join(s, named["by"] == s["seed"]).select("seed", F.col("about").alias("document_id")), 2, "mentions"),
        (named.join(s, named["about"] == s["seed"]).select("seed", F.col("by").alias("document_id")), 1, "mentioned-in"),
        (same.select("seed", "document_id"), 1, "same-community"),
    ]
    rows = None
    for df, weight, relation in ways:
        part = df.where("document_id <> seed").select("seed", "document_id", F.lit(weight).alias("w"), F.lit(relation).alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    found = rows.groupBy("seed", "document_id").agg(F.sum("w").alias("weight"), F.max(F.struct("w", "r"))["r"].alias("relation"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("weight").desc(), "document_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def community_summary(community: DataFrame, docs: DataFrame, top: int = 10) -> DataFrame:
    """(community_id, size, titles): the largest communities with the titles of their five lowest ids."""
    sizes = community.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "community_id").limit(top)
    rows = community.join(F.broadcast(sizes), "community_id").join(docs.select("document_id", "title"), "document_id")
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy("community_id").orderBy("document_id"))).where("turn <= 5")
    return first.groupBy("community_id", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "title"))), lambda x: x["title"]).alias("titles"))
