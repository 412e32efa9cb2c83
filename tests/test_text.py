import pytest
from pyspark.sql import functions as F

from tessera.functions import intent, paths, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("which is the row-group limit", '"row-group" OR "limit"'),
        ('one AND NOT two* (three:four) "five"', '"one" OR "two" OR "three" OR "four" OR "five"'),
        ("Row row ROW", '"Row"'),
        ("the of and", ""),
        (None, ""),
    ],
)
def test_match_expression(spark, query, expected):
    assert one(spark, query, text.match_expression) == expected


def test_tokens_fold(spark):
    assert one(spark, "Éclair NAÏVE", text.tokens) == ["eclair", "naive"]


def test_outline_skips_fences(spark):
    body = "# T\n```\n# no\n```\n## A b ##\ntext\n#no"
    assert [(r["level"], r["text"]) for r in one(spark, body, text.heading_outline)] == [(1, "T"), (2, "A b")]


def test_links_and_tags(spark):
    assert one(spark, "[[a]] [[ b|c ]] [[a]] ```\n[[d#e]]\n```", text.wikilinks) == ["a", "b|c", "d#e"]
    assert one(spark, "#One two #one/x\n# Heading\n#three", text.body_tags) == ["one", "one/x", "three"]


@pytest.mark.parametrize(("value", "expected"), [("a <<<< b >>> <<", "a ‹‹‹‹ b ››› <<"), ("[/excerpt 3] x", "[excerpt-marker-removed] x"), ("<< >>", "<< >>")])
def test_neutralise(spark, value, expected):
    assert one(spark, value, text.neutralise) == expected


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("Clippings/ideas/lamp.md", ("clipping", "idea", None, False)),
        ("shopping.md", ("operational", "operational", None, False)),
        ("raw/papers/columns.md", ("raw", "evidence", None, False)),
        ("wiki/harbour.md", ("wiki", "durable", None, False)),
        ("wiki/index-boats.md", ("wiki", "route-map", None, True)),
        ("wiki/log.md", ("wiki", "log", None, False)),
        ("wiki/projects/quay/current-state.md", ("wiki", "current-state", "quay", False)),
        ("wiki/projects/quay/decisions.md", ("wiki", "decision", "quay", False)),
        ("wiki/projects/quay/index.md", ("wiki", "route-map", "quay", False)),
        ("wiki/projects/quay/notes.md", ("wiki", "project", "quay", False)),
    ],
)
def test_classify(spark, path, expected):
    assert tuple(one(spark, path, paths.classify)) == expected


@pytest.mark.parametrize(
    ("raw", "key", "hint"),
    [("side-note", "side-note", None), ("projects/quay/X#S|t", "x", "projects/quay/x"), ("/a/b.md", "b", "a/b"), ("|x", "", None)],
)
def test_link_target(spark, raw, key, hint):
    assert tuple(one(spark, raw, paths.link_target)) == (key, hint)


def test_profiles_reject_unknown():
    for bad in ("project:", "nothing"):
        with pytest.raises(ValueError):
            paths.in_profile(bad)


@pytest.mark.parametrize(
    ("query", "retrieve", "reason"),
    [
        ("", False, "empty"),
        ("thanks!", False, "greeting-or-ack"),
        ("see ```x``` here", False, "contains-code-block"),
        ("why was parquet picked instead of avro", True, "question-like"),
        ("what happened on 2025-02-11 after lunch", True, "chronology-cue"),
        ("quote the article about tides", True, "evidence-cue"),
        ("project: quay crane layout", True, "project-cue:quay"),
        ("look up the tide tables in our notes", True, "explicit-wiki-reference"),
        ("delete the stale branches", False, "imperative-command"),
        ("north south east west up down", True, "long-informative-statement"),
        ("north south", False, "no-retrieval-cue"),
    ],
)
def test_route(spark, query, retrieve, reason):
    r = one(spark, query, intent.route)
    assert (r["retrieve"], r["reason"]) == (retrieve, reason)


def test_decompose(spark):
    q = "how do cranes turn around; which berth is the deepest one"
    assert one(spark, q, intent.decompose) == ["how do cranes turn around", "which berth is the deepest one"]
    assert one(spark, "short one", intent.decompose) == ["short one"]
    assert one(spark, "", intent.decompose) == []


def test_known_projects(spark):
    r = one(spark, "layout of the Quay cranes today", lambda c: intent.route(c, known_projects=("barge", "quay")))
    assert (r["reason"], r["profile"]) == ("project-cue:quay", "project:quay")
    assert one(spark, "project: other crane layout", lambda c: intent.route(c, known_projects=("barge",)))["reason"] != "project-cue:other"


def test_truncate_strips_what_it_leaves(spark):
    assert one(spark, "abc def \n\t\nxyz" + "z" * 20, lambda c: text.truncate(c, F.lit(3))) == "abc def …"
