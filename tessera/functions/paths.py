"""Classification of document paths, retrieval profiles and link targets, as Column factories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page roles that a project's file names stand for; any other is `project`.
PROJECT_ROLES = {"current-state": "current-state", "decisions": "decision", "index": "route-map", "log": "log"}
META = ("source_kind", "page_role", "project_id", "is_route_map")


def skipped(path: Column, ignored_dirs: Sequence[str] = (), ignored_globs: Sequence[str] = ()) -> Column:
    """Whether a relative path lies in an ignored or hidden folder, or matches a glob."""
    names = F.array(*(F.lit(d) for d in ignored_dirs)).cast("array<string>")
    out = F.exists(F.split(path, "/"), lambda p: F.array_contains(names, p) | p.startswith("."))
    for glob in ignored_globs:
        pattern = "".join({"*": ".*", "?": "."}.get(c, f"\\Q{c}\\E") for c in glob)
        out = out | path.rlike(f"(?s)^{pattern}$")
    return out


def classify(path: Column) -> Column:
    """struct(source_kind, page_role, project_id, is_route_map) of a path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    stem = F.regexp_replace(name, r"\.md$", "")
    top, second = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    project = (top == "wiki") & (second == "projects") & (F.size(parts) >= 4)
    role = F.lit("project")
    for key, value in PROJECT_ROLES.items():
        role = F.when(stem == key, value).otherwise(role)
    index = (top == "wiki") & ~project & (path != "wiki/log.md") & name.startswith("index")
    kind = F.when(top == "raw", "raw").when(top == "Clippings", "clipping").when(top == "wiki", "wiki").otherwise("operational")
    page_role = (
        F.when(top == "raw", "evidence")
        .when((top == "Clippings") & (second == "ideas"), "idea")
        .when(top == "Clippings", "evidence")
        .when(project, role)
        .when(path == "wiki/log.md", "log")
        .when(index, "route-map")
        .when(top == "wiki", "durable")
        .otherwise("operational")
    )
    return F.struct(
        kind.alias("source_kind"),
        page_role.alias("page_role"),
        F.when(project, F.try_element_at(parts, F.lit(3))).alias("project_id"),
        index.alias("is_route_map"),
    )


def in_profile(profile: str) -> Column:
    """The predicate of a retrieval profile over source_kind, page_role and project_id."""
    kind, role = F.col("source_kind"), F.col("page_role")
    knowledge = (kind == "wiki") & ~role.isin("log", "route-map")
    simple = {
        "answer": knowledge,
        "evidence": kind.isin("raw", "clipping"),
        "history": (kind == "wiki") & (role == "log"),
        "current": (kind == "wiki") & (role == "current-state"),
        "all": F.lit(True),
    }
    if profile in simple:
        return simple[profile]
    head, _, wanted = profile.partition(":")
    if head == "project" and wanted:
        return knowledge & F.col("project_id").eqNullSafe(F.lit(wanted))
    raise ValueError("a profile is answer, evidence, history, current, all or project:<id>")


def updated_between(low: int | None, high: int | None) -> Column:
    """Both ends included; a missing stamp counts as 0."""
    stamp = F.coalesce(F.col("updated_at_ns"), F.lit(0))
    out = F.lit(True)
    if low is not None:
        out = out & (stamp >= low)
    return out & (stamp <= high) if high is not None else out


def link_target(raw: Column) -> Column:
    """struct(key, hint) of a raw link target; an empty key means no target."""
    bare = F.trim(F.substring_index(F.substring_index(raw, "|", 1), "#", 1))
    path = F.regexp_replace(F.regexp_replace(bare, r"\.md$", ""), "^/+|/+$", "")
    key = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.struct(key.alias("key"), F.when(path.contains("/"), F.lower(path)).alias("hint"))


def authority_class() -> Column:
    """The authority class of source_kind, page_role and is_route_map."""
    kind, role = F.col("source_kind"), F.col("page_role")
    return (
        F.when(kind.isin("raw", "clipping"), F.when(role == "idea", "idea").otherwise("evidence"))
        .when(F.col("is_route_map") | (role == "route-map"), "route-map")
        .when(role.isin("current-state", "decision", "log", "project"), role)
        .otherwise("durable")
    )
