"""Rules over query texts: intent, routing and decomposition, as Column factories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import informative_terms

# Cues of each intent, in order of priority; matched on lower-cased text.
INTENT_CUES = {
    "chronology": r"\b(when|what happened|timeline|history of|chronolog|on \d{4}-\d{2}-\d{2}|last (week|month|session|time)|first (added|introduced|landed)|in what order|sequence of events|changelog|log entry)\b",
    "decision": r"\b(why|decided|decision|rationale|reason(ing)?|chose|chosen|choice|trade-?offs?|justif|instead of|over (using|the alternative)|was (it|this) (picked|selected))\b",
    "current-state": r"\b(current(ly)?|status|state of|where (are|is) .* (at|now|up to)|right now|at the moment|latest|so far|progress|what('s| is) (done|left|implemented|working|blocked|next)|blockers?|remaining|outstanding|how far along|is .* (finished|complete|done|ready))\b",
    "evidence": r"\b(paper|article|transcript|source|according to|what does .* say|quote|cite|citation|evidence|original (text|document)|verbatim|clipping|raw)\b",
}
# Cues of the routing guards and rules, question words, and what parts clauses.
GREETING = r"^\s*(hi|hello|hey|thanks|thank you|ok|okay|cheers|good (morning|evening|night)|yes|no|sure)\b[\s!.]*$"
EXPLICIT = r"\b(in|from|check|search|look up|consult|per|according to) (the |my |our )?(wiki|vault|knowledge ?base|notes)\b"
HISTORY = r"\b(in the log|history|chronolog|what happened on|timeline)\b"
EVIDENCE = r"\b(paper|article|transcript|clipping|raw source|original source|what does the .* say)\b"
PROJECT = r"\bproject[: ]+([A-Za-z0-9][A-Za-z0-9._-]*)"
COMMAND = r"^\s*(run|execute|open|write|create|delete|install|git |ls |cd |cat |edit|fix|refactor|deploy|commit|push)\b"
QUESTION_WORDS = (
    "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "does", "do", "did", "is", "are", "was", "were", "can", "could", "should",
    "would", "will",
)
CLAUSES = (
    r"\s*(?:;|\?\s+(?=\w)|\band also\b|\bas well as\b|\bversus\b|\bvs\.?\b|\bcompared (?:to|with)\b|"
    r"\band (?=(?:how|what|why|when|where|which|who|does|do|is|are|did|can|should)\b))\s*"
)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def intent(text: Column) -> Column:
    low = F.lower(_stripped(text))
    out = F.lit("general")
    for name, cues in reversed(INTENT_CUES.items()):
        out = F.when(low.rlike(cues), name).otherwise(out)
    return out


def project_named(text: Column, known: Sequence[str] = ()) -> Column:
    """The project that a query names, or "": by cue, which must be a known one if any are known, else the first known name in it."""
    cued = F.regexp_extract(text, "(?i)" + PROJECT, 1)
    if not known:
        return cued
    names = F.array(*(F.lit(k) for k in known if k))
    inside = F.filter(names, lambda k: F.contains(F.lower(text), F.lower(k)))
    return F.when(F.array_contains(names, cued), cued).otherwise(F.coalesce(F.try_element_at(inside, F.lit(1)), F.lit("")))


def route(text: Column, default_profile: str = "answer", known_projects: Sequence[str] = ()) -> Column:
    """struct(retrieve, profile, intent, reason, explicit): guards first, then the cue with the highest rank."""
    q = _stripped(text)
    has = lambda pattern: q.rlike("(?i)" + pattern)
    kind, terms = intent(text), informative_terms(q)
    project = project_named(q, known_projects)
    first = F.regexp_replace(F.element_at(F.split(F.lower(q), r"(?U)\s+"), 1), r"^[?,.!]+|[?,.!]+$", "")
    explicit = has(EXPLICIT)

    def to(retrieve: bool, reason, profile=None, says=None) -> Column:
        return F.struct(
            F.lit(retrieve).alias("retrieve"),
            (F.lit(default_profile) if profile is None else profile).alias("profile"),
            kind.alias("intent"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            (F.lit(False) if says is None else says).alias("explicit"),
        )

    return (
        F.when(q == "", to(False, "empty"))
        .when(has(GREETING), to(False, "greeting-or-ack"))
        .when(q.contains("```"), to(False, "contains-code-block"))
        .when(F.length(q) > 2000, to(False, "too-long"))
        .when(terms < 2, to(False, "too-few-terms"))
        .when(has(HISTORY) | (kind == "chronology"), to(True, "chronology-cue", F.lit("history"), explicit))
        .when(has(EVIDENCE) | (kind == "evidence"), to(True, "evidence-cue", F.lit("evidence"), explicit))
        .when(project != "", to(True, F.concat(F.lit("project-cue:"), project), F.concat(F.lit("project:"), project), explicit))
        .when(explicit, to(True, "explicit-wiki-reference", None, F.lit(True)))
        .when(has(COMMAND), to(False, "imperative-command"))
        .when(q.endswith("?") | first.isin(*QUESTION_WORDS) | (kind != "general"), to(True, "question-like"))
        .when(terms >= 6, to(True, "long-informative-statement"))
        .otherwise(to(False, "no-retrieval-cue"))
    )


def decompose(text: Column, max_parts: int = 3) -> Column:
    """The clauses of a compound question that have two terms or more, or the question alone."""
    q = _stripped(text)
    trimmed = F.transform(F.split(q, "(?i)" + CLAUSES), lambda p: F.regexp_replace(p, r"^[ ,.?!]+|[ ,.?!]+$", ""))
    parts = F.filter(trimmed, lambda p: (p != "") & (informative_terms(p) >= 2))
    whole = F.when(q == "", F.array().cast("array<string>")).otherwise(F.array(q))
    return F.when((F.length(q) < 24) | (F.size(parts) < 2), whole).otherwise(F.slice(parts, 1, max_parts))
