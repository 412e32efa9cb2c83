"""Scalar text functions as Column factories; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words without lexical signal.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did",
    "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "this", "that", "these", "those", "it", "its", "as", "at", "by", "from",
    "into", "about", "over", "under", "than", "then", "there", "here", "we", "you", "i", "me", "my", "our", "your", "they", "them", "their", "he",
    "she", "his", "her", "can", "could", "should", "would", "will", "shall", "may", "might", "must", "not", "no", "yes", "if",
)

# The patterns of the parsing rules. (?d) lets only newlines end lines, (?U) widens classes to Unicode.
FENCE = r"(?dms)^```.*?^```"
HEADING = r"(?dm)^(#{1,6})[^\S\n]+([^\n]+?)[^\S\n]*#*[^\S\n]*$"
WIKILINK = r"\[\[([^\[\]\n]+?)\]\]"
TAG = r"(?U)(?:^|\s)#([A-Za-z0-9_\-][A-Za-z0-9_/\-]*)"
TERM = r"(?U)([\w][\w\-./+]*[\w]|[\w])"

_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0].isascii() and unicodedata.normalize("NFD", c)[0].isalpha()]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _ACCENTED]


def fold(text: Column) -> Column:
    """Lower case, Latin letters without diacritics."""
    return F.lower(F.translate(text, "".join(_ACCENTED), "".join(_PLAIN)))


def tokens(text: Column) -> Column:
    """Index tokens: folded maximal runs of letters and digits."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def strip_fences(body: Column) -> Column:
    return F.regexp_replace(body, FENCE, "")


def heading_outline(body: Column) -> Column:
    """[{level, text}] of the headings outside code fences."""
    bare = strip_fences(body)
    marks = F.regexp_extract_all(bare, F.lit(HEADING), F.lit(1))
    names = F.regexp_extract_all(bare, F.lit(HEADING), F.lit(2))
    return F.zip_with(marks, names, lambda m, n: F.struct(F.length(m).alias("level"), n.alias("text")))


def wikilinks(body: Column) -> Column:
    """Distinct trimmed targets in order; code fences are not stripped."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""))


def body_tags(body: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(strip_fences(body), F.lit(TAG), F.lit(1)), F.lower))


def frontmatter_tags(tags: Column) -> Column:
    """Tags of an array column: leading # cut, trimmed, lower-cased, distinct."""
    clean = F.transform(tags, lambda t: F.lower(F.trim(F.regexp_replace(F.trim(t), "^#+", ""))))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def document_title(frontmatter_title: Column, body: Column, path: Column) -> Column:
    """The frontmatter's title, else the first level-one heading, else the file's stem."""
    first = F.regexp_extract(strip_fences(body), r"(?dm)^#[^\S\n]+([^\n]+?)[^\S\n]*#*[^\S\n]*$", 1)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(blank(frontmatter_title), blank(first), stem)


def query_terms(text: Column) -> Column:
    """Terms of a free-form query: joined words, no stopwords, distinct but for case, first spelling kept."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(1)), lambda t: F.regexp_replace(t, r"^[-./+]+|[-./+]+$", ""))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    kept = F.filter(raw, lambda t: (t != "") & ~F.array_contains(stop, F.lower(t)))
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def match_expression(text: Column) -> Column:
    """The terms quoted and joined by OR."""
    return F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def informative_terms(text: Column) -> Column:
    return F.size(query_terms(text))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def embedding_input(title: Column, heading_path: Column, aliases: Column, tags: Column, body: Column) -> Column:
    line = lambda name, arr, sep: F.when(F.size(arr) > 0, F.concat(F.lit(name), F.array_join(arr, sep)))
    head = F.concat_ws(
        "\n", F.concat(F.lit("Title: "), title), line("Heading: ", heading_path, " > "), line("Aliases: ", aliases, ", "), line("Tags: ", tags, ", ")
    )
    return F.concat(head, F.lit("\n\n"), body)


# What a query recipe puts before the query.
QUERY_RECIPES = {
    "query-v1-raw": "",
    "query-v2-bge-instruction": "Represent this sentence for searching relevant passages: ",
}


def query_input(query: Column, recipe: str = "query-v2-bge-instruction") -> Column:
    if recipe not in QUERY_RECIPES:
        raise ValueError(f"no query recipe {recipe!r}; there are {sorted(QUERY_RECIPES)}")
    return F.concat(F.lit(QUERY_RECIPES[recipe]), F.trim(query))


def neutralise(text: Column) -> Column:
    """Text that cannot open or close an excerpt: marker runs become single quotation marks of equal number."""
    cut = F.regexp_replace(text, r"(?i)\[/?excerpt\b[^\]]*\]", "[excerpt-marker-removed]")
    for mark, safe in (("<", "‹"), (">", "›")):
        # any mark with two more beside it
        cut = F.regexp_replace(cut, f"{mark}(?={mark}{mark})|(?<={mark}{mark}){mark}|(?<={mark}){mark}(?={mark})", safe)
    return cut


def truncate(text: Column, max_tokens: Column) -> Column:
    """At most 4 characters a token, cut at a newline, else a space, unless that loses half."""
    limit = (max_tokens * 4).cast("int")
    head = F.left(text, limit)
    line = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    half = F.floor(limit / 2)
    cut = F.when(line >= half, line).when(space >= half, space).otherwise(limit)
    kept = F.regexp_replace(F.left(text, cut.cast("int")), r"(?U)\s+\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(kept, F.lit(" …")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
