"""Column functions on paths and chunk texts, all built from Spark's own expressions.

Lengths count code points, but for token estimates, which count UTF-16 units. Null in gives null out unless a
function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import rules

_EDGE = "[\\s\\u00a0\\ufeff]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{_EDGE}+|{_EDGE}+\z", "")


def estimate_tokens(c: Column) -> Column:
    units = F.octet_length(F.encode(c, "UTF-16BE")) / 2
    return F.ceil(units / rules.CHARS_PER_TOKEN).cast("int")


def on_lower(content: Column, f: Callable[[Column], Column]) -> Column:
    """``f(lower(content))``, the lower-cased text made once however often f looks at it."""
    return F.get(F.transform(F.array(F.lower(content)), f), 0)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def base_name(path: Column) -> Column:
    """File name without its last extension; a leading dot begins no extension."""
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]*)?\z", 1)


def extract_version(path: Column) -> Column:
    """v5, v6 or both, by the path."""
    return (
        F.when(path.contains("v5_docs") | path.contains("/v5/"), "v5")
        .when(path.contains("v6_docs") | path.contains("/v6/"), "v6")
        .otherwise("both")
    )


def extract_category(path: Column, content: Column, product: str | None = None) -> Column:
    """By the path, else by the file name, else by the content, else general. A literal map, no join."""
    tiers = [F.when(path.contains(part), F.lit(c)) for part, c in rules.PATH_CATEGORIES]
    names = F.create_map(*[F.lit(x) for pair in rules.FILE_CATEGORY.items() for x in pair])
    name = base_name(path)
    tiers += [
        F.try_element_at(names, name),
        F.try_element_at(names, F.replace(name, F.lit("."), F.lit("-"))),
        F.when(name.contains("-vs-"), F.lit("comparison")),
    ]

    def by_content(lower: Column) -> Column:
        found = [(reduce(or_, map(lower.contains, rules.of_product(words, product))), c) for words, c in rules.CONTENT_CATEGORIES]
        return F.coalesce(*[F.when(hit, F.lit(c)) for hit, c in found])

    return F.coalesce(*tiers, on_lower(content, by_content), F.lit(rules.DEFAULT_CATEGORY))


def extract_tags(content: Column, product: str | None = None, tags: tuple[str, ...] = rules.TAGS) -> Column:
    """The tags that occur in the text, in the list's order."""
    words = rules.of_product(tags, product)
    return on_lower(content, lambda lower: F.array_compact(F.array(*[F.when(lower.contains(t), F.lit(t)) for t in words])))


def extract_code_languages(content: Column, opening_fences_only: bool = False) -> Column:
    """Distinct labels of fences in order; one without a label, as closing ones are, counts as text."""
    labels = F.regexp_extract_all(content, F.lit(r"(?m)^```(\S*)"), F.lit(1))
    if opening_fences_only:
        labels = F.filter(labels, lambda x, i: i % 2 == 0)
    clean = F.transform(labels, lambda x: F.regexp_replace(x, r"\{.*\}", ""))
    return F.array_distinct(F.transform(clean, lambda x: F.when(x == "", F.lit("text")).otherwise(x)))


def has_code(content: Column) -> Column:
    return content.contains("```")


def slugify(title: Column, most: int = 40) -> Column:
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+\z", ""), 1, most)


def branch_name(title: Column, at: Column) -> Column:
    return F.concat(F.lit("docs/contrib/"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), slugify(title))


def redact_tokens(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)token\s+\S+", "token [REDACTED]")


def snippet(content: Column, query: Column, before: int = 60, size: int = 300) -> Column:
    """A piece of the content around the first word of the query that occurs in it."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")
    lower = F.lower(content)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, lower)), lambda i: i > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - before, F.lit(1))
    piece = trimmed(F.substring(content, start, F.lit(size)))
    return F.when(start > 1, F.concat(F.lit("…"), piece)).otherwise(piece)


def human_age(millis: Column) -> Column:
    s = F.floor(millis / 1000)
    return (
        F.when(s < 60, F.concat(s, F.lit("s ago")))
        .when(s < 3600, F.concat(F.floor(s / 60), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h ago")))
        .otherwise(F.concat(F.floor(s / 86400), F.lit("d ago")))
    )


def chunk_id(version: Column, path: Column, index: Column) -> Column:
    return F.concat_ws("-", version, base_name(path), index)


def breadcrumb(title: Column, heading: Column) -> Column:
    return F.when(heading == title, title).otherwise(F.concat_ws(" > ", title, heading))


def _list_line(label: str, items: Column, sep: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, sep)))


def build_content(heading: Column, crumb: Column, subheadings: Column, tags: Column, raw: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), heading),
        F.concat(F.lit("Breadcrumb: "), crumb),
        _list_line("Covers: ", subheadings, " | "),
        _list_line("Topics: ", tags, ", "),
        F.lit(""),
        raw,
    )


def build_embed_text(
    heading: Column, category: Column, crumb: Column, subheadings: Column, tags: Column, code: Column, languages: Column,
    raw: Column, most: int = rules.EMBED_CHARS,
) -> Column:
    """Header lines whole, then as much of the text as fits, cut at a space if one is near the end."""
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), heading),
        F.when(category != "", F.concat(F.lit("Category: "), category)),
        F.when((crumb != "") & (crumb != heading), F.concat(F.lit("Breadcrumb: "), crumb)),
        _list_line("Covers: ", subheadings, " | "),
        _list_line("Topics: ", tags, ", "),
        F.when(code, _list_line("Code: ", languages, ", ")),
        F.lit(""),
    )
    body = F.coalesce(raw, F.lit(""))
    budget = F.greatest(F.lit(0), F.lit(most - 1) - F.length(header))
    cut = F.substring(body, F.lit(1), budget)
    space = F.when(F.instr(F.reverse(cut), " ") > 0, F.length(cut) - F.instr(F.reverse(cut), " ")).otherwise(F.lit(-1))
    short = (F.length(cut) < F.length(body)) & (space > budget * 0.8)
    return trimmed(F.concat(header, F.lit("\n"), F.when(short, F.substring(cut, F.lit(1), space)).otherwise(cut)))
