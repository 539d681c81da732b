"""Line-oriented markdown parsing: one Arrow crossing a document for cleaning, sections and sub-headings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks that begin at a line and end at a line: how they begin and end, and what is made of them.
_BADGES = (re.compile("<Badges>"), re.compile("</Badges>"))
_LANGUAGE = (re.compile("<LanguageBlock"), re.compile("</LanguageBlock>"))
_CALLOUT = (re.compile(r"::(tip|warning|info|danger|note)(\[.*?\])?\s*$", re.I), re.compile(r"::\s*$"))
_QUOTE = (re.compile(r'<BlockQuote\s+type="(\w+)"(\s+label="([^"]*)")?', re.A), re.compile("</BlockQuote>"))
_IMAGE = re.compile(r"!\[.*\]\(.*\)")
_FENCE = re.compile("```")
_HEADING = re.compile(r"(#{1,3}) (.+)")
_SUBHEADING = re.compile(r"#{2,4}\s+(.+)")
_EDGES = " \t\n\r\x0b\x0c\u00a0\ufeff\u2028\u2029"

SECTIONS = "array<struct<level: int, heading: string, body: string>>"


def _until(lines: Iterator[str], end: re.Pattern) -> Iterator[str]:
    for line in lines:
        if end.match(line):
            return
        yield line


def clean_text(text: str) -> str:
    """Front matter, badges and image lines go, language blocks lose their tags, callouts become quotes.

    The first rule that fits a line wins; an open block runs to the end; fences are not looked at.
    """
    lines = iter(text.split("\n"))
    out: list[str] = []
    head = next(lines)
    if head.strip(_EDGES) == "---":
        for line in lines:
            if line.strip(_EDGES) == "---":
                break
    else:
        lines = iter([head, *lines])
    for line in lines:
        if _BADGES[0].match(line):
            for _ in _until(lines, _BADGES[1]):
                pass
        elif _IMAGE.match(line):
            continue
        elif _LANGUAGE[0].match(line):
            out += [x for x in _until(lines, _LANGUAGE[1]) if x.strip(_EDGES)]
        elif m := _CALLOUT[0].match(line):
            out += [f"> **{(m[2] or '')[1:-1] or m[1]}:**", *(f"> {x}" for x in _until(lines, _CALLOUT[1]))]
        elif m := _QUOTE[0].match(line):
            out += [f"> **{m[3] or m[1]}:**", *(f"> {x}" for x in _until(lines, _QUOTE[1]))]
        else:
            out.append(line)
    return "\n".join(out)


def _outside_fences(text: str) -> Iterator[tuple[str, bool]]:
    """Lines, and whether a heading may be there."""
    inside = False
    for line in text.split("\n"):
        if _FENCE.match(line):
            inside = not inside
            yield line, False
        else:
            yield line, not inside


def sections_of(text: str) -> list[dict]:
    """Sections at #, ## and ###; what is before the first has level 0 and is dropped if empty."""
    out = [{"level": 0, "heading": "", "body": []}]
    for line, free in _outside_fences(text):
        if free and (m := _HEADING.match(line)):
            out.append({"level": len(m[1]), "heading": m[2].strip(_EDGES), "body": []})
        else:
            out[-1]["body"].append(line)
    made = [s | {"body": "\n".join(s["body"]).strip(_EDGES)} for s in out]
    return [s for s in made if s["heading"] or s["body"]]


def subheadings_of(text: str) -> list[str]:
    found = (_SUBHEADING.match(line) for line, free in _outside_fences(text) if free)
    return [m[1].strip(_EDGES) for m in found if m]


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t)).astype(object)

    return run


def clean_markdown(c: Column) -> Column:
    return _udf(clean_text, "string")(c)


def split_sections(c: Column) -> Column:
    return _udf(sections_of, SECTIONS)(c)


def cleaned_sections_of(text: str) -> list[dict]:
    return sections_of(clean_text(text))


def cleaned_sections(c: Column) -> Column:
    """`split_sections` of `clean_markdown` in one crossing."""
    return _udf(cleaned_sections_of, SECTIONS)(c)


def guarded_sections(c: Column, parse: Callable[[str], list[dict]] = cleaned_sections_of) -> Column:
    """(sections, error) of each text: what ``parse`` raises is told, and stops no other text."""

    @F.pandas_udf(f"sections {SECTIONS}, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        sections, errors = [], []
        for t in texts:
            try:
                sections.append(None if t is None else parse(t))
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - any file that fails is to be left aside
                sections.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"sections": pd.Series(sections, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run(c)


def extract_subheadings(c: Column) -> Column:
    return _udf(subheadings_of, "array<string>")(c)
