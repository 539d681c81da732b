"""Secret scans: patterns for known forms, and a token-efficiency test for random strings.

A tokenizer vocabulary holds the pieces that ordinary text is made of, so ordinary strings have several
characters a token and random ones about two or fewer. Strings of 16 characters or more with a letter are encoded;
those with few characters a token are reported, unless they are known digests (hexadecimal of a digest's length), UUIDs
or part of a span that a pattern has found. Letters alone, and words and numbers joined by signs, are identifiers unless
their parts of letters have still fewer characters a token.

Defined results for odd input: a null text counts as empty and has no spans; rows are judged one by one, so
repeated rows and equal or null doc_id values change nothing; an empty table gives an empty result; other
columns are ignored. A text of any length is searched whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's text is split before encoding.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Strings with fewer characters a token are random.
MOST_CHARS_PER_TOKEN = 2.2
#: The same where letters stand alone or in parts joined by signs, of which names are made, too; with so many letters at least.
MOST_CHARS_PER_TOKEN_OF_LETTERS, LEAST_LETTERS = 2.0, 16
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LETTERS = re.compile(r"[A-Za-z]+")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_IDENTIFIER = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[_/=+-]+(?:[A-Za-z]+|[0-9]+))*[_/=+-]*")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@cache
def encoding(vocabulary: str | bytes):
    """The tokenizer of a vocabulary file's path or content, made once per worker."""
    import tiktoken

    data = Path(vocabulary).read_bytes() if isinstance(vocabulary, str) else vocabulary
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(s: str, vocabulary: str | bytes = VOCABULARY, most: float = MOST_CHARS_PER_TOKEN) -> bool:
    if not _LETTERS.search(s) or _DIGEST.fullmatch(s) or _UUID.fullmatch(s):
        return False
    encode = encoding(vocabulary).encode_ordinary
    if _IDENTIFIER.fullmatch(s):
        parts = _LETTERS.findall(s)
        n = sum(map(len, parts))
        return n >= LEAST_LETTERS and n / sum(len(encode(x)) for x in parts) < MOST_CHARS_PER_TOKEN_OF_LETTERS
    return len(s) / len(encode(s)) < most


def find_spans(text: str, vocabulary: str | bytes = VOCABULARY) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans, each (start, kind number, end), by start, then kind."""
    base = []
    if "=" in text or ":" in text:
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    added = []
    for m in _CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before its end
        if not (before and reach[before - 1] > m.start()) and is_random(m[0], vocabulary):
            added.append((m.start(), 3, m.end()))
    return base, added


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, their digest, all spans.

    The driver reads the vocabulary, a file of fixed size, and sends it to the workers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, added = find_spans(text.as_py() or "", sent.value)
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(told(base).encode()).hexdigest()
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), digest, told(sorted(base + added))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
