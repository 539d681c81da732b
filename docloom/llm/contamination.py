"""Benchmark decontamination by a BM25 inverted index of test items with block-max pruning.

Test items are indexed once: for each term its items with their BM25 impact, divided by the score of the item
against itself, and for each block of items the greatest impact. Every training passage is a query: a
document is read in windows of twice the longest item, half overlapping, so an item of a document lies
whole in a window. As in block-max WAND, a passage is skipped if the sum of its terms' greatest impacts stays below the
threshold; else the blocks whose own sums reach it are scored, item by item. Bounds and scores
are computed for many passages at once. Each item so found is verified: question and answer, the item's last sentence,
must both be covered, at least by half, by five-word runs that the document has too.

Words are runs of bytes other than ASCII white space and punctuation, A-Z as a-z.

Only items are broadcast, in parts of PART_TOKENS words; more items are more parts, and a pass over the documents each.

Defined results for odd input: an empty or null text has no passages and an item without words is in no document;
an item of fewer than five words is one run; equal items, and repeated rows, are each reported; null ids are
carried; empty tables give an empty result, or the documents as they are; `decontaminated` keeps all columns whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkernel as tk
from docloom.llm.shared import written

K1, B = 1.2, 0.75
#: Least share of an item's own score, and least covered shares of question and answer.
LEAST_SCORE, LEAST_OVERLAP = 0.5, 0.5
RUN = 5
BLOCK = 16
PART_TOKENS = 500_000
#: Postings that are looked at together.
HELD = 1 << 18

_WORD = tk.FOLDED.copy()
_WORD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_SENTENCE = re.compile(r"[.!?]\s+|\n+")


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tk.word_hashes(_WORD[raw], offsets, seed=3)


@dataclass
class Index:
    """CSR arrays over sorted terms; items are numbered from 0."""

    terms: np.ndarray
    most: np.ndarray  # the greatest impact of each term
    at: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_at: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray
    runs: list[np.ndarray]
    words: list[int]
    question: list[int]  # words before the answer
    ids: list[int | None]
    longest: int

    @cached_property
    def short(self) -> list[int]:
        """Lengths of items that are shorter than a run."""
        return sorted({w for w in self.words if 0 < w < RUN})


def build_index(
    ids: list, tokens: list[np.ndarray], question: list[int], df: dict[int, int], n: int, mean: float, longest: int
) -> Index:
    term, item, impact = [], [], []
    for k, words in enumerate(tokens):
        t, tf = np.unique(words, return_counts=True)
        d = np.array([df[x] for x in t.tolist()], float)
        w = np.log1p((n - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / max(mean, 1)))
        term.append(t)
        item.append(np.full(len(t), k))
        impact.append(w / w.sum() if len(w) else w)
    t, i, w = (np.concatenate(x) if x else np.zeros(0) for x in (term, item, impact))
    order = np.lexsort((i, t))
    t, i, w = t[order], i[order].astype(np.int64), w[order]
    terms, at = np.unique(t, return_index=True)
    change = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (i[1:] // BLOCK != i[:-1] // BLOCK)]) if len(t) else np.zeros(0, np.int64)
    return Index(
        terms,
        np.maximum.reduceat(w, at) if len(t) else w,
        np.r_[at, len(t)],
        i,
        w,
        np.r_[np.searchsorted(change, at), len(change)],
        i[change] // BLOCK,
        np.maximum.reduceat(w, change) if len(t) else w,
        [tk.shingle_hashes(x, np.array([0, len(x)]), RUN)[0] for x in tokens],
        [len(x) for x in tokens],
        question,
        ids,
        longest,
    )


def _spread(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For CSR offsets and rows: the entries of each row, and which of ``rows`` each belongs to."""
    counts = at[rows + 1] - at[rows]
    own = np.repeat(np.arange(len(rows)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + at[rows][own], own


def _passages(index: Index, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term number) pairs of known terms, sorted, and each passage's document."""
    step = index.longest
    known = np.minimum(np.searchsorted(index.terms, words), max(len(index.terms) - 1, 0))
    hit = np.flatnonzero(index.terms[known] == words) if len(index.terms) else np.zeros(0, np.int64)
    doc = np.searchsorted(bounds, hit, "right") - 1
    counts = np.maximum(-(-np.diff(bounds) // step), 1)  # a window begins at each step of a document
    begin = np.r_[0, np.cumsum(counts)]
    window = begin[doc] + (hit - bounds[doc]) // step
    # A word is in the window that begins at its step and in the one before.
    before = window > begin[doc]
    pairs = np.r_[window, window[before] - 1] * len(index.terms) + np.r_[known[hit], known[hit][before]]
    pairs = np.unique(pairs)
    return pairs // max(len(index.terms), 1), pairs % max(len(index.terms), 1), np.repeat(np.arange(len(counts)), counts)


def candidates(index: Index, words: np.ndarray, bounds: np.ndarray, least: float = LEAST_SCORE) -> dict[tuple[int, int], float]:
    """(document, item) -> the best score of its passages, for all that reach ``least``."""
    passage, term, doc = _passages(index, words, bounds)
    slack = least - 1e-9
    total = np.bincount(passage, index.most[term], len(doc))
    stay = total[passage] >= slack
    passage, term = passage[stay], term[stay]
    found: dict[tuple[int, int], float] = {}
    if not len(passage):
        return found
    # A piece of passages has HELD postings, or is one passage, which has no more than the part of the index.
    postings = np.cumsum(index.at[term + 1] - index.at[term])
    piece = np.maximum.accumulate(np.where(np.r_[True, passage[1:] != passage[:-1]], postings // HELD, 0))
    cuts = np.r_[np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]), len(piece)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        for k, s in _scored(index, passage[i:j], term[i:j], slack):
            pair = (int(doc[k // len(index.ids)]), k % len(index.ids))
            found[pair] = max(found.get(pair, 0.0), s)
    return found


def _scored(index: Index, passage: np.ndarray, term: np.ndarray, slack: float) -> Iterator[tuple[int, float]]:
    """(passage * items + item, score) of those that reach ``slack``; only blocks whose bounds do are looked into."""
    blocks, n = int(index.blocks.max()) + 1, len(index.ids)
    e, own = _spread(index.block_at, term)
    key, back = np.unique(passage[own] * blocks + index.blocks[e], return_inverse=True)
    open_blocks = key[np.bincount(back, index.block_most[e]) >= slack]
    stay = np.isin(passage, open_blocks // blocks)
    passage, term = passage[stay], term[stay]
    e, own = _spread(index.at, term)
    stay = np.isin(passage[own] * blocks + index.items[e] // BLOCK, open_blocks)
    e, own = e[stay], own[stay]
    key, back = np.unique(passage[own] * n + index.items[e], return_inverse=True)
    score = np.bincount(back, index.impacts[e])
    yield from zip(key[score >= slack].tolist(), score[score >= slack].tolist(), strict=True)


def overlaps(index: Index, item: int, runs: np.ndarray) -> tuple[float, float]:
    """Shares of the words of question and answer that runs of the document cover."""
    n, q = index.words[item], index.question[item]
    covered = np.zeros(n, bool)
    for k in np.flatnonzero(np.isin(index.runs[item], runs)):
        covered[k : k + RUN] = True
    whole = float(covered.mean()) if n else 0.0
    return (float(covered[:q].mean()) if q else whole), (float(covered[q:].mean()) if q < n else whole)


def matches(index: Index, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """(document, item, score, question overlap, answer overlap) for the verified ones."""
    words, bounds = _words(raw, offsets)
    last, runs = -1, np.zeros(0, tk.U)
    for (doc, item), score in sorted(candidates(index, words, bounds).items()):
        if doc != last:
            own = words[bounds[doc] : bounds[doc + 1]]
            last, runs = doc, tk.shingle_hashes(own, np.array([0, len(own)]), RUN)[0]
            for w in index.short:  # items shorter than a run, at any place: each w words in a row as a text of their own
                if len(own) >= w:
                    places = np.lib.stride_tricks.sliding_window_view(own, w)
                    runs = np.concatenate([runs, tk.shingle_hashes(places.ravel(), np.arange(len(places) + 1) * w, RUN)[0]])
        q, a = overlaps(index, item, runs)
        if q >= LEAST_OVERLAP and a >= LEAST_OVERLAP:
            yield doc, item, score, q, a


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tk.text_bytes(batch.column(1))
        words, bounds = _words(raw, offsets)
        question = []
        for k in range(batch.num_rows):
            text = raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace").strip()
            ends = [m.end() for m in _SENTENCE.finditer(text)]
            head = np.frombuffer(text[: ends[-1]].encode(), np.uint8) if ends else np.zeros(0, np.uint8)
            question.append(int(_words(head, np.array([0, len(head)]))[1][-1]))
        tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(question, pa.int64())], ["item_id", "tokens", "question"])


def indexes(items: DataFrame) -> Iterator[Index]:
    """An index for each part of the items; statistics are those of all items."""
    read = written(
        items.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_rows, "item_id long, tokens array<long>, question long")
    )
    size = F.size("tokens")
    n, total, longest = read.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    df = read.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = -(-total // PART_TOKENS)
    part = F.pmod(F.xxhash64("item_id", "tokens"), F.lit(max(parts, 1)))
    for p in range(parts):
        mine = read.filter(part == p)
        own = mine.select(F.explode("tokens").alias("term")).distinct()
        counts = {r["term"] & ((1 << 64) - 1): r["df"] for r in df.join(own, "term", "left_semi").toLocalIterator()}
        rows = sorted(mine.toLocalIterator(), key=lambda r: (r["item_id"] is None, r["item_id"], r["tokens"]))
        yield build_index(
            [r["item_id"] for r in rows],
            [np.array(r["tokens"], np.int64).astype(tk.U) for r in rows],
            [r["question"] for r in rows],
            counts,
            n,
            total / n,
            max(longest, 1),
        )


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = tk.text_bytes(batch.column(1))
                for i, j in tk.parts(offsets):
                    found = list(matches(shared.value, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                    doc, item, score, q, a = zip(*found, strict=True) if found else ((),) * 5
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i + k for k in doc], pa.int64())),
                         pa.array([shared.value.ids[k] for k in item], pa.int64())]
                        + [pa.array(x, pa.float64()) for x in (score, q, a)],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item is found."""
    for index in indexes(items):
        shared, text = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, text=text) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = tk.text_bytes(batch.column(text))
                clean = np.ones(batch.num_rows, bool)
                for i, j in tk.parts(offsets):
                    clean[[i + m[0] for m in matches(shared.value, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("score", F.round("score", 9))


def _sql_words(text: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        rf"regexp_extract_all(translate(coalesce({text}, ''), '{letters}', '{letters.lower()}'),"
        r" '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+')"
    )


_QUESTION = r"regexp_extract(t, '(?s)^.*(?:[.!?]\s+|\n+)')"

#: Every item scored against every passage that has one of its words.
SQL = rf"""WITH b AS (SELECT item_id, row_number() OVER () AS k, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM benchmark),
i AS (SELECT k, item_id, {_sql_words("t")} AS w, len({_sql_words(_QUESTION)}) AS q FROM b),
m AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1) AS mean, greatest(max(len(w)), 1) AS step FROM i),
f AS (SELECT k, x, count(*) AS tf FROM (SELECT k, unnest(w) AS x FROM i) GROUP BY k, x),
e AS (SELECT x, count(*) AS df FROM f GROUP BY x),
h AS (SELECT k, x, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2 / (tf + 1.2::DOUBLE * (0.25 + 0.75 * len(w) / mean)) AS s
  FROM f JOIN e USING (x) JOIN i USING (k), m),
impact AS (SELECT k, x, s / sum(s) OVER (PARTITION BY k) AS s FROM h),
d AS (SELECT doc_id, row_number() OVER () AS r, {_sql_words("text")} AS w FROM documents),
a AS (SELECT r, x, (pos - 1) // step AS v FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d), m WHERE x IN (SELECT x FROM e)),
passage AS (SELECT r, v, x FROM a UNION SELECT r, v - 1, x FROM a WHERE v > 0),
best AS (SELECT r, k, max(s) AS score FROM (SELECT r, v, k, sum(s) AS s FROM passage JOIN impact USING (x) GROUP BY r, v, k) WHERE s >= 0.5 - 1e-9 GROUP BY r, k),
o AS (SELECT k, z, p, array_to_string(w[p:p + z - 1], ' ') AS g FROM
  (SELECT k, w, least(len(w), 5) AS z, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
u AS (SELECT DISTINCT r, array_to_string(w[p:p + z - 1], ' ') AS g FROM
  (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS p FROM d JOIN (SELECT DISTINCT z FROM o) ON len(w) >= z WHERE r IN (SELECT r FROM best))),
covered AS (SELECT DISTINCT best.r, best.k, unnest(range(p, p + z)) AS c FROM best JOIN o USING (k) JOIN u ON u.r = best.r AND u.g = o.g),
shares AS (SELECT r, k, count(*) FILTER (WHERE c <= q) AS cq, count(*) FILTER (WHERE c > q) AS ca FROM covered JOIN i USING (k) GROUP BY r, k),
found AS (SELECT doc_id, item_id, round(score, 9) AS score, CASE WHEN q > 0 THEN cq / q ELSE (cq + ca) / len(i.w) END AS question_overlap,
  CASE WHEN q < len(i.w) THEN ca / (len(i.w) - q) ELSE (cq + ca) / len(i.w) END AS answer_overlap
  FROM shares JOIN best USING (r, k) JOIN i USING (k) JOIN d USING (r))
SELECT * FROM found WHERE question_overlap >= 0.5 AND answer_overlap >= 0.5"""
