"""Embedding of chunks: which rows need it, a batch interface for any model, and a small offline embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text


def has_valid_embedding(e: Column, dim: int) -> Column:
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(e) == dim) & finite, F.lit(False))


def needs_reembedding(e: Column, dim: int) -> Column:
    """Missing or of another size; what the numbers are is not looked at."""
    return F.coalesce(F.size(e) != dim, F.lit(True)) | e.isNull()


def round_embedding(e: Column, digits: int = 6) -> Column:
    """Half up, as floor(x * 10^digits + 0.5) / 10^digits."""
    k = float(10**digits)
    return F.transform(e, lambda x: F.floor(x.cast("double") * k + 0.5) / k)


def embed_text(chunks: DataFrame) -> Column:
    c = {x: F.col(x) for x in ("heading", "category", "breadcrumb", "subHeadings", "tags", "hasCode", "codeLanguages")}
    raw = F.coalesce(F.col("rawContent"), F.col("content"))
    return text.build_embed_text(*c.values(), raw)


def select_for_embedding(chunks: DataFrame, dim: int, force: bool = False) -> DataFrame:
    """Rows to embed, with ``embed_text``; rows whose text is empty are left out."""
    rows = chunks if force else chunks.filter(~has_valid_embedding(F.col("embedding"), dim))
    return rows.withColumn("embed_text", embed_text(rows)).filter(F.col("embed_text") != "")


def _encoded(encode: Callable[[list[str]], np.ndarray], texts: list[str]) -> list[tuple[np.ndarray | None, int, str | None]]:
    """(vector, attempts, error) of each text; a batch that fails is halved until the texts that make it fail stand alone."""
    try:
        rows = np.asarray(encode(texts), np.float64)
        if rows.ndim != 2 or len(rows) != len(texts):
            raise ValueError(f"{len(texts)} texts gave an array of shape {rows.shape}")
    except Exception as e:  # noqa: BLE001 - a model may raise anything, and the rows beside a bad one are to be kept
        if len(texts) == 1:
            return [(None, 1, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return [(v, n + 1, error) for v, n, error in [*_encoded(encode, texts[:half]), *_encoded(encode, texts[half:])]]
    lengths = np.linalg.norm(rows, axis=1)
    fine = np.isfinite(lengths)
    return [(r / max(n, 1e-12), 1, None) if ok else (None, 1, "no finite vector") for r, n, ok in zip(rows, lengths.tolist(), fine.tolist(), strict=True)]


def embed_attempts(texts: Column, model: Callable[[], Callable[[list[str]], np.ndarray]]) -> Column:
    """(vector, attempts, error) for a text column: attempts are the calls of the model that had the text among theirs.

    ``model`` is called once a worker and gives a function from texts to rows. Rows are scaled to length 1. Of a batch that
    fails, whatever it raises, only the texts that fail by themselves have no vector. Null and empty texts are not tried.
    """

    @F.pandas_udf("vector array<float>, attempts int, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = model()
        for batch in batches:
            out: list[tuple] = [(None, 0, None)] * len(batch)
            some = [i for i, t in enumerate(batch) if t]
            for i, (v, n, error) in zip(some, _encoded(encode, [batch.iloc[i] for i in some]) if some else [], strict=True):
                out[i] = (None if v is None else v.astype(np.float32), n, error)
            vectors, attempts, errors = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "attempts": pd.Series(attempts, dtype="int32"), "error": pd.Series(errors, dtype=object)})

    return run(texts)


def embed(texts: Column, model: Callable[[], Callable[[list[str]], np.ndarray]]) -> Column:
    """The vectors of `embed_attempts`; null where there is none."""
    return embed_attempts(texts, model)["vector"]


def hash_model(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Deterministic and offline: each distinct lower-cased word sets the slot of its hash."""

    def make() -> Callable[[list[str]], np.ndarray]:
        def slot(word: str) -> int:
            h = 0
            for ch in word:
                h = (h * 31 + ord(ch)) & 0xFFFFFFFF
            return h % dim

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, t in zip(out, texts, strict=True):
                for w in set(t.lower().split()):
                    row[slot(w)] = 1.0
            return out

        return encode

    return make


def hash_embed(c: Column, dim: int = 64) -> Column:
    """`hash_model` in Spark's own expressions; null for a text without words."""
    words = F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    slot = lambda w: F.aggregate(
        F.filter(F.split(w, ""), lambda x: x != ""),
        F.lit(0).cast("long"),
        lambda h, x: F.pmod(h * 31 + F.ascii(x), F.lit(1 << 32)),
        lambda h: F.pmod(h, F.lit(dim)).cast("int"),
    )

    def vector(slots: Column) -> Column:
        value = (F.lit(1.0) / F.sqrt(F.size(slots))).cast("float")
        places = F.sequence(F.lit(0), F.lit(dim - 1))
        return F.when(
            F.size(slots) > 0, F.transform(places, lambda i: F.when(F.array_contains(slots, i), value).otherwise(F.lit(0.0).cast("float")))
        )

    # Through a lambda's variable, so that the slots of a text are computed once and not for each place.
    return F.transform(F.array(F.array_distinct(F.transform(words, slot))), vector)[0]


def embedding_progress(chunks: DataFrame, dim: int) -> DataFrame:
    """Rows, rows done and rows to do for each file, and for all files under a null sourceFile."""
    valid = has_valid_embedding(F.col("embedding"), dim)
    return chunks.rollup("sourceFile").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(valid).alias("done"), F.count_if(~valid).alias("todo")
    )
