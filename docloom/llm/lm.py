"""Scores by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z, and one end per text. The training documents are those
whose crc32 of doc_id as text, mod 10, is not 0; all statistics cover all of them.

Counts. One pass counts all training tokens; counting is pre-aggregated in the tasks and summed by Spark.
The unigram probability of a token is ``(c + 0.1) / (N + 0.1 * (V + 1))``.

Model. Each token seen LEAST_COUNT times or more is a symbol with embeddings of its own, as target and as context, so that
their number grows with the corpus, up to the HEAD most frequent ones; all others share one. A symbol's score is bilinear in
the embeddings of its context, the two symbols before it, and its own, plus a bias. Symbols by falling frequency are the
leaves of a tree of LEVELS levels with about the same number of children everywhere; each node has an embedding and a bias as
a target, and the probability of a symbol is the product of those of its path, each among siblings only, so that exact
sums over siblings, by batched matrix products, normalise it. A token without a symbol has the shared symbol's probability
times its unigram share among such tokens, so that the probabilities of all tokens, with one slot for unseen ones, add to 1.

Training is noise-contrastive estimation at each level, with noise from the siblings, and reads every training
token once: each of ROUNDS rounds takes the documents of its hash, in shards whose number grows with the corpus. The tasks
improve the same parameters on their shard and pass on the rows they touched; Spark deals these out by row and averages
each, weighted by the tokens behind it. A shard too small for STEPS batches goes over its tokens again.

The parameters are broadcast: 2 * DIM + 4 bytes for each of 2.05 * HEAD rows at most, 40 MB, at any size of the corpus; so are
the counts of the HEAD most frequent tokens (20 bytes each, and 8 MB to find them by). A document's other tokens are joined with
the table of counts, distinct ones with their number.

Defined results for odd input: a null or empty text has the one token, its end; a null doc_id counts as empty text, so
it is held out; repeated rows are scored alike, and each trains; without training tokens N is 0, all tokens are
unseen and the model is the unigram; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkernel as tk
from docloom.llm.shared import written

#: Tokens whose counts are broadcast, and of which those with LEAST_COUNT have embeddings.
HEAD, LEAST_COUNT = 1 << 19, 16
DIM, LEVELS, ROUNDS, RATE = 16, 3, 4, 0.15
#: Noise of each position: among siblings on upper levels, and among leaves.
NOISE, LEAF_NOISE = 12, 2
#: Tokens a batch, in full shards and in those that are gone over again, up to STEPS batches.
BATCH, SMALL_BATCH, STEPS = 16384, 1024, 80
#: Tokens that a task holds and shuffles before it trains on them.
HELD_TOKENS = 1 << 20
#: A round has up to SHARDS shards, of SHARD_LEAST tokens at least, and more when these would have over SHARD_MOST.
SHARDS, SHARD_LEAST, SHARD_MOST = 12, 1 << 20, 1 << 24
#: Tokens that are scored together: their scores among siblings stay in a core's cache.
SCORED = 1024
COLUMNS = np.arange(SCORED)
#: The hash that stands for the end of a text.
END = 0x454E44454E44454E
#: Distinct keys a task holds before it passes them on.
HELD = 1 << 20


def held_out_column(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's tokens, its end last, and the documents' offsets in them."""
    words, bounds = tk.word_hashes(raw, offsets, fold=True, seed=5)
    return np.insert(words, bounds[1:], tk.U(END)), bounds + np.arange(len(bounds))


class Counts:
    """Counts of 64-bit keys, passed on as soon as they are many."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(keys.astype(np.int64), return_counts=True)
        k, back = np.unique(np.r_[self.keys, k], return_inverse=True)
        self.keys, self.n = k, np.bincount(back, np.r_[self.n, n]).astype(np.int64)
        if len(self.keys) > HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if len(self.keys):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.n)], ["k", "n"])
        self.keys, self.n = self.keys[:0], self.n[:0]


def _summed(texts: DataFrame, keys) -> DataFrame:
    """(k, n) over all texts; ``keys(tokens, bounds)`` gives the keys of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column(0))
            for i, j in tk.parts(offsets):
                yield from counts.add(keys(*tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
        yield from counts.rest()

    return texts.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


class Head:
    """The most frequent tokens by falling count: hash to place, len(n) for all others."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray) -> None:
        self.n = n
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], order.astype(np.int32)
        # Tokens are found by their hash's leading bits: about one in four slots has a token.
        self.bits = max(4, min(21, (4 * len(n)).bit_length()))
        self.slots = np.searchsorted(self.hashes >> tk.U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=tk.U)).astype(np.int32)

    def of(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), len(self.n), np.int32)
        slot = (words >> tk.U(64 - self.bits)).astype(np.int32)
        at, end = self.slots[slot], self.slots[slot + 1]
        left = np.flatnonzero(at < end)
        at, end, words = at[left], end[left], words[left]
        while len(left):
            hit = self.hashes[at] == words
            out[left[hit]] = self.places[at[hit]]
            at = at + 1
            stay = ~hit & (at < end)
            left, at, end, words = left[stay], at[stay], end[stay], words[stay]
        return out


def contexts(symbols: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each token and the one before that; ``start`` before a text."""
    one, two = np.empty_like(symbols), np.empty_like(symbols)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    two[:2] = start
    one[bounds[:-1]] = two[bounds[:-1]] = start
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = start
    return one, two


def fan(targets: int) -> int:
    """Children of a node: the least number, from 2, at which LEVELS levels hold all targets."""
    n = max(2, int(targets ** (1 / LEVELS)))
    while n**LEVELS < targets:
        n += 1
    return n


def level_sizes(targets: int) -> list[int]:
    return [-(-targets // fan(targets) ** level) for level in range(LEVELS)]


class Model:
    """Log-bilinear scores ``(near * E[one] + far * E[two]) . T[node] + b[node]`` on each level of the tree.

    All vectors are rows of one matrix, E, T from the leaves up, near and far, with a bias as last column, of which those of T count.
    Targets are the symbols of the tree; contexts are these and the start of a text.
    """

    def __init__(self, rows: np.ndarray, bias: np.ndarray, targets: int) -> None:
        self.flat = np.empty((len(rows), DIM + 1), np.float32)
        self.rows, self.bias, self.targets = self.flat[:, :DIM], self.flat[:, DIM], targets
        self.rows[:], self.bias[:] = rows, bias
        self.fan, self.sizes = fan(targets), level_sizes(targets)
        self.starts = [targets + 1 + sum(self.sizes[:level]) for level in range(LEVELS)]
        self.dense = len(rows) - 2

    def children(self, level: int, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first rows of the parents' children, which are nodes of ``level``, and their numbers."""
        first = parents * self.fan
        return self.starts[level] + first, np.minimum(self.fan, self.sizes[level] - first)

    def query(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What vectors with their bias are multiplied with: the last column is 1."""
        q, far = self.flat.take(one, axis=0), self.flat.take(two, axis=0)
        q *= self.flat[self.dense]
        far *= self.flat[self.dense + 1]
        q += far
        q[:, DIM] = 1
        return q

    @np.errstate(over="ignore")
    def log_probabilities(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log of the probability of each w after one and two, from exact sums over the siblings on its path."""
        out = np.zeros(len(w))
        order = np.argsort(w)
        node, q = w[order].astype(np.int64), self.query(one[order], two[order]).T  # a token is a column
        got, z = np.zeros(len(w), np.float32), np.empty(len(w), np.float32)
        held = np.empty(self.fan * SCORED, np.float32)
        for level in range(LEVELS):
            parent = node // self.fan
            child = node - parent * self.fan
            at, runs = segments(parent)
            first, size = self.children(level, parent[at])
            z[:] = 1
            for a, b, i, n in zip(at.tolist(), (at + runs).tolist(), first.tolist(), size.tolist(), strict=True):
                if n == 1:
                    continue
                T = self.flat[i : i + n]
                for c in range(a, b, SCORED):
                    d = min(b, c + SCORED)
                    s = held[: n * (d - c)].reshape(n, d - c)
                    np.matmul(T, q[:, c:d], out=s)
                    got[c:d] += held.take(child[c:d] * (d - c) + COLUMNS[: d - c])
                    np.exp(s, out=s)
                    s.sum(axis=0, out=z[c:d])
                    if not (z[c:d].min() > 0 and z[c:d].max() < np.inf):
                        s = T @ q[:, c:d]
                        most = s.max(axis=0)
                        got[c:d] -= most
                        z[c:d] = np.exp(s - most).sum(axis=0)
            got -= np.log(z)
            node = parent
        out[order] = got
        return out

    def packed(self) -> tuple[bytes, bytes, int]:
        return self.rows.astype(np.float16).tobytes(), self.bias.astype(np.float32).tobytes(), self.targets


def unpacked(rows: bytes, bias: bytes, targets: int) -> Model:
    return Model(np.frombuffer(rows, np.float16).reshape(-1, DIM), np.frombuffer(bias, np.float32), targets)


def fresh(unigram: np.ndarray) -> Model:
    """A model near the unigrams of its targets."""
    targets, r = len(unigram), np.random.default_rng(10)
    n = targets + 1 + sum(level_sizes(targets)) + 2
    model = Model(r.normal(0, 0.1, (n, DIM)).astype(np.float32), np.zeros(n, np.float32), targets)
    model.rows[model.dense], model.rows[model.dense + 1] = 1, 0.5
    for level, size in enumerate(model.sizes):
        p = np.add.reduceat(unigram, np.arange(0, targets, model.fan**level))
        above = np.add.reduceat(p, np.arange(0, len(p), model.fan))
        siblings = np.minimum(model.fan, len(p) - np.arange(len(above)) * model.fan)
        # Relative to the siblings' mean.
        model.bias[model.starts[level] : model.starts[level] + size] = np.log(p * np.repeat(siblings / above, siblings))
    return model


def segments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return starts, np.diff(np.r_[starts, len(x)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.exp(-x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """One shard's training, from a copy of the shared parameters, with Adagrad that has one rate a row."""

    def __init__(self, model: Model, seed: int) -> None:
        self.m = model
        self.squares = np.repeat(np.array([[1, 1000]], np.float32), len(model.rows), axis=0)  # of vectors and biases
        self.weight = np.zeros(len(model.rows), np.float32)
        self.r, self.steps = np.random.default_rng(seed), 0

    def move(self, rows: np.ndarray, g: np.ndarray) -> None:
        """One step of distinct rows by gradients of their vectors and biases, which it uses up."""
        squares = self.squares.take(rows, axis=0)
        squares[:, 0] += np.einsum("nd,nd->n", g[:, :DIM], g[:, :DIM]) / DIM
        squares[:, 1] += g[:, DIM] * g[:, DIM]
        self.squares[rows] = squares
        rates = RATE / np.sqrt(squares)
        g[:, :DIM] *= rates[:, :1]
        g[:, DIM] *= rates[:, 1]
        g += self.m.flat.take(rows, axis=0)
        self.m.flat[rows] = g

    def batch(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, len(w)
        order = np.argsort(w)
        node, one, two = w[order], one[order], two[order]
        e1, e2 = m.flat.take(one, axis=0), m.flat.take(two, axis=0)
        q = m.flat[m.dense] * e1
        q += m.flat[m.dense + 1] * e2
        q[:, DIM] = 1  # so that biases are the last factor of a score, and their gradients the last column
        dq, moves, made = np.zeros_like(q), [], np.empty_like(q)
        for level in range(LEVELS):
            at, runs = segments(node)
            own = node[at] + m.starts[level]
            parent = node // m.fan
            p_at, p_runs = segments(parent)
            first, size = m.children(level, parent[p_at])
            noise = np.minimum(NOISE if level else LEAF_NOISE, size)  # distinct siblings, evenly spaced from a random one
            shift = np.log(noise).astype(np.float32)  # biases are relative to the siblings' mean, as noise is
            by = np.repeat(shift, p_runs)
            t = np.repeat(m.flat.take(own, axis=0), runs, axis=0)
            up = np.einsum("nd,nd->n", q, t)
            up -= by
            up = 1 - sigmoid(up)
            t *= up[:, None]
            dq += t
            moves.append((own, np.add.reduceat(np.multiply(q, up[:, None], out=made), at)))
            self.weight[own] += runs
            begin = self.r.integers(1 << 30, size=len(first)) % size
            if level:
                k = np.arange(NOISE)
                ids = first[:, None] + (begin[:, None] + k * size[:, None] // noise[:, None]) % size[:, None]
                some = k < noise[:, None]
                T, down = m.flat.take(ids, axis=0), np.empty((n, NOISE), np.float32)
                cuts = list(zip(p_at.tolist(), (p_at + p_runs).tolist(), strict=True))
                for i, (a, b) in enumerate(cuts):
                    np.matmul(q[a:b], T[i].T, out=down[a:b])
                down -= by[:, None]
                down = sigmoid(down)
                if not some.all():
                    down *= np.repeat(some, p_runs, axis=0)
                g = np.empty_like(T)
                for i, (a, b) in enumerate(cuts):
                    np.matmul(down[a:b], T[i], out=made[a:b])
                    np.matmul(down[a:b].T, q[a:b], out=g[i])
                dq -= made
                moves.append((ids[some], -g[some]))
            else:
                for k in range(LEAF_NOISE):
                    ids = first + (begin + k * size // noise) % size
                    counts = (k < noise).astype(np.float32)
                    t = np.repeat(m.flat.take(ids, axis=0), p_runs, axis=0)
                    down = np.einsum("nd,nd->n", q, t)
                    down -= by
                    down = sigmoid(down)
                    down *= np.repeat(-counts, p_runs)
                    t *= down[:, None]
                    dq += t
                    moves.append((ids, np.add.reduceat(np.multiply(q, down[:, None], out=made), p_at)))
            node = parent
        for rows, g in moves:
            self.move(rows, g)
        dq[:, DIM] = 0  # contexts have no bias
        for ids, row, e in ((one, m.dense, e1), (two, m.dense + 1, e2)):
            order = np.argsort(ids)
            at, runs = segments(ids[order])
            own = ids[order[at]]
            self.move(own, np.add.reduceat(dq.take(order, axis=0), at) * m.flat[row])
            self.weight[own] += runs
            self.move(np.array([row]), np.einsum("nd,nd->d", dq, e)[None])
            self.weight[row] += n
        self.steps += 1

    def all(self, held: tuple[np.ndarray, ...], size: int) -> None:
        order = self.r.permutation(len(held[0]))
        for i in range(0, len(order), size):
            self.batch(*[x[order[i : i + size]] for x in held])

    def touched(self) -> Iterator[pa.RecordBatch]:
        """(row, weight, bias, vector) of the rows that tokens have changed."""
        rows = np.flatnonzero(self.weight)
        for i in range(0, len(rows), 10_000):
            ids = rows[i : i + 10_000]
            vectors = np.clip(self.m.rows[ids], -60_000, 60_000).astype(np.float16)
            flat = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(len(ids) + 1, dtype=np.int32) * (2 * DIM)), pa.py_buffer(vectors.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(self.weight[ids]), pa.array(self.m.bias[ids]), flat], ["row", "weight", "bias", "vector"])


def averaged(sent: DataFrame, model: Model, parts: int) -> None:
    """Puts the rows' averages into the model; rows of equal number modulo ``parts`` meet in one task, and untouched ones stay."""
    rows_in_all = len(model.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            row, weight, bias = (batch[c].to_numpy() for c in ("row", "weight", "bias"))
            vectors = np.frombuffer(b"".join(batch["vector"].to_pylist()), np.float16).reshape(-1, DIM)
            told = np.c_[vectors.astype(np.float32), bias]
            for part in np.unique(row % parts).tolist():
                mine = row % parts == part
                if part not in sums:
                    n = len(range(part, rows_in_all, parts))
                    sums[part] = np.zeros((n, DIM + 1)), np.zeros(n)
                total, weights = sums[part]
                np.add.at(total, row[mine] // parts, told[mine] * weight[mine, None].astype(float))
                np.add.at(weights, row[mine] // parts, weight[mine])
        for part, (total, weights) in sums.items():
            new = np.where(weights[:, None] > 0, total / np.maximum(weights, 1e-9)[:, None], np.nan).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([new.tobytes()], pa.binary())], ["part", "flat"])

    dealt = sent.repartition(parts, F.pmod("row", F.lit(parts))).mapInArrow(run, "part long, flat binary")
    # One job for all parts, as many as the model has rows: 73 MB at most.
    for r in dealt.toArrow().to_pylist():
        new = np.frombuffer(r["flat"], np.float32).reshape(-1, DIM + 1)
        known = ~np.isnan(new[:, 0])
        ids = np.arange(r["part"], rows_in_all, parts)[known]
        model.rows[ids], model.bias[ids] = new[known, :DIM], new[known, DIM]


def train(texts: DataFrame, tokens_in_all: int, shared, targets: int, unigram: np.ndarray) -> Model:
    """ROUNDS rounds over (text, deal), which together read each text once; ``shared`` is the broadcast head."""
    model = fresh(unigram)
    each = tokens_in_all / ROUNDS
    shards = max(1, min(SHARDS, int(each / SHARD_LEAST)), int(-(-each // SHARD_MOST)))
    for step in range(ROUNDS):
        sent = texts.sparkSession.sparkContext.broadcast(model.packed())

        def run(batches: Iterator[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            trainer, held, size = None, [], 0
            for batch in batches:
                raw, offsets = tk.text_bytes(batch.column(0))
                for i, j in tk.parts(offsets):
                    trainer = trainer or Trainer(unpacked(*sent.value), step)
                    words, bounds = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    w = np.minimum(shared.value.of(words), targets - 1)
                    held.append((w, *contexts(w, bounds, targets)))
                    size += len(w)
                    if size >= HELD_TOKENS:
                        trainer.all([np.concatenate(x) for x in zip(*held, strict=True)], BATCH)
                        held, size = [], 0
            if trainer is None:
                return
            if held:
                rest = [np.concatenate(x) for x in zip(*held, strict=True)]
                trainer.all(rest, BATCH if trainer.steps else SMALL_BATCH)
                while trainer.steps < STEPS:
                    trainer.all(rest, SMALL_BATCH)
            yield from trainer.touched()

        own = texts.filter(F.pmod("deal", F.lit(ROUNDS)) == step).select("text").coalesce(shards)
        averaged(own.mapInArrow(run, "row long, weight float, bias float, vector binary"), model, 4 * shards)
        sent.destroy()
    return model


@dataclass
class Learned:
    """What the training documents say: counts (k, n) of all tokens and their sums, the head, and the model."""

    counts: DataFrame
    total: int
    kinds: int
    head: Head
    model: Model
    rest: float  # unigram share of the tokens that have no symbol

    @property
    def floor(self) -> float:
        return self.total + 0.1 * (self.kinds + 1)


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")


def learned(docs: DataFrame) -> Learned:
    training = docs.filter(~held_out_column(F.col("doc_id").cast("long"))).select("doc_id", "text")
    counts = written(_summed(training, lambda t, bounds: t))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The head: all tokens above a count at which they are HEAD at most, from a histogram of about 8 steps an octave.
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    least = max(sizes, default=0) + 1
    for s in sorted(sizes, reverse=True):
        if sum(v for k, v in sizes.items() if k >= s) > HEAD:
            break
        least = s
    top = counts.filter(step >= least).toArrow()
    order = np.lexsort((top["k"].to_numpy(), -top["n"].to_numpy()))
    head = Head(top["k"].to_numpy()[order].astype(np.int64).astype(tk.U), top["n"].to_numpy()[order].astype(np.int64))
    own = head.n[: np.count_nonzero(head.n >= LEAST_COUNT)]
    p = (own + 0.1) / (total + 0.1 * (kinds + 1))
    rest = max(1.0 - p.sum(), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast(head)
    deal = F.xxhash64("doc_id", F.octet_length("text"))
    model = train(training.select("text", deal.alias("deal")), total, shared, len(p) + 1, np.r_[p, rest] / (p.sum() + rest))
    shared.unpersist()
    return Learned(counts, total, kinds, head, model, rest)


def scored(docs: DataFrame, known: Learned | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    known = known or learned(docs)
    spark, keyed = docs.sparkSession, keyed_texts(docs)
    complete, log_rest, floor, total = known.kinds == len(known.head.n), np.log10(known.rest), known.floor, known.total
    shared = spark.sparkContext.broadcast((known.head, known.model.packed()))
    schema = (
        "doc_id long, version long, rows long, n_tokens long, n_known long, base double, score double, "
        "tail array<struct<k: long, m: long>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, model = shared.value[0], unpacked(*shared.value[1])
        n = np.r_[head.n, 0]
        logs = np.log10((n + 0.1) / floor)
        other = model.targets - 1
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column(2))
            for i, j in tk.parts(offsets):
                words, bounds = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                place = head.of(words)
                here = place < len(head.n) if not complete else np.ones(len(words), bool)  # else the count is in the table only
                base = np.where(here, logs[place], 0.0)
                w = np.minimum(place, other)
                lm = model.log_probabilities(w, *contexts(w, bounds, model.targets)) / np.log(10)
                lm += np.where(w == other, base - log_rest, 0.0)
                add = lambda x, at=bounds[:-1]: np.add.reduceat(x, at)
                away = np.flatnonzero(~here)
                doc, k = np.searchsorted(bounds, away, "right") - 1, words[away].astype(np.int64)
                order = np.lexsort((k, doc))
                doc, k = doc[order], k[order]
                at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])]) if len(k) else np.zeros(0, np.int64)
                tail = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc[at], np.arange(j - i + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(k[at]), pa.array(np.diff(np.r_[at, len(k)]))], ["k", "m"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.ones(j - i, np.int64)), pa.array(np.diff(bounds))]
                    + [pa.array(add((n[place] > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(lm)), tail],
                    ["doc_id", "version", "rows", "n_tokens", "n_known", "base", "score", "tail"],
                )

    parts = written(keyed.mapInArrow(run, schema))
    rare = parts.select("doc_id", "version", F.inline("tail")).join(known.counts, "k", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    log = F.col("m") * F.log10((c + 0.1) / F.lit(floor))
    none = F.lit(0).cast("long")
    tail = rare.groupBy("doc_id", "version").agg(
        none.alias("rows"), none.alias("n_tokens"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("n_known"),
        F.sum(log).alias("base"), F.sum(log).alias("score"),
    )
    # Rows with equal doc_id and text add up to as many times the same.
    whole = (
        parts.drop("tail").union(tail).groupBy("doc_id", "version")
        .agg(*[F.sum(x).alias(x) for x in ("rows", "n_tokens", "n_known", "base", "score")])
    )
    each = whole.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return each.select(
        "doc_id",
        held_out_column(F.col("doc_id")).alias("held_out"),
        (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
