"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of hashes of its runs of five words; two documents are linked if the Jaccard
similarity of their sets is 0.8 or more. Steps:

1. One pass computes a 128-bit digest of the set and 128 MinHash values. Equal sets are one class from
   here on, however many copies there are.
2. Candidates: the values are cut into 32 bands of four. Classes that agree in a band meet at the least
   of them, the hub. A pair at 0.8 agrees in no band with probability 5e-8. A band value that many share
   is counted with partial sums and joined, never gathered.
3. The classes around a hub are compared value by value, 16 more at a time. With a uniform prior, after
   m of n equal values the similarity is 0.8 or more with probability P(Bin(n + 1, 0.8) <= m); a pair for which that is
   below TOLERANCE is dropped. What is left of a group is told as a spanning forest, not as pairs.
4. Components of those forests hold every pair that may be linked. Within one, each class's set is told as its
   difference from the set of the component's least class, so that what is compared is short for near copies, and no
   text is sent to a pair. Those differences are compared, exactly, and each class is told its links and a forest
   of its linked group.

Groups of any size are cut into blocks, and a task holds two blocks at a time, so no group is gathered.

Defined results for odd input: a text without words (null, empty) has no set: it is linked to nothing and is its
own class, under its own doc_id; one of fewer than five words has the one run of all its words; rows with equal doc_id
and text are copies; class_id is the least doc_id of the group, null first; an empty table gives
an empty result; other columns are ignored, or carried in a struct by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkernel as tk
from docloom.llm.components import components
from docloom.llm.shared import dropped, marked, written

THRESHOLD = Fraction(4, 5)
WORDS = 5
HASHES, BANDS, STEP = 128, 32, 16
TOLERANCE = 1e-7
#: Classes in a block; a task compares two blocks.
BLOCK = 256
#: Shares of a large group when its members learn its size.
SALTS = 64

_SIGNED = "doc_id long, version long, n long, a long, b long, sig binary"
_FOREST = "id long, version long, root_id long, root_version long, links long"


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(9)
    return r.integers(0, 1 << 63, HASHES, dtype=np.uint64) * tk.U(2) + tk.U(1), r.integers(0, 1 << 63, HASHES, dtype=np.uint64)


@cache
def least_matches(n: int, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values of n for which a pair is kept."""
    t, total = float(threshold), 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mul, add = _permutations()
    for batch in batches:
        raw, offsets = tk.text_bytes(batch.column(2))
        for i, j in tk.parts(offsets):
            h, at = tk.shingle_hashes(*tk.word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), WORDS)
            full = np.flatnonzero(np.diff(at))
            sig = np.zeros((len(full), HASHES), np.uint32)
            if len(full):
                for k in range(HASHES):
                    sig[:, k] = (np.minimum.reduceat(h * mul[k] + add[k], at[full]) >> tk.U(32)).astype(np.uint32)
            n, a, b = (np.zeros(j - i, np.int64) for _ in range(3))
            sigs: list[bytes | None] = [None] * (j - i)
            for k, s in zip(full.tolist(), sig, strict=True):
                u = np.unique(h[at[k] : at[k + 1]])
                n[k] = len(u)
                a[k] = tk.mixed(u).sum(dtype=tk.U).astype(np.int64)
                b[k] = tk.mixed(u ^ tk.U(0xA5A5A5A55A5A5A5A)).sum(dtype=tk.U).astype(np.int64)
                sigs[k] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n), pa.array(a), pa.array(b), pa.array(sigs, pa.binary())],
                ["doc_id", "version", "n", "a", "b", "sig"],
            )


def signed(docs: DataFrame) -> DataFrame:
    """One row per document: its set's size n, digest (a, b) and MinHash values."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    return keyed.mapInArrow(_sign, _SIGNED)


def grouped(rows: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(list of batches)`` for each group of equal keys, one group at a time in memory."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                now = tuple(c[i] for c in cols)
                if held and now != key:
                    yield from run(held)
                    held = []
                key = now
                held.append(batch.slice(i, j - i))
        if held:
            yield from run(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def in_blocks(members: DataFrame, group: str) -> DataFrame:
    """Each member with its group's number of blocks, and own, the one that it is in."""
    sizes = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # Only groups of several blocks are joined, each once a salt, so that a large one spreads over the tasks.
    large = sizes.filter("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    place = F.xxhash64("id", "version")
    salted = members.withColumn("salt", F.pmod(place, F.lit(SALTS)).cast("int")).join(large, [group, "salt"], "left")
    placed = salted.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return placed.select(*members.columns, "blocks", F.pmod(place, F.col("blocks")).cast("int").alias("own"))


def paired(placed: DataFrame) -> DataFrame:
    """Each member once for every pair of blocks i <= j that its block is in."""
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [c for c in placed.columns if c != "blocks"]
    return other.select(*columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _pairs(sig: np.ndarray, own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the two blocks that the Bayesian test leaves, as row numbers."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    x, y = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
    if i == j:
        x, y = x[x < y], y[x < y]
    same = np.zeros(len(x), np.int16)
    for k in range(0, HASHES, STEP):
        for c in range(k, k + STEP):
            same += sig[x, c] == sig[y, c]
        stay = same >= least_matches(k + STEP)
        x, y, same = x[stay], y[stay], same[stay]
    return x, y


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows, a row of its group under the links (x, y)."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def _told(ids: np.ndarray, versions: np.ndarray, links: np.ndarray, x: np.ndarray, y: np.ndarray, nulls: np.ndarray) -> pa.RecordBatch:
    root = _forest(len(ids), x, y)
    on = np.unique(np.r_[x, y])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[on], mask=nulls[on]),
            pa.array(versions[on]),
            pa.array(ids[root[on]], mask=nulls[root[on]]),
            pa.array(versions[root[on]]),
            pa.array(links[on]),
        ],
        ["id", "version", "root_id", "root_version", "links"],
    )


def _columns(held: list[pa.RecordBatch]):
    t = pa.Table.from_batches(held).combine_chunks()
    nulls = t["id"].is_null().to_numpy()
    num = lambda c: t[c].fill_null(0).to_numpy()
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
    return t, num("id"), num("version"), nulls, sig, num("own"), int(num("i")[0]), int(num("j")[0])


def _pruned(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if sum(b.num_rows for b in held) > 1:
        _, ids, versions, nulls, sig, own, i, j = _columns(held)
        x, y = _pairs(sig, own, i, j)
        if len(x):
            yield _told(ids, versions, np.zeros(len(ids), np.int64), x, y, nulls)


_TOLD = "grp long, own int, blocks int, id long, version long, copies long, sig binary, apart binary, gone long, base long"


def _sets(texts: pa.Array) -> list[np.ndarray]:
    words, bounds = tk.word_hashes(*tk.text_bytes(texts))
    h, at = tk.shingle_hashes(words, bounds, WORDS)
    return [np.unique(h[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's set as apart, the hashes that only it or only its group's first set has; gone, how many of them it
    lacks; base, the size of the first set. The first set leads the rows of each (grp, own)."""
    key, first = None, np.zeros(0, tk.U)
    for batch in batches:
        at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
        grp, own, leads = (batch.column(at[c]).to_numpy(zero_copy_only=False) for c in ("grp", "own", "leads"))
        offsets = tk.text_bytes(batch.column(at["text"]))[1]
        for i, j in tk.parts(offsets):
            rows, apart, gone, base = [], [], [], []
            for k, mine in zip(range(i, j), _sets(batch.column(at["text"])[i:j]), strict=True):
                if leads[k]:
                    key, first = (grp[k], own[k]), mine
                    continue
                assert key == (grp[k], own[k])
                both = np.isin(first, mine, assume_unique=True)
                lacks = first[~both]
                rows.append(k)
                apart.append(np.concatenate([lacks, mine[~np.isin(mine, first[both], assume_unique=True)]]).tobytes())
                gone.append(len(lacks))
                base.append(len(first))
            out = batch.take(pa.array(rows, pa.int64())).select(["grp", "own", "blocks", "id", "version", "copies", "sig"])
            more = [pa.array(apart, pa.binary()), pa.array(gone, pa.int64()), pa.array(base, pa.int64())]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], [*out.schema.names, "apart", "gone", "base"])


def differences(placed: DataFrame) -> DataFrame:
    """`_differences` of members with their text; the first set of a group goes to each of its blocks."""
    mine = F.array(F.struct(F.col("own"), F.lit(False).alias("leads")))
    first = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("own"), F.lit(True).alias("leads")))
    rows = placed.withColumn("to", F.explode(F.when(F.col("first"), F.concat(mine, first)).otherwise(mine)))
    rows = rows.select("grp", F.col("to.own").alias("own"), F.col("to.leads").alias("leads"), "blocks", "id", "version", "copies", "sig", "text")
    dealt = rows.repartition("grp", "own").sortWithinPartitions("grp", "own", F.desc("leads"), "id", "version")
    return dealt.mapInArrow(_differences, _TOLD)


def _verified(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if sum(b.num_rows for b in held) < 2:
        return
    t, ids, versions, nulls, sig, own, i, j = _columns(held)
    x, y = _pairs(sig, own, i, j)
    if not len(x):
        return
    packed = t["apart"].to_pylist()
    number = np.unique(np.frombuffer(b"".join(packed), tk.U), return_inverse=True)[1]
    ends = np.cumsum([0] + [len(p) // 8 for p in packed])
    apart = [number[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    gone, base = t["gone"].to_numpy(), int(t["base"][0].as_py())
    size = base - 2 * gone + np.diff(ends)
    mark, linked = np.zeros(len(number) + 1, bool), np.zeros(len(x), bool)
    order = np.argsort(x, kind="stable")
    marked = -1
    for p in order.tolist():
        if x[p] != marked:
            if marked >= 0:
                mark[apart[marked]] = False
            marked = int(x[p])
            mark[apart[marked]] = True
        # Of the first set, both have all that neither lacks; of the rest, what both add.
        shared = base - gone[marked] - gone[y[p]] + int(np.count_nonzero(mark[apart[y[p]]]))
        union = size[marked] + size[y[p]] - shared
        linked[p] = shared * THRESHOLD.denominator >= THRESHOLD.numerator * union
    x, y = x[linked], y[linked]
    if len(x):
        copies = t["copies"].to_numpy()
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        yield _told(ids, versions, links, x, y, nulls)


def _edges(forest: DataFrame) -> DataFrame:
    return forest.select(
        F.struct(F.col("id"), F.col("version")).alias("u"),
        F.struct(F.col("root_id").alias("id"), F.col("root_version").alias("version")).alias("v"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, version (hash of the text), class (least (id, version) of its group), n_links."""
    sigs = written(signed(docs))
    place = F.struct(F.col("doc_id").alias("id"), "version")
    classes = written(
        sigs.filter("n > 0")
        .groupBy("a", "b", "n")
        .agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
        .select("a", "b", "n", F.col("place.id").alias("id"), F.col("place.version").alias("version"), "copies", "sig")
    )
    width = HASHES * 4 // BANDS
    bands = classes.select(
        F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(BANDS)])).alias("band"),
        "a",
    )
    hubs = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("hub")).filter("n > 1").select("band", "hub")
    near = written(bands.join(hubs, "band").select("hub", "a").distinct())
    # A clash of a, half the digest, only adds a candidate.
    around = near.join(classes.select("a", "id", "version", "sig"), "a").select("hub", "id", "version", "sig")
    maybe = written(grouped(paired(in_blocks(around, "hub")), ["hub", "i", "j"], _pruned, _FOREST))
    dropped(near)
    groups = components(_edges(maybe))
    dropped(maybe)
    groups = groups.select(
        F.col("node.id").alias("id"), F.col("node.version").alias("version"),
        F.xxhash64("label.id", "label.version").alias("grp"), (F.col("node") == F.col("label")).alias("first"),
    )
    same = lambda l, r: l["id"].eqNullSafe(r["id"]) & (l["version"] == r["version"])
    few = classes.select("id", "version", "copies", "sig")
    members = few.join(groups, same(few, groups)).select(few["id"], few["version"], "copies", "sig", "grp", "first")
    members = written(in_blocks(members, "grp"))
    # Only texts of members are shuffled; repeated rows of a document are one member, and the text goes with it.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"), "text")
    key = F.xxhash64("id", "version")
    texts = marked(texts, key, members, key).filter("maybe").select("id", "version", "text")
    full = (
        members.join(texts, same(members, texts))
        .groupBy(*[members[c] for c in ("id", "version", "copies", "grp", "first", "blocks", "own")])
        .agg(F.first("sig").alias("sig"), F.first("text").alias("text"))
    )
    sure = written(grouped(paired(differences(full)), ["grp", "i", "j"], _verified, _FOREST))
    dropped(members)
    labels = components(_edges(sure)).select("node", "label")
    degrees = sure.groupBy(F.struct("id", "version").alias("node")).agg(F.sum("links").alias("links"))
    linked = labels.join(degrees, "node").select(
        F.col("node.id").alias("id"), F.col("node.version").alias("version"), "label", "links"
    )
    named = classes.select("a", "b", F.col("n").alias("size"), "id", "version", "copies")
    named = named.join(linked, same(named, linked), "left").select(
        "a", "b", "size", "copies",
        F.coalesce("label", F.struct(named["id"], named["version"])).alias("class"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    rows = sigs.select("doc_id", F.col("version"), "n", "a", "b")
    return rows.join(
        named, (rows["a"] == named["a"]) & (rows["b"] == named["b"]) & (rows["n"] == named["size"]), "left"
    ).select(
        "doc_id",
        rows["version"],
        F.coalesce("class", F.struct(F.col("doc_id").alias("id"), rows["version"])).alias("class"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least of their group, one each, with all their columns."""
    first = near_duplicates(docs).filter(
        F.col("class").eqNullSafe(F.struct(F.col("doc_id").alias("id"), F.col("version")))
    )
    first = written(first.select(F.col("doc_id").alias("id"), F.col("version").alias("of")).distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"), F.struct("*").alias("row"))
    kept = rows.join(first, rows["doc"].eqNullSafe(first["id"]) & (rows["version"] == first["of"]), "left_semi")
    return kept.groupBy("doc", "version").agg(F.first("row").alias("row")).select("row.*")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("class.id").alias("class_id"), "n_links")


#: All pairs that share a run of words, and the closure of the links; rows are numbered, as ids may repeat.
SQL = r"""WITH RECURSIVE n AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM n),
z AS (SELECT r, count(*) AS size FROM s GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
p AS (SELECT x, y FROM shared JOIN z zx ON zx.r = x JOIN z zy ON zy.r = y WHERE 5 * c >= 4 * (zx.size + zy.size - c)),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
t AS (SELECT r, r AS o FROM n UNION SELECT l.y, t.o FROM t JOIN l ON l.x = t.r),
c AS (SELECT t.r, CASE WHEN count(m.doc_id) = count(*) THEN min(m.doc_id) END AS class_id FROM t JOIN n m ON m.r = t.o GROUP BY t.r),
k AS (SELECT x AS r, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM n JOIN c USING (r) LEFT JOIN k USING (r)"""
