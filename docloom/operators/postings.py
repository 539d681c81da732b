"""Words found as parts of words, by pieces: in an index, for every one, two and three characters in a row, of the texts that have them,
or, for a single search, in the texts as they pass.

A word of up to three characters is such a piece; a longer one can only be in texts that have all its pieces, so the texts of
its rarest piece are looked at and no others. Posting lists are cut into pieces of LIST_TEXTS texts, so that one that
most texts are on is spread over many rows, and lie in buckets by piece, of which a search reads those it asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.tiles import count_scorer
from docloom.sources.scratch import new_folder, stored

LIST_TEXTS, BUCKETS = 4096, 32
#: Characters that are made into pieces at once.
_CHARS = 1 << 22
#: What parts words: white space of all alphabets, and the byte order mark.
BLANKS = r"[\s\x{A0}\x{FEFF}\p{Z}]+"


@dataclass
class Index:
    """``texts(n, sourceFile, chunk_index, version, text)`` and ``lists(bucket, gram, size, texts)``, both stored."""

    texts: DataFrame
    lists: DataFrame


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus 1 of all texts end to end, and how many each has."""
    each = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint32), *each]).astype(np.int64) + 1, np.array([len(e) for e in each], np.int64)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (piece, number of the text) in order; a piece of up to three characters is a whole number of 21 bits for each."""
    codes, sizes = _codes(texts)
    # In the few characters that are there, a piece and its text are one number, which is sorted faster.
    alphabet = np.r_[0, np.flatnonzero(np.bincount(codes, minlength=1))] if len(codes) else np.zeros(1, np.int64)
    dense = np.zeros(int(alphabet[-1]) + 1, np.int64)
    dense[alphabet[1:]] = np.arange(1, len(alphabet))
    bits, low = len(alphabet).bit_length(), max(len(sizes) - 1, 1).bit_length()
    codes, owner = dense[codes], np.repeat(np.arange(len(sizes)), sizes)
    found = []
    for size in range(1, 4):
        piece = codes[: max(len(codes) - size + 1, 0)].copy()
        for k in range(1, size):
            piece = piece << bits | codes[k : len(codes) - size + 1 + k]
        own = owner[: len(piece)]
        inside = own == owner[size - 1 :][: len(piece)]
        if 3 * bits + low < 63:
            pairs = np.unique(piece[inside] << low | own[inside])
            piece, own = pairs >> low, pairs & ((1 << low) - 1)
        else:
            order = np.lexsort((own[inside], piece[inside]))
            piece, own = piece[inside][order], own[inside][order]
            new = np.r_[True, (piece[1:] != piece[:-1]) | (own[1:] != own[:-1])] if len(piece) else inside[:0]
            piece, own = piece[new], own[new]
        letters = [alphabet[piece >> bits * k & ((1 << bits) - 1)] for k in range(size - 1, -1, -1)]
        whole = letters[0]
        for letter in letters[1:]:
            whole = whole << 21 | letter
        found.append((whole, own))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _pieces_of_batch(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """First and last of up to ``most`` texts that are looked at at once."""
    sizes = np.cumsum([len(t) for t in texts])
    begin = 0
    while begin < len(texts):
        done = int(sizes[begin - 1]) if begin else 0
        end = min(max(int(np.searchsorted(sizes, done + _CHARS)), begin + 1), begin + most, len(texts))
        yield begin, end
        begin = end


def _lists(most: int):
    """For batches (n, text): (gram, size, texts), lists of up to ``most`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _pieces_of_batch(batch.column(1).to_pylist(), most):
                part = batch.slice(begin, end - begin)
                piece, own = _grams(part.column(1))
                first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(piece)], pa.int32()), part.column(0).take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([pa.array(piece[first]), pa.array(np.diff(np.r_[first, len(piece)]).astype(np.int32)), lists], ["gram", "size", "texts"])

    return run


def _longest(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(piece, number of the word): the longest pieces of each word."""
    piece, own = _grams(words)
    longest = piece >> 21 * np.array([min(len(w), 3) - 1 for w in words.to_pylist()], np.int64)[own] > 0
    return piece[longest], own[longest]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word number, word) to (word number, gram)."""
    for batch in batches:
        piece, own = _longest(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(piece)], ["term", "gram"])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """(sourceFile, chunk_index, version, text): the lower-cased headings and texts of chunks."""
    words = F.lower(F.concat_ws(" ", "heading", F.coalesce("rawContent", "content")))
    return chunks.select("sourceFile", F.col("chunk_index").cast("int").alias("chunk_index"), "version", words.alias("text"))


def piece_index(chunks: DataFrame, list_texts: int = LIST_TEXTS) -> Index:
    """The index of the lower-cased headings and texts of chunks."""
    texts = stored(chunk_texts(chunks).withColumn("n", F.monotonically_increasing_id()))
    lists = texts.select("n", "text").mapInArrow(_lists(list_texts), "gram long, size int, texts array<long>").withColumn("bucket", _bucket(F.col("gram")))
    folder = new_folder(chunks.sparkSession, "postings")
    # As many files as the session has partitions: where that is more than buckets, a bucket has several.
    files = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    dealt = lists.repartition("bucket", F.pmod(F.get("texts", 0), F.lit(files))).sortWithinPartitions("bucket", "gram")
    dealt.write.partitionBy("bucket").parquet(folder)
    return Index(texts, chunks.sparkSession.read.schema("gram long, size int, texts array<long>, bucket int").parquet(folder))


def words_of(query: Column) -> Column:
    """The words of a query, repeated ones as often as they are there."""
    return F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), BLANKS), lambda w: w != "")


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text, terms, words) to (..., told): the terms whose word is in the text."""
    for batch in batches:
        texts, terms, words = (batch.column(c).to_pylist() for c in ("text", "terms", "words"))
        told = [[t for t, w in zip(ts, ws, strict=True) if w in text] for text, ts, ws in zip(texts, terms, words, strict=True)]
        kept = [c for c in batch.schema.names if c not in ("text", "terms", "words")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(told, pa.list_(pa.int64()))], [*kept, "told"])


def word_matches(index: Index, words: DataFrame) -> DataFrame:
    """(n, sourceFile, chunk_index, version, told): the texts that have some of the distinct ``words(term, word)`` in them, and which.

    A text is read if a word's rarest piece is in it, once for all words that it may have.
    """
    wanted = stored(words.select("term", "word").mapInArrow(_pieces, "term long, gram long").withColumn("bucket", _bucket(F.col("gram"))))
    asked = wanted.select("bucket", "gram").distinct()
    often = index.lists.select("bucket", "gram", "size").join(asked, ["bucket", "gram"]).groupBy("bucket", "gram").agg(F.sum("size").alias("often"))
    told = wanted.join(often, ["bucket", "gram"], "left")
    rare = told.groupBy("term").agg(F.min_by(F.struct("bucket", "gram"), F.struct("often", "gram")).alias("rare"), F.bool_and(F.col("often").isNotNull()).alias("there"))
    rare = stored(rare.filter("there").select("term", "rare.bucket", "rare.gram").join(words, "term"))
    near = index.lists.join(rare, ["bucket", "gram"]).select(F.explode("texts").alias("n"), "term", "word")
    of_text = near.groupBy("n").agg(F.collect_list(F.struct("term", "word")).alias("near"))
    looked = index.texts.join(of_text, "n").select("n", "sourceFile", "chunk_index", "version", "text", F.col("near.term").alias("terms"), F.col("near.word").alias("words"))
    schema = "n long, sourceFile string, chunk_index int, version string, told array<long>"
    return looked.mapInArrow(_present, schema).filter(F.size("told") > 0)


class _Finder:
    """Which of some distinct words are in texts: a word is looked for in a text that has all its pieces.

    Pieces are asked for from the rarest in the first texts on, which changes how many are asked for, not what is found.
    """

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.whole = np.array([len(w) <= 3 for w in words], bool)
        self.pieces: np.ndarray | None = None

    def _choose(self, seen: np.ndarray) -> None:
        piece, own = _longest(pa.array(self.words, pa.string()))
        self.pieces, piece = np.unique(piece, return_inverse=True)
        often = np.searchsorted(seen, self.pieces, "right") - np.searchsorted(seen, self.pieces)
        order = np.lexsort((piece, often[piece], own))
        #: The pieces of every word, the rarest first, and where those of a word begin and end.
        self.turn = piece[order]
        self.begin, self.end = (np.searchsorted(own[order], np.arange(len(self.words)), side) for side in ("left", "right"))
        rarest = self.turn[self.begin]
        self.word = np.argsort(rarest, kind="stable")
        self.first = np.searchsorted(rarest[self.word], np.arange(len(self.pieces) + 1))

    def _candidates(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) where all pieces of a word are."""
        piece, text = _grams(texts)
        if self.pieces is None:
            self._choose(np.sort(piece))
        at = np.minimum(np.searchsorted(self.pieces, piece), max(len(self.pieces) - 1, 0))
        asked = self.pieces[at] == piece if len(self.pieces) else np.zeros(len(piece), bool)
        piece, text = at[asked], text[asked]
        there = np.sort(piece * len(texts) + text)
        n = self.first[piece + 1] - self.first[piece]
        word = self.word[np.repeat(self.first[piece] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        text, turn = np.repeat(text, n), 1
        fine, more = [(text[:0], word[:0])], True
        while more:
            done = self.begin[word] + turn >= self.end[word]
            fine.append((text[done], word[done]))
            text, word = text[~done], word[~done]
            wanted = self.turn[self.begin[word] + turn] * len(texts) + text
            has = there[np.minimum(np.searchsorted(there, wanted), max(len(there) - 1, 0))] == wanted if len(wanted) else done[:0]
            text, word, turn, more = text[has], word[has], turn + 1, bool(has.any())
        return tuple(np.concatenate(c) for c in zip(*fine, strict=True))

    def found(self, texts: pa.Array) -> pa.Array:
        """For each text the numbers of the words in it."""
        known, sizes, words = texts.to_pylist(), np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
        for begin, end in _pieces_of_batch(known, len(known)):
            text, word = self._candidates(texts.slice(begin, end - begin))
            text += begin
            there = self.whole[word]
            at = np.flatnonzero(~there)
            there[at] = [self.words[w] in known[t] for w, t in zip(word[at].tolist(), text[at].tolist(), strict=True)]
            text, word = text[there], word[there]
            sizes += np.bincount(text, minlength=len(known))
            words.append(word[np.argsort(text, kind="stable")])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(words)))


def word_scorer(asked: pa.Array):
    """For `best_by_tiles`: how many of a query's words, which may be repeated, are in a row's text, as parts of words, too."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False))
    each = asked.flatten().to_pylist()
    number = {w: i for i, w in enumerate(dict.fromkeys(each))}
    count = count_scorer(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array([number[w] for w in each], pa.int64())))
    finder = _Finder(list(number))
    # The same texts come once for each block of queries.
    last: list = [None, None]

    def score(told: pa.Array, first: int, end: int) -> np.ndarray:
        if last[0] is not told:
            last[:] = told, finder.found(told)
        return count(last[1], first, end)

    return score
