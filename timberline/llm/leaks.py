"""Passages of evaluation items in a corpus: pigeonhole pieces, exact hits, Myers' bit-parallel distance.

A passage of ``min_words`` words with at most ``max_edits`` edits, cut into max_edits + 1 pieces, keeps one
piece whole, and keeps most of its short runs of words. Items become tables of hashed runs. One pass over the
corpus cuts out the stretches that hold an item's piece and enough item runs close together, by a filter of
bounded size; an equi-join on the hashed runs names the items of each stretch and counts their runs; Myers'
algorithm over words decides the pairs that are left, for many windows at once in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Workspace, broadcast_if_small, pick

_WORDS = re.compile(r"[^\W_]+")
#: Longest stretch of a document that is compared at once; longer ones are cut with an overlap.
STRETCH = 256
#: Bits of the filter that all workers hold: 16 for each hashed run of the items, up to this bound (16 MB).
#: Beyond it more stretches pass the filter, and the join sorts them out.
MAX_FILTER_BITS = 1 << 27
#: Item runs are broadcast up to so many rows of some 30 bytes; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000
#: Distinct words that a task remembers the hashes of.
CACHED_WORDS = 500_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters or digits in lower case."""
    return _WORDS.findall(text.lower()) if text else []


class _Hashes(dict):
    """A 64-bit hash of each word, never 0."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word) | 1
        self[word] = h
        return h


def hash_words(words: list[str], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs(ids: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every run of q ids; 0 where a run holds the id 0, which parts texts."""
    n = len(ids) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    h ^= h >> np.uint64(29)
    parted = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.where(parted[q:] == parted[:-q], np.maximum(h, np.uint64(1)), np.uint64(0))


class Passage:
    """What a passage is, and what follows from it: the length of pieces and of short runs, and how many of
    these survive the edits (q-gram lemma: k edits spoil at most k * q of the m - q + 1 runs)."""

    def __init__(self, min_words: int, max_edits: int):
        if not 0 <= max_edits < min_words <= 64:
            raise ValueError("need 0 <= max_edits < min_words <= 64")
        self.m, self.k = min_words, max_edits
        self.piece = min_words // (max_edits + 1)
        self.q = max(1, min(self.piece, (min_words + 1) // (2 * max_edits + 2) + 1))
        self.least = min_words - self.q + 1 - max_edits * self.q


class RunFilter:
    """A Bloom filter of hashed runs with two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    @staticmethod
    def size_for(n: int) -> int:
        return min(MAX_FILTER_BITS, max(1 << 16, 1 << (16 * max(1, n) - 1).bit_length()))

    @classmethod
    def of(cls, hashes: np.ndarray) -> RunFilter:
        f = cls(np.zeros(cls.size_for(len(hashes)) // 64, np.uint64))
        for at in f.places(hashes):
            np.bitwise_or.at(f.bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        return f

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h & self.mask, (h >> np.uint64(32)) & self.mask

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = h > 0
        for at in self.places(h):
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


def cut_stretches(texts: list[str | None], p: Passage, pieces: RunFilter, grams: RunFilter, known: _Hashes) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text, words, hashed item runs by position, 0 for others) of each stretch that may hold
    a passage: it has a piece, and enough runs that start within the length of a passage."""
    arrays, gap = [], np.zeros(1, np.uint64)
    for t in texts:
        arrays += [hash_words(words_of(t), known), gap]
    flat = np.concatenate(arrays) if arrays else gap
    begin = np.concatenate([[0], np.cumsum([len(a) + 1 for a in arrays[::2]])])
    whole = np.flatnonzero(pieces.holds(runs(flat, p.piece)))
    docs = np.unique(np.searchsorted(begin, whole, side="right") - 1)
    out = []
    reach = p.m + p.k - p.q
    for d in docs:
        words = flat[begin[d] : begin[d + 1] - 1]
        g = runs(words, p.q)
        hit = np.flatnonzero(grams.holds(g))
        first = np.flatnonzero(hit[p.least - 1 :] - hit[: len(hit) - p.least + 1] <= reach) if len(hit) >= p.least else []
        if not len(first):
            continue
        marked = np.zeros(len(words), np.uint64)
        marked[hit] = g[hit]
        lo, hi = hit[first] - p.m - p.k, hit[first] + 2 * (p.m + p.k)
        cut = np.flatnonzero(np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1], [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            start, end = max(int(lo[a]), 0), min(int(hi[b - 1]), len(words))
            for s in range(start, end, STRETCH - p.m - p.k):
                e = min(end, s + STRETCH)
                out.append((int(d), words[s:e], marked[s:e]))
                if e == end:
                    break
    return out


def verify_pairs(texts: list[np.ndarray], items: list[np.ndarray], p: Passage) -> np.ndarray:
    """Whether some ``min_words`` words in a row of the item are in the stretch with at most max_edits edits,
    for each pair, by Myers' bit-parallel distance with free ends in the stretch."""
    tasks = []
    for n, (text, item) in enumerate(zip(texts, items)):
        shared = np.concatenate([[0], np.cumsum(np.isin(runs(item, p.q), runs(text, p.q)))])
        many = len(item) - p.m + 1
        if many > 0:
            starts = np.flatnonzero(shared[p.m - p.q + 1 : p.m - p.q + 1 + many] - shared[:many] >= p.least)
            tasks += [(n, s) for s in np.array_split(starts, len(starts) // 512 + 1) if len(s)]
    found = np.zeros(len(texts), bool)
    for at in range(0, len(tasks), 64):
        part = [t for t in tasks[at : at + 64] if not found[t[0]]]
        if not part:
            continue
        longest, rows = max(len(texts[n]) for n, _ in part), sum(len(s) for _, s in part)
        eq = np.zeros((longest, rows), np.uint64)
        row = 0
        for n, starts in part:
            text, low = texts[n], int(starts[0])
            same = items[n][low : int(starts[-1]) + p.m, None] == text[None, :]
            bits = np.zeros((len(starts), len(text)), np.uint64)
            for k in range(p.m):
                bits |= same[starts - low + k].astype(np.uint64) << np.uint64(k)
            eq[: len(text), row : row + len(starts)] = bits.T
            row += len(starts)
        one, top = np.uint64(1), np.uint64(p.m - 1)
        pv, mv = np.full(rows, ~np.uint64(0)), np.zeros(rows, np.uint64)
        score = np.full(rows, p.m, np.int64)
        best = score.copy()
        for e in eq:
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            np.minimum(best, score, out=best)
        row = 0
        for n, starts in part:
            found[n] |= bool(best[row : row + len(starts)].min() <= p.k)
            row += len(starts)
    return found


class LeakIndex:
    """The same steps for a few items in memory."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int, max_edits: int):
        self.passage, self.known = Passage(min_words, max_edits), _Hashes()
        hashed = [(i, hash_words(words_of(t), self.known)) for i, t in items]
        self.items = [(i, w) for i, w in hashed if len(w) >= min_words]
        collect = lambda q: np.unique(np.concatenate([np.zeros(0, np.uint64), *[runs(w, q) for _, w in self.items]]))
        self.pieces, self.grams = RunFilter.of(collect(self.passage.piece)), RunFilter.of(collect(self.passage.q))

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(number of the text, item key) of each leak, each once."""
        cut = cut_stretches(texts, self.passage, self.pieces, self.grams, self.known)
        pairs = [(d, w, i, item) for d, w, _ in cut for i, item in self.items]
        ok = verify_pairs([x[1] for x in pairs], [x[3] for x in pairs], self.passage)
        return list({(d, i): None for (d, _, i, _), y in zip(pairs, ok) if y})


# -- tables ----------------------------------------------------------------------------------------------

def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(flat))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def item_words(items: DataFrame, p: Passage) -> DataFrame:
    """(item_id, words): hashed words of the items that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            words = [hash_words(words_of(t), known) for t in b.column(1).to_pylist()]
            long = [i for i, w in enumerate(words) if len(w) >= p.m]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(long, pa.int64())), _lists([words[i] for i in long])], names=["item_id", "words"])

    return items.select("item_id", "item_text").mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, words array<bigint>")


def item_runs(words: DataFrame, q: int) -> DataFrame:
    """(h, item_id): the hashed runs of q words of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.unique(runs(w, q)) for w in _arrays(b.column(1))]
            owner = np.repeat(np.arange(len(h)), [len(x) for x in h])
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([np.zeros(0, np.uint64), *h])), b.column(0).take(pa.array(owner))], names=["h", "item_id"])

    return words.mapInArrow(run, f"h bigint, item_id {words.schema['item_id'].dataType.simpleString()}")


def shared_filter(spark: SparkSession, hashed: DataFrame) -> RunFilter:
    """A filter of the column h, put together by the workers; what reaches the driver is bounded by
    MAX_FILTER_BITS, whatever the number of items."""
    h = hashed.select("h").distinct()
    bits = RunFilter.size_for(h.count())
    places = h.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)))).alias("at"))
    # the bit of a word of 64: shifts take whole numbers
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    f = np.zeros(bits // 64, np.uint64)
    f[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return RunFilter(f)


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 30, max_edits: int = 3, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "item_text") -> DataFrame:
    """(doc_id, item_id): documents that carry at least ``min_words`` words in a row of an item, of which at
    most ``max_edits`` are changed, missing or added. Each pair once per row of the documents.

    Words are runs of letters or digits in any case. Null and empty texts and items of fewer than
    ``min_words`` words match nothing; items with a null id are left out, of repeated item rows one counts;
    a document row that comes twice gives its pairs once. Items stay tables, of any number: one pass over
    the corpus, then joins of what it cut out.
    """
    p, spark = Passage(min_words, max_edits), documents.sparkSession
    work = Workspace(spark, "leaks")
    docs = pick(documents, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    its = pick(items, item_id=item_id_col, item_text=item_text_col).where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).distinct()
    # items that share an id are told apart until the end
    words = work.put("items", item_words(its, p).withColumn("item", F.monotonically_increasing_id()))
    number = words.select(F.col("item").alias("item_id"), "words")
    grams = work.put("grams", item_runs(number, p.q).withColumnRenamed("item_id", "item"))
    pieces = item_runs(number, p.piece)
    shared = spark.sparkContext.broadcast((shared_filter(spark, pieces), shared_filter(spark, grams)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        by_piece, by_gram = shared.value
        for batch in batches:
            for part in pa.Table.from_batches([batch]).to_batches(max_chunksize=2000):
                cut = cut_stretches(part.column(1).to_pylist(), p, by_piece, by_gram, known)
                if cut:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([c[0] for c in cut])), _lists([c[1] for c in cut]), _lists([c[2] for c in cut])], names=["doc_id", "text", "hits"])

    stretches = work.put("stretches", docs.mapInArrow(run, f"doc_id {kind}, text array<bigint>, hits array<bigint>").withColumn("stretch", F.monotonically_increasing_id()))
    hits = stretches.select("stretch", F.explode("hits").alias("h")).where("h <> 0")
    pairs = hits.join(broadcast_if_small(grams, MAX_BROADCAST_ROWS), "h").groupBy("stretch", "item").agg(F.count("*").alias("n")).where(F.col("n") >= p.least)
    both = pairs.join(stretches.select("stretch", "doc_id", "text"), "stretch").join(words.select("item", "item_id", "words"), "item")
    item_kind = words.schema["item_id"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pa.Table.from_batches([batch]).combine_chunks().to_batches(max_chunksize=1000):
                ok = verify_pairs(_arrays(part.column(2)), _arrays(part.column(3)), p)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["doc_id", "item_id"])

    return both.select("doc_id", "item_id", "text", "words").mapInArrow(decide, f"doc_id {kind}, item_id {item_kind}").distinct()
