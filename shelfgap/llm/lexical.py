"""Ranked lexical search over bit-sliced Bloom signatures.

Documents are the rows of blocks, and a block's slice is the bitmap of the rows
that have one bit of their Bloom signature set.  Signatures hold a document's
terms, and again those that occur twice, three times and so on (``LEVELS``).  A
term's rows at a level are the intersection of its slices: a superset of the
rows that hold it so often, never less.  Sums of these bitmaps, weighted by the
items' term weights, give an upper bound of every document's score.

A first look takes each item's best bounds and scores these documents exactly:
the last of the best so found is a floor.  A second look takes every document
whose bound reaches the floor; they are scored exactly from their texts and
ranked.  What is left out is proven to be lower, so the result is exact.

Blocks hold documents of about the same number of terms, as a signature is wide
in proportion to them.  Terms are named by 64-bit hashes; N of them collide with
probability about N * N / 2^65.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .ann import _Heaps
from .common import land, prefilter, shared_folder, text_or_empty

K = 10
LEVELS = (1, 2, 3, 5, 9)      # occurrences that are told apart
BITS_PER_ENTRY = 10           # a signature's width at least, per (term, level)
HASHES = 4
BLOCK_BITS = 1 << 24
BLOCK_ROWS = 4096
FILTER_BITS = 1 << 23         # one filter of all items' terms, whatever their number
PASS_TERMS = 200_000          # (item, term) pairs that are broadcast at once
GROUP_TERMS = 4096            # terms whose bitmaps are held at once
EMIT_TERMS = 1 << 18
NO_ID = np.iinfo(np.int64).max
_BLOCK = ("width int, ids binary, lengths binary, most binary, slices binary, docs long, words long, "
          "terms binary, holders binary")


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of each distinct term of each document, and the documents' lengths."""
    words, bounds = tk.word_hashes(buf, offsets, tk.ALNUM)
    lengths = np.diff(bounds)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((words, doc))
    doc, words = doc[order], words[order]
    if not len(words):
        return doc, words, np.zeros(0, np.int64), lengths
    at = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[at], words[at], np.diff(np.append(at, len(words))), lengths


def places(terms: np.ndarray, level: int, width: int) -> np.ndarray:
    """Bits of (term, level) in a signature of ``width`` bits, a power of two: a row of HASHES per term."""
    h = tk.mix(terms + np.uint64(level * int(tk.BASE) % (1 << 64)))
    first, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(width - 1)).astype(np.int64)


class _Widths:
    """Documents waiting for a block of their width."""

    def __init__(self):
        self.held: dict[int, list] = {}

    def add(self, doc_id: int, length: int, terms: np.ndarray, tf: np.ndarray) -> pa.RecordBatch | None:
        entries = sum(int((tf >= level).sum()) for level in LEVELS)
        width = 1 << max(6, (BITS_PER_ENTRY * entries - 1).bit_length())
        rows = self.held.setdefault(width, [])
        rows.append((doc_id, length, terms, tf))
        if len(rows) >= BLOCK_ROWS or len(rows) * width >= BLOCK_BITS:
            return self._block(width)
        return None

    def rest(self) -> Iterator[pa.RecordBatch]:
        for width in list(self.held):
            yield self._block(width)

    def _block(self, width: int) -> pa.RecordBatch:
        rows = self.held.pop(width)
        across = -(-len(rows) // 8) * 8
        bits = np.zeros(width * across, bool)
        for i, (_, _, terms, tf) in enumerate(rows):
            for level in LEVELS:
                own = terms[tf >= level]
                if not len(own):
                    break
                bits[places(own, level, width) * across + i] = True
        slices = np.packbits(bits.reshape(width, across), axis=1)
        return _record(width, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64),
                       np.array([int(r[3].max()) for r in rows], np.int64), slices)


def _record(width=None, ids=None, lengths=None, most=None, slices=None, terms=None, holders=None) -> pa.RecordBatch:
    def raw(x):
        return pa.array([None if x is None else x.tobytes()], pa.binary())

    counts = (0, 0) if lengths is None else (len(lengths), int(lengths.sum()))
    return pa.RecordBatch.from_arrays(
        [pa.array([width], pa.int32()), raw(ids), raw(lengths), raw(most), raw(slices), pa.array([counts[0]], pa.int64()),
         pa.array([counts[1]], pa.int64()), raw(terms), raw(holders)],
        names=["width", "ids", "lengths", "most", "slices", "docs", "words", "terms", "holders"])


def _sign(wanted):
    """Signature blocks, and how many documents hold each term that passes the filter ``wanted``."""
    def counted(parts):
        terms, of = np.unique(np.concatenate(parts), return_inverse=True)
        return _record(terms=terms, holders=np.bincount(of).astype(np.int64))

    def run(it):
        passes = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        widths, seen, held = _Widths(), [], 0
        for batch in it:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            buf, off = tk.binary_parts(batch.column("text"))
            for a, b in tk.doc_chunks(off):
                doc, terms, tf, lengths = terms_of(buf[off[a]:off[b]], off[a:b + 1] - off[a])
                known = terms[passes[(terms >> np.uint64(20)) & np.uint64(FILTER_BITS - 1)]]
                seen.append(known)
                held += len(known)
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                for i in np.flatnonzero(lengths).tolist():
                    block = widths.add(int(ids[a + i]), int(lengths[i]), terms[ends[i]:ends[i + 1]],
                                       tf[ends[i]:ends[i + 1]])
                    if block is not None:
                        yield block
                if held >= EMIT_TERMS:
                    yield counted(seen)
                    seen, held = [], 0
        yield from widths.rest()
        if held:
            yield counted(seen)
    return run


def _filter(items: DataFrame) -> bytes:
    """The bits of all items' terms: each task sends FILTER_BITS, and the driver holds two such at a time."""
    def run(it):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in it:
            for terms in batch.column("terms"):
                bits[(np.frombuffer(terms.as_buffer(), np.uint64) >> np.uint64(20)) & np.uint64(FILTER_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], names=["bits"])

    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in items.mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total.tobytes()


def _item_terms(it):
    """(item_no, terms, counts) of the items that have terms."""
    for batch in it:
        buf, off = tk.binary_parts(batch.column("text"))
        doc, terms, tf, lengths = terms_of(buf, off)
        ends = np.searchsorted(doc, np.arange(len(off)))
        some = np.flatnonzero(lengths).tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_no").take(pa.array(some, pa.int64())),
             pa.array([terms[ends[i]:ends[i + 1]].tobytes() for i in some], pa.binary()),
             pa.array([tf[ends[i]:ends[i + 1]].tobytes() for i in some], pa.binary())],
            names=["item_no", "terms", "counts"])


def _unpacked(keep: str, values: str):
    """Rows (key, term, value) of packed terms with values beside them."""
    def run(it):
        for batch in it:
            for r in range(batch.num_rows):
                term = np.frombuffer(batch.column("terms")[r].as_py(), np.int64)
                value = np.frombuffer(batch.column(values)[r].as_py(), np.int64)
                columns = [pa.array(term), pa.array(value)]
                if keep:
                    columns.insert(0, pa.array(np.full(len(term), batch.column(keep)[r].as_py(), np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=[*([keep] if keep else []), "term", values])
    return run


@dataclass
class Asked:
    """One pass of items: numbers, and each one's terms with their weights times their repeats."""

    numbers: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    docs: int
    words: int

    def groups(self) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
        """(first item, last, distinct terms, the places of each item's terms among them)."""
        at = 0
        while at < len(self.terms):
            to, size = at + 1, len(self.terms[at])
            while to < len(self.terms) and size + len(self.terms[to]) <= GROUP_TERMS:
                size += len(self.terms[to])
                to += 1
            distinct = np.unique(np.concatenate(self.terms[at:to]))
            yield at, to, distinct, [np.searchsorted(distinct, t) for t in self.terms[at:to]]
            at = to

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """A document's m."""
        return 25 + (75 * lengths * self.docs) // max(self.words, 1)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def bounds(asked: Asked, groups: list, width: int, lengths: np.ndarray, most: np.ndarray,
           slices: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item's place, an upper bound of its score for each row of the block)."""
    rows = len(lengths)
    m = asked.damping(lengths)
    top = [*[np.minimum(level - 1, most) for level in LEVELS[1:]], most]
    gains = np.diff(np.array([gain(t, m) for t in top]), axis=0, prepend=0).astype(float)
    for first, last, distinct, of in groups:
        total = np.zeros((last - first, rows))
        present, own = None, np.arange(len(distinct))
        for gained, level in zip(gains, LEVELS):
            now = np.bitwise_and.reduce(slices[places(distinct[own], level, width)], axis=1)
            if present is not None:
                now &= present
            some = now.any(axis=1)
            own, present = own[some], now[some]
            if not len(own):
                break
            bitmap = np.unpackbits(present, axis=1)[:, :rows]
            row = np.full(len(distinct), -1)
            row[own] = np.arange(len(own))
            for i, terms in enumerate(of):
                have = row[terms]
                held = have >= 0
                if held.any():
                    total[i] += gained * (asked.weights[first + i][held] @ bitmap[have[held]])
        for i in range(last - first):
            # sums of more terms may round; others are exact in a double
            yield first + i, total[i] * (1 + 1e-9) if len(asked.terms[first + i]) > 100_000 else total[i]


def _blocks_of(batch: pa.RecordBatch):
    for r in range(batch.num_rows):
        width, ids, lengths, most, slices = (batch.column(c)[r].as_py() for c in
                                             ("width", "ids", "lengths", "most", "slices"))
        yield (width, *(np.frombuffer(x, np.int64) for x in (ids, lengths, most)),
               np.frombuffer(slices, np.uint8).reshape(width, -1))


def _best_bounds(shared, k: int):
    """First look: per task and item the ``k`` best bounds."""
    def run(it):
        asked = Asked(*shared.value)
        groups, heaps = list(asked.groups()), _Heaps(len(asked.terms), k)
        for batch in it:
            for width, ids, lengths, most, slices in _blocks_of(batch):
                for i, bound in bounds(asked, groups, width, lengths, most, slices):
                    good = np.flatnonzero((bound > 0) & (bound >= heaps.scores[i, -1]))
                    if len(good) > k:        # of a block's best bounds the smallest ids
                        good = good[np.lexsort((ids[good], -bound[good]))[:k]]
                    if len(good):
                        heaps.push(np.full(len(good), i), bound[good], ids[good])
        found = np.isfinite(heaps.scores)
        number = np.repeat(asked.numbers, found.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(heaps.ids[found]), pa.array(heaps.scores[found])],
                                         names=["item_no", "doc_id", "bound"])
    return run


def _reaching(shared, floors):
    """Second look: the documents whose bound reaches the floor (score, id) of an item."""
    def run(it):
        asked, (least, last_id) = Asked(*shared.value), floors.value
        groups = list(asked.groups())
        for batch in it:
            for width, ids, lengths, most, slices in _blocks_of(batch):
                for i, bound in bounds(asked, groups, width, lengths, most, slices):
                    good = (bound > least[i]) | ((bound == least[i]) & (ids <= last_id[i]))
                    if good.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(int(good.sum()), asked.numbers[i])), pa.array(ids[good])],
                            names=["item_no", "doc_id"])
    return run


def _scores(shared, k: int):
    """Exact scores of documents for the items that each is to be scored for; a task's best."""
    def run(it):
        asked = Asked(*shared.value)
        place = {int(n): i for i, n in enumerate(asked.numbers)}
        heaps = _Heaps(len(asked.terms), k)
        for batch in it:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            wanted = batch.column("items").to_pylist()
            buf, off = tk.binary_parts(batch.column("text"))
            for a, b in tk.doc_chunks(off):
                doc, terms, tf, lengths = terms_of(buf[off[a]:off[b]], off[a:b + 1] - off[a])
                ends, m = np.searchsorted(doc, np.arange(b - a + 1)), asked.damping(lengths)
                for d in np.flatnonzero(lengths).tolist():
                    own, times = terms[ends[d]:ends[d + 1]], tf[ends[d]:ends[d + 1]]
                    which = np.array([place[n] for n in wanted[a + d]])
                    score = np.zeros(len(which))
                    for j, i in enumerate(which):
                        at = np.minimum(np.searchsorted(own, asked.terms[i]), len(own) - 1)
                        held = own[at] == asked.terms[i]
                        score[j] = (asked.weights[i][held].astype(np.int64) * gain(times[at[held]], m[d])).sum()
                    good = score > 0
                    if good.any():
                        heaps.push(which[good], score[good], np.full(int(good.sum()), ids[a + d]))
        found = np.isfinite(heaps.scores)
        number = np.repeat(asked.numbers, found.sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), pa.array(heaps.ids[found]), pa.array(heaps.scores[found].astype(np.int64))],
            names=["item_no", "doc_id", "score"])
    return run


def _ranked(scored: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy("item_no").orderBy(F.desc(by), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rescored(rows: DataFrame, pairs: DataFrame, shared, k: int) -> DataFrame:
    """The best exact scores of the landed ``pairs`` (item_no, doc_id)."""
    wanted = land(pairs.distinct().groupBy("doc_id").agg(F.collect_list("item_no").alias("items")), "lexical-wanted")
    return _ranked(prefilter(rows, wanted, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "items")
                   .mapInArrow(_scores(shared, k), "item_no long, doc_id long, score long"), k, "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of the highest score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII,
    with A-Z lower-cased.  With N documents that hold a term, L terms in all, n
    in the document, df documents that hold the term and tf occurrences, the
    score sums floor(1000 ln((2 N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 8 m)) over
    the item's terms, repeats included, where m = 25 + 75 n N div L.

    Equal scores go by ascending id; null ids rank last and stay null.  Rows
    that share an id are ranked each by itself, also rows repeated whole, and so
    are items.  Null and empty texts hold no term and are not found; such items
    find nothing.  Texts are read whole.  Empty tables give an empty result.
    Only the named columns are read, and ids of documents are taken as long.

    Items are asked in passes of PASS_TERMS (item, term) pairs, each landed in
    one folder, so plan and broadcast keep their size however many there are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("doc_id"),
                       text_or_empty(text).alias("text"))
    asked_items = land(items.select(F.monotonically_increasing_id().alias("item_no"), F.col(item_id).alias("item_id"),
                                    text_or_empty(item_text).alias("text")), "lexical-items")
    packed = land(asked_items.select("item_no", "text").mapInArrow(
        _item_terms, "item_no long, terms binary, counts binary"), "lexical-item-terms")

    wanted = spark.sparkContext.broadcast(_filter(packed))
    signed = land(rows.mapInArrow(_sign(wanted), _BLOCK), "lexical-signatures")
    size = signed.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs, n_words = int(size["docs"] or 0), int(size["words"] or 0)
    blocks = signed.where("width is not null").select("width", "ids", "lengths", "most", "slices")
    holders = (signed.where("terms is not null").select("terms", "holders")
               .mapInArrow(_unpacked("", "holders"), "term long, holders long")
               .groupBy("term").agg(F.sum("holders").alias("df")))
    pairs = packed.mapInArrow(_unpacked("item_no", "counts"), "item_no long, term long, counts long")
    weighed = land(pairs.join(holders, "term", "left").select("item_no", "term", "counts", F.coalesce("df", F.lit(0)).alias("df")),
                   "lexical-weights")

    passes = -(-weighed.count() // PASS_TERMS)
    path = f"{shared_folder(spark)}/llm-lexical-found-{uuid.uuid4().hex}"
    kind = "item_no long, rank int, doc_id long, score long"
    spark.createDataFrame([], kind).write.parquet(path)
    for i in range(passes):
        mine = weighed.where(F.pmod(F.xxhash64("item_no"), F.lit(passes)) == i).orderBy("item_no", "term").collect()
        asked = _asked(mine, n_docs, n_words)
        shared = spark.sparkContext.broadcast((asked.numbers, asked.terms, asked.weights, n_docs, n_words))
        first = _ranked(blocks.mapInArrow(_best_bounds(shared, k), "item_no long, doc_id long, bound double"), k, "bound")
        known = _rescored(rows, first.select("item_no", "doc_id"), shared, k).where(F.col("rank") == k)
        place = {int(n): j for j, n in enumerate(asked.numbers)}
        least, last_id = np.full(len(place), 1.0), np.full(len(place), NO_ID)
        for r in known.collect():
            least[place[r["item_no"]]], last_id[place[r["item_no"]]] = r["score"], r["doc_id"]
        floors = spark.sparkContext.broadcast((least, last_id))
        reaching = blocks.mapInArrow(_reaching(shared, floors), "item_no long, doc_id long")
        (_rescored(rows, reaching, shared, k).select("item_no", "rank", "doc_id", "score")
         .write.mode("append").parquet(path))
    found = spark.read.schema(kind).parquet(path)
    return (found.join(asked_items.select("item_no", "item_id"), "item_no")
            .select("item_id", "rank", F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "score"))


def _asked(rows: list, docs: int, words: int) -> Asked:
    """The items of one pass; ``rows`` are ordered by item and term."""
    held: dict[int, tuple[list, list]] = {}
    for r in rows:
        weight = math.floor(1000 * math.log((2 * docs + 2) / (2 * r["df"] + 1)))
        terms, weights = held.setdefault(r["item_no"], ([], []))
        terms.append(r["term"])
        weights.append(weight * r["counts"])
    return Asked(np.array(list(held), np.int64), [np.array(t, np.int64).view(np.uint64) for t, _ in held.values()],
                 [np.array(w, float) for _, w in held.values()], docs, words)
