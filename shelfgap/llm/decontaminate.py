"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance.

An item of m bytes, of any length, may be found with k = ERROR_SHARE * m
errors.  It is cut into k + 1 pieces: pairs of neighbours and, where k is even,
a longer single one.  k errors cannot put two into every pair and one into the
single piece, so of any occurrence either the single piece is free of errors,
or one piece of a pair is and its neighbour has at most one.  Exact hits of
pieces that pass this test of the neighbour are all places worth verifying, and
at those places the bit-parallel automaton computes the smallest distance of
the whole item to any substring.  Items are taken in blocks of bounded size;
each block meets all documents.

Both sides are normalised: A-Z lower-cased, and each run of bytes other than
letters, digits and non-ASCII bytes becomes one space.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as tk
from .common import row_key, shared_folder, text_or_empty, without_rows

ERROR_SHARE = 0.1
SEED_BYTES = 8               # the most of a piece that is looked up; no item's budget depends on it
BLOCK_BYTES = 4 << 20        # of item texts that are sent to the tasks at once
FILTER_BITS = 22
HITS_AT_ONCE = 1 << 20


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and offsets; documents begin and end without a space."""
    if not len(buf):
        return buf, offsets
    word = tk.ALNUM[buf] == 1
    out = np.where(word, tk.LOWER[buf], np.uint8(0x20))
    first = np.zeros(len(buf), bool)
    first[offsets[:-1][offsets[:-1] < len(buf)]] = True
    before = np.concatenate(([False], word[:-1])) & ~first
    keep = word | before                     # the first sign after a word stands for its run
    upto = np.concatenate(([0], np.cumsum(keep)))[offsets]
    out, ends = out[keep], upto[1:]
    if len(out):                             # a space at a document's end goes
        full = ends > upto[:-1]
        tail = ends[full] - 1
        drop = tail[out[tail] == 0x20]
        gone = np.zeros(len(out) + 1, np.int64)
        gone[drop + 1] = 1
        upto = upto - np.cumsum(gone)[upto]
        out = np.delete(out, drop)
    return out, upto


def normalise_text(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normalise(raw, np.array([0, len(raw)], np.int64))[0].tobytes()


def budget(m: int, share: float = ERROR_SHARE) -> int:
    """Errors allowed for an item of m bytes."""
    return max(0, min(int(share * m), m - 1))


def pieces(m: int, k: int) -> list[tuple[int, int, int, int]]:
    """k + 1 pieces, as (start, end, start and end of the piece's neighbour); a single one's is empty."""
    paired = m if k % 2 else m - max(1, 2 * m // (k + 2))
    n = k + k % 2
    cuts = [i * paired // n for i in range(n + 1)] if n else [0]
    out = []
    for a, b, c in zip(cuts[:-1:2], cuts[1::2], cuts[2::2]):
        out += [(a, b, b, c), (b, c, a, b)]
    return out if k % 2 else [*out, (paired, m, m, m)]


def begins(text: bytes, piece: bytes) -> bool:
    """Whether some beginning of the text is the piece with at most one error."""
    at = 0
    while at < len(piece) and at < len(text) and text[at] == piece[at]:
        at += 1
    return at >= len(piece) - 1 or any(text.startswith(piece[i:], j) for i, j in
                                       ((at + 1, at + 1), (at + 1, at), (at, at + 1)))


def best_match(item: bytes, text: bytes) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to ``item``, the first of equals (Myers 1999)."""
    m = len(item)
    if (at := text.find(item)) >= 0:
        return 0, at + m
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full                  # a match may start anywhere: no 1 enters
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def _span_hashes(spans: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in spans])
    return tk.Spans(np.frombuffer(b"".join(spans), np.uint8)).hash(ends - [len(x) for x in spans], ends)


class Index:
    """Seeds (beginnings of pieces) of a block of items, by length."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = ERROR_SHARE):
        self.items = [(i, t, budget(len(t), share)) for i, t in items if t]
        seeds: dict[int, list] = {}
        for number, (_, t, k) in enumerate(self.items):
            for a, b, c, d in pieces(len(t), k):
                seeds.setdefault(min(b - a, SEED_BYTES), []).append((number, a, b, c, d))
        self.seeds = {}
        for length, rows in seeds.items():
            texts = [self.items[r[0]][1] for r in rows]
            h = _span_hashes([t[a:a + length] for t, (_, a, _, _, _) in zip(texts, rows)])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << FILTER_BITS, bool)
            table[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            full = _span_hashes([t[a:b] for t, (_, a, b, _, _) in zip(texts, rows)])
            left = _span_hashes([t[c:(c + d) // 2] for t, (_, _, _, c, d) in zip(texts, rows)])
            right = _span_hashes([t[(c + d) // 2:d] for t, (_, _, _, c, d) in zip(texts, rows)])
            facts = np.array(rows, np.int64)
            _, a, b, c, d = facts.T
            # the halves of the neighbour, the nearer and the farther: start from the piece's start, bytes, hash
            after, half = c == b, (c + d) // 2
            near = np.where(after, c, half) - a, np.where(after, half - c, d - half), np.where(after, left, right)
            far = np.where(after, half, c) - a, np.where(after, d - half, half - c), np.where(after, right, left)
            self.seeds[length] = (h[order], table, facts[order], full[order], [x[order] for x in near],
                                  [x[order] for x in far])

    def hits(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, start its first byte would have) for every exact hit of a piece inside a document
        whose neighbour may be beside it with at most one error."""
        spans = tk.Spans(buf)
        n, raw = len(buf), buf.tobytes()

        def equal(start, size, wanted):
            inside = (start >= 0) & (start + size <= n)
            start = np.where(inside, start, 0)
            return inside & (spans.hash(start, np.where(inside, start + size, 0)) == wanted)

        for length, (h, table, facts, full, near, far) in self.seeds.items():
            if n < length:
                continue
            start = np.arange(n - length + 1)
            seen = spans.hash(start, start + length)
            at = np.flatnonzero(table[(seen >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(h, seen[at], "left"), np.searchsorted(h, seen[at], "right")
            at, lo, times = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # a seed that many items share makes many rows at a place: they are formed in portions
            upto = np.concatenate(([0], np.cumsum(times)))
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + HITS_AT_ONCE, "right")) - 1)
                pos = np.repeat(at[i:j], times[i:j])
                row = np.arange(len(pos)) + np.repeat(lo[i:j] - (upto[i:j] - upto[i]), times[i:j])
                i = j
                doc = np.searchsorted(offsets, pos, "right") - 1
                size = facts[row, 2] - facts[row, 1]
                good = np.flatnonzero((pos + size <= offsets[doc + 1]) & equal(pos, size, full[row]))
                pos, row, doc = pos[good], row[good], doc[good]
                # with at most one error in the neighbour one half is whole; the farther one may have moved
                near_at, near_size, near_hash = (x[row] for x in near)
                may = equal(pos + near_at, near_size, near_hash)
                far_at, far_size, far_hash = (x[row] for x in far)
                for moved in (-1, 0, 1):
                    may |= equal(pos + far_at + moved, far_size, far_hash)
                for p, (number, a, b, c, d), where in zip(pos[may].tolist(), facts[row[may]].tolist(),
                                                          doc[may].tolist()):
                    piece = self.items[number][1][c:d]
                    if (begins(raw[p + b - a:p + b - a + len(piece) + 1], piece) if c == b else
                            begins(raw[max(p - len(piece) - 1, 0):p][::-1], piece[::-1])):
                        yield where, number, p - a

    def search(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item number, distance, end) of the best match within budget, per document and item."""
        places: dict[tuple[int, int], set[int]] = {}
        for doc, number, start in self.hits(buf, offsets):
            places.setdefault((doc, number), set()).add(start)
        for (doc, number), starts in places.items():
            _, item, k = self.items[number]
            m, best = len(item), None
            lo, hi = int(offsets[doc]), int(offsets[doc + 1])
            reach = None
            for start in [*sorted(starts), None]:
                # windows that overlap are searched as one
                if start is not None and reach is not None and start - k <= reach[1]:
                    reach = (reach[0], start + m + k)
                    continue
                if reach is not None:
                    a, b = max(lo, reach[0]), min(hi, reach[1])
                    if b > a:
                        distance, end = best_match(item, buf[a:b].tobytes())
                        if distance <= k and (best is None or distance < best[0]):
                            best = (distance, a + end - lo)
                reach = None if start is None else (start - k, start + m + k)
            if best is not None:
                yield doc, number, *best


def matches(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, doc_id: str = "doc_id",
            text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end): items found in documents, the nearest place of each.

    An item of m normalised bytes is found with up to ``share`` * m errors, rounded down, whatever m is.
    ``end`` is where the match ends in the normalised document, in bytes.  A
    document is searched whole.  Ids of either side keep their types.  Null or
    empty documents and items match nothing; repeated documents each get their
    rows, repeated items theirs.  Items are found inside words too: one of a
    single letter is in every document that holds the letter.  Empty tables
    give an empty result.  Only the named columns are read, so others may have
    any name.

    Items are read in blocks of about BLOCK_BYTES, one block at the driver at a
    time; each is broadcast, searched in all documents and its finds landed
    before the next is read, so plan and memory keep their size.
    """
    if not 0 <= share < 1:
        raise ValueError("share is from 0 to less than 1: with 1, any text would hold any item")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    bench = items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("t"))
    size = bench.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    kind = rows.schema["doc_id"].dataType.simpleString()
    item_type = bench.schema["item_id"].dataType
    arrow_type = to_arrow_type(item_type)
    found = f"doc_id {kind}, item_id {item_type.simpleString()}, distance int, end long"
    path = f"{shared_folder(spark)}/llm-decontaminate-found-{uuid.uuid4().hex}"
    for b in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], normalise_text(r["t"])) for r in own])

        def run(it, shared=shared):
            index = Index(shared.value, share)
            for batch in it:
                raw, off = tk.binary_parts(batch.column("text"))
                for lo, hi in tk.doc_chunks(off):
                    buf, ends = normalise(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                    out = list(index.search(buf, ends))
                    if out:
                        doc, number, distance, end = zip(*out)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array([lo + d for d in doc])),
                             pa.array([index.items[n][0] for n in number], arrow_type),
                             pa.array(distance, pa.int32()), pa.array(end, pa.int64())],
                            names=["doc_id", "item_id", "distance", "end"])

        rows.mapInArrow(run, found).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(found).parquet(path).withColumnRenamed("doc_id", doc_id)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, each by its own text, whatever its id."""
    rows = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    found = matches(rows, items, doc_id="row", **options).select("row")
    return without_rows(docs, found, (doc_id, text), "decontaminate-rows")
