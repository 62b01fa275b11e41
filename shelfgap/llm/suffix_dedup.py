"""Removal of repeated byte strings by suffix sorting to a fixed depth over a difference cover.

A string of ``min_bytes`` that starts at p and at q is found in two sorts.

Cover sort.  The positions whose remainder modulo v lies in a difference cover
are the cover sample (9 % for v = 133).  For any p and q some d < v makes
p + d and q + d both sampled, and the min_bytes - v + 1 bytes from there on lie
inside both strings.  Sampled suffixes are sorted to that depth; those equal to
another are ties.

Suffix sort.  Only strings that contain a tied sample can repeat: the other
suffixes, four fifths of a corpus, are settled by their cover ranks.  The rest
are sorted to full depth.

Both sorts go bucket by bucket: a bucket is a share of hash space, and a task
sorts its buckets one after the other, so memory is bounded by a bucket.  Equal prefixes
are recognised by rolling hashes in place of an alphabetical order, which
equality does not need: 64 bits and the bucket's number in the suffix sort.
Cover hashes are short, as a false tie only costs work.

A string frequent in one batch of texts is settled there and sends one mark to
its bucket, so a passage in a third of all documents does not fill a bucket.
Exact copies are one text throughout, named by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import textkit as tk
from .common import BROADCAST_ROWS, free_shuffles, land, prefilter, shuffle_partitions, text_or_empty

MIN_BYTES = 200
CHUNK_BYTES = 1 << 20        # of text hashed at once
SLICE = 1 << 18              # positions looked up at once
EMIT_ENTRIES = 1_000_000     # positions held between emissions; with the two above it bounds a task's memory
TASK_BYTES = 128 << 20       # of text per sorting task at most: tasks grow in number, not in size
BUCKET_BYTES = 4 << 20       # of text per bucket; a task sorts its buckets and lets them go one after the other
MAX_BUCKETS = 8              # of a task: with more, batches would be cut into too many rows
# fixed values: perfect difference sets by modulus
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121),
}


def cover_for(min_bytes: int) -> tuple[int, np.ndarray]:
    """Modulus and cover: the largest that leaves a third of the string for comparing."""
    v = max((m for m in COVERS if 3 * m <= 2 * min_bytes), default=0)
    if not v:
        raise ValueError("min_bytes must be 11 at least")
    inside = np.zeros(v, bool)
    inside[list(COVERS[v])] = True
    return v, inside


def _planes(values: np.ndarray) -> bytes:
    """uint32 values as four planes of bytes, which compress well when values are small."""
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _by_bucket(buckets: np.ndarray):
    """Numbers of the buckets that have entries, with the positions of these: few of very many buckets may have."""
    order = np.argsort(buckets, kind="stable")
    found = buckets[order]
    ends = np.append(tk.group_starts(found), len(found)).tolist()
    for a, b in zip(ends, ends[1:]):
        yield int(found[a]), order[a:b]


class _Batch:
    """Hashed positions of a few MB of distinct texts, for one emission."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys: dict[int, int] = {}
        self.clear_entries()

    def clear_entries(self):
        self.hashes, self.buckets, self.docs, self.places, self.entries = [], [], [], [], 0

    def add(self, hashes, buckets, docs, places):
        self.hashes.append(hashes)
        self.buckets.append(buckets.astype(np.int32))
        self.docs.append(docs.astype(np.int32))
        self.places.append(places.astype(np.uint32))
        self.entries += len(hashes)

    def rows(self, buckets: int, width: int):
        """(kind, bucket, hashes, keys, counts, places) rows.

        ``ask``: hashes that occur once here, with their place.  ``mark``: hashes
        that occur at several places here.  ``own``: the places of the marked.
        Hashes are stored in ``width`` bytes; the bucket comes from another hash.
        """
        if not self.hashes:
            return []
        keys = np.array(list(self.keys), np.int64)
        h, bucket = np.concatenate(self.hashes), np.concatenate(self.buckets)
        docs, places = np.concatenate(self.docs), np.concatenate(self.places)
        self.clear_entries()
        if not len(h):
            return []
        order = np.argsort(h, kind="stable")
        at = tk.group_starts(h[order])
        sizes = np.diff(np.append(at, len(h)))
        many = np.empty(len(h), bool)
        many[order] = np.repeat(sizes > 1, sizes)
        marked = order[at[sizes > 1]]
        del order, at, sizes
        stored = h.astype(np.uint32) if width == 4 else h
        out = []

        def entries(kind, pick, buckets_of):
            for b, i in _by_bucket(buckets_of):
                i = pick[i]
                d = docs[i]
                first = tk.group_starts(d)
                delta = places[i].astype(np.int64)
                step = np.diff(delta, prepend=0)
                step[first] = delta[first]
                out.append((kind, b, stored[i].tobytes() if kind == "ask" else b"", keys[d[first]].tobytes(),
                            np.diff(np.append(first, len(i))).astype(np.uint32).tobytes(), _planes(step)))

        single = np.flatnonzero(~many)
        entries("ask", single, bucket[single])
        for b, i in _by_bucket(bucket[marked]):
            out.append(("mark", b, stored[marked[i]].tobytes(), b"", b"", b""))
        own = np.flatnonzero(many)
        entries("own", own, docs[own] % buckets)
        return out


FIELDS = [("kind", pa.string()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("keys", pa.binary()),
          ("counts", pa.binary()), ("places", pa.binary())]
ASK = "kind string, bucket int, hashes binary, keys binary, counts binary, places binary"
FOUND = "bucket int, keys binary, counts binary, places binary"


def _record(rows, fields):
    schema = pa.schema(fields)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                      schema=schema)


def _texts(batch: pa.RecordBatch, held: _Batch):
    """Chunks of distinct texts: (bytes, offsets, document numbers, row numbers)."""
    buf, off = tk.binary_parts(batch.column("text"))
    keys = batch.column("key").to_pylist()
    for a, b in tk.doc_chunks(off, CHUNK_BYTES):
        rows = []
        for i in range(a, b):
            if keys[i] not in held.keys:
                held.keys[keys[i]] = len(held.keys)
                rows.append(i)
        if rows:
            r = np.array(rows)
            if len(rows) == b - a:
                yield buf[off[a]:off[b]], off[a:b + 1] - off[a], r, np.array([held.keys[keys[i]] for i in rows])
            else:
                parts = [buf[off[i]:off[i + 1]] for i in rows]
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                yield np.concatenate(parts), offsets, r, np.array([held.keys[keys[i]] for i in rows])


def _probe(buckets: int, width: int, positions):
    """Map side: ``positions(batch, rows, offsets)`` gives (flat positions, length to hash)."""
    def run(it):
        held = _Batch()
        for batch in it:
            for buf, off, rows, docs in _texts(batch, held):
                at, depth = positions(batch, rows, off)
                first = tk.Spans(buf)
                second = tk.Spans(buf, second=True) if width == 8 and len(at) else None
                for i in range(0, len(at), SLICE):
                    own = at[i:i + SLICE]
                    h = first.hash(own, own + depth)
                    other = second.hash(own, own + depth) if second else tk.mix(h + tk.BASE)
                    doc = np.searchsorted(off, own, "right") - 1
                    held.add(h, tk.bucket_of(other, buckets), docs[doc], own - off[doc])
                    if held.entries >= EMIT_ENTRIES and (rows_out := held.rows(buckets, width)):
                        yield _record(rows_out, FIELDS)
                if held.entries >= EMIT_ENTRIES // 2 or len(held.keys) >= EMIT_ENTRIES:
                    if rows_out := held.rows(buckets, width):
                        yield _record(rows_out, FIELDS)
                    held.clear()
        if rows_out := held.rows(buckets, width):
            yield _record(rows_out, FIELDS)
    return run


def _sampled(min_bytes: int):
    """Positions of the cover sample."""
    v, inside = cover_for(min_bytes)
    depth = min_bytes - v + 1

    def positions(batch, rows, off):
        n = np.diff(off)
        # a text is longer than 32 bits only where it is alone in its chunk
        small = np.int32 if off[-1] < 1 << 31 else np.int64
        local = np.arange(off[-1], dtype=small) - np.repeat(off[:-1].astype(small), n)
        ok = local <= np.repeat(np.where(n >= min_bytes, n - depth, -1).astype(small), n)
        local %= v
        ok &= inside[local]
        return np.flatnonzero(ok), depth
    return positions


def _suspects(min_bytes: int):
    """Positions of strings that contain a tied sample."""
    v, _ = cover_for(min_bytes)

    def positions(batch, rows, off):
        total = int(off[-1])
        change = np.zeros(total + 1, np.int32)
        ties = batch.column("ties")
        for i, row in enumerate(rows.tolist()):
            n = int(off[i + 1] - off[i])
            s = _starts(ties[row])
            lo, hi = np.maximum(s - v + 1, 0), np.minimum(s, n - min_bytes)
            good = hi >= lo
            np.add.at(change, off[i] + lo[good], 1)
            np.add.at(change, off[i] + hi[good] + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int32) > 0), min_bytes
    return positions


def _expand(counts: bytes, keys: bytes, places: bytes):
    counts = np.frombuffer(counts, np.uint32)
    steps = _from_planes(places).astype(np.int64)
    sums = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    base = sums[first] - steps[first]
    return np.repeat(np.frombuffer(keys, np.int64), counts), sums - np.repeat(base, counts)


def _answers(keys: np.ndarray, places: np.ndarray, buckets: int):
    """The texts' places, by the texts' home partitions."""
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order].astype(np.int64)
    rows = []
    for b, i in _by_bucket(tk.bucket_of(tk.mix(keys.view(np.uint64)), buckets)):
        first, step = tk.group_starts(keys[i]), np.diff(places[i], prepend=0)
        step[first] = places[i][first]
        rows.append((b, keys[i][first].tobytes(), np.diff(np.append(first, len(i))).astype(np.uint32).tobytes(),
                     _planes(step)))
    yield _record(rows, [("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
                         ("places", pa.binary())])


def _one_by_one(it, fields):
    """Lists of a bucket's rows of ``fields``, bucket after bucket; rows come in their order."""
    own, rows = None, []
    for batch in it:
        buckets = batch.column("bucket").to_pylist()
        columns = [batch.column(f) for f in fields]
        for r, bucket in enumerate(buckets):
            if bucket != own:
                if rows:
                    yield rows
                own, rows = bucket, []
            rows.append([c[r].as_py() for c in columns])
    if rows:
        yield rows


def _gather(it):
    """One row of sorted places per text."""
    for rows in _one_by_one(it, ("keys", "counts", "places")):
        parts = [_expand(counts, keys, places) for keys, counts, places in rows]
        k = np.concatenate([x for x, _ in parts])
        p = np.concatenate([x.astype(np.uint32) for _, x in parts])
        order = np.lexsort((p, k))
        k, p = k[order], p[order]
        ends = np.append(tk.group_starts(k), len(k)).tolist()
        spans = list(zip(ends[:-1], ends[1:]))
        for i in range(0, len(spans), 5000):
            yield _record([(int(k[a]), _planes(np.diff(np.unique(p[a:b]).astype(np.int64), prepend=0)))
                           for a, b in spans[i:i + 5000]], [("key", pa.int64()), ("ties", pa.binary())])


def _starts(ties: pa.Scalar) -> np.ndarray:
    return np.cumsum(_from_planes(ties.as_py()).astype(np.int64))


def _sort_bucket(width: int, buckets: int):
    """Reduce side: places whose hash stands at another place too, by text."""
    def run(it):
        for rows in _one_by_one(it, ("kind", "hashes", "keys", "counts", "places")):
            hashes, keys, places, marks = [], [], [], []
            while rows:
                kind, h, k, c, p = rows.pop()
                if kind == "own":
                    yield from _answers(*_expand(c, k, p), buckets)
                    continue
                h = np.frombuffer(h, np.uint32 if width == 4 else np.uint64)
                if kind == "mark":
                    marks.append(h)
                    continue
                key, place = _expand(c, k, p)
                hashes.append(h)
                keys.append(key)
                places.append(place.astype(np.uint32))
            if not hashes:
                continue
            h, k, p = np.concatenate(hashes), np.concatenate(keys), np.concatenate(places)
            del hashes, keys, places
            order = np.argsort(h)
            h, k, p = h[order], k[order], p[order]
            at = tk.group_starts(h)
            sizes = np.diff(np.append(at, len(h)))
            # an exact copy of the text read elsewhere is the same place
            differs = (k != np.repeat(k[at], sizes)) | (p != np.repeat(p[at], sizes))
            tied = np.logical_or.reduceat(differs, at)
            if marks:
                tied |= np.isin(h[at], np.concatenate(marks))
            pick = np.repeat(tied, sizes)
            if pick.any():
                yield from _answers(k[pick], p[pick], buckets)
    return run


def _find(rows: DataFrame, positions, width: int, size: int, name: str) -> DataFrame:
    tasks = max(shuffle_partitions(rows.sparkSession), -(-size // TASK_BYTES))
    buckets = tasks * min(MAX_BUCKETS, max(1, -(-size // (tasks * BUCKET_BYTES))))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    found = dealt(dealt(rows.mapInArrow(_probe(buckets, width, positions), ASK))
                  .mapInArrow(_sort_bucket(width, buckets), FOUND)).mapInArrow(_gather, "key long, ties binary")
    found = land(found, name)
    free_shuffles(rows.sparkSession)
    return found


def _with(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with landed ``keys`` on key; they are broadcast where their count is within BROADCAST_ROWS."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key", how)


def copied_texts(docs: DataFrame, doc_id: str, min_bytes: int, text: str) -> tuple[DataFrame, int]:
    """(key, row) of the texts of ``min_bytes`` or more that several rows hold, with the one row that
    stands for them; and the bytes of all such texts, counted in the same pass."""
    full = text_or_empty(text)
    seen = Observation()
    rows = docs.select(F.xxhash64(full).alias("key"), F.xxhash64(F.col(doc_id)).alias("row"),
                       F.octet_length(full).cast("long").alias("n")).where(F.col("n") >= min_bytes)
    copies = (rows.observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).groupBy("key")
              .agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")).where("copies > 1"))
    copies = land(copies.select("key", "row"), "dedup-copies")
    try:
        return copies, int(seen.get["bytes"])
    except Py4JJavaError:      # the optimiser found that there are no rows, so none were observed
        return copies, 0


def repeated_places(docs: DataFrame, min_bytes: int = MIN_BYTES, text: str = "text", doc_id: str = "doc_id",
                    copied: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(key, ties): per distinct text (key = xxhash64 of it) the starts of strings that start elsewhere too.

    Starts that repeat only because the whole text has exact copies are left
    out; ``remove_repeats`` settles copies by themselves.  Of a copied text one
    row alone takes part, so copies do not move.
    """
    copies, size = copied or copied_texts(docs, doc_id, min_bytes, text)
    rows = docs.select(text_or_empty(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("row"))
    rows = rows.where(F.octet_length("text") >= min_bytes).withColumn("key", F.xxhash64("text"))
    rows = _with(rows, copies.select("key", F.col("row").alias("stands")), "left")
    rows = rows.where("stands is null or stands = row").select("key", "text")
    ties = _find(rows, _sampled(min_bytes), 4, size, "dedup-ties")
    return _find(prefilter(rows, ties, "key").join(ties, "key"), _suspects(min_bytes), 8, size, "dedup-places")


def _cut(min_bytes: int):
    schema = [("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    def run(it):
        last = None
        for batch in it:
            buf, off = tk.binary_parts(batch.column("text"))
            out = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key == last:      # a copy: rows of a key lie together
                    continue
                last = key
                t = buf[off[i]:off[i + 1]]
                starts = _starts(batch.column("ties")[i])
                change = np.zeros(len(t) + 1, np.int32)
                change[starts] += 1
                change[starts + min_bytes] -= 1
                gone = np.cumsum(change[:-1]) > 0
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((key, int(gone.sum()), spans, t[~gone].tobytes()))
            if out:
                yield _record(out, schema)
    return run


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text",
                   digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary; its sha256 with ``digest``).

    A byte goes if some string of ``min_bytes`` that covers it also starts
    anywhere else: in another row, or at another place of the same row.
    Matches do not cross rows; all are judged on the input.

    Null texts are empty.  Texts shorter than ``min_bytes`` stay as they are.
    Copies of a text of ``min_bytes`` or more go whole, also rows repeated with
    their id.  Texts are read whole, one at a time where they are long.  An
    empty table gives an empty result.  Only the id and text columns are read,
    so other columns may have any name.
    """
    def out(c):
        return F.sha2(c, 256).alias("kept_sha256") if digest else c.alias("kept")

    last = "kept_sha256" if digest else "kept"
    full = text_or_empty(text)
    copies, size = copied_texts(docs, doc_id, min_bytes, text)
    places = repeated_places(docs, min_bytes, text, doc_id, (copies, size))
    # copies go whole: their texts need not be cut, so each key that is cut stands in one row
    places = land(_with(places, copies.select("key"), "left_anti"), "dedup-cuts")
    texts = docs.select(F.xxhash64(full).alias("key"), full.alias("text"))
    cut = (prefilter(texts, places, "key").join(places, "key")
           .mapInArrow(_cut(min_bytes), "key long, n_removed long, n_spans long, kept binary")
           .select("key", "n_removed", "n_spans", out(F.col("kept")).alias("left")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(full).alias("key"),
                       F.octet_length(full).cast("long").alias("n_bytes"), out(full.cast("binary")))
    empty = F.lit(b"")
    whole = _with(rows, copies.select("key"), "left_semi").select(
        F.col("doc_id").alias(doc_id), "n_bytes", F.col("n_bytes").alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"), (F.sha2(empty, 256) if digest else empty).alias(last))
    single = _with(rows, copies.select("key"), "left_anti").join(cut, "key", "left")
    return whole.unionByName(single.select(
        F.col("doc_id").alias(doc_id), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("left", last).alias(last)))
