"""Near-duplicate join: Jaccard similarity of word shingles by token-combination prefixes.

Tokens are shingle hashes.  The steps, each exact:

1. Sets equal as sets are one class; only classes go on.
2. In hash order, two linked sets share a token of their 20 % smallest, and
   k + 1 tokens of 20 % and k.  Prefixes of 30 % are indexed by token; classes
   that share too few of theirs with others have no link.
3. The rest count how many classes hold each token.  A token held by one class
   only can match nothing: a class with too few shared tokens has no link.
4. Prefixes, rarest tokens first.  A set may miss ``spare`` = n - ceil(t n) of
   its tokens in a partner, so a prefix that ``spare`` misses cannot empty of
   signatures must share one with every partner.  A rare token is a signature
   by itself.  Frequent tokens are dealt into sub-classes, and signatures are
   the pairs of a sub-class's tokens; c of them take c - 1 misses, so the
   prefix is extended until the misses it bears exceed ``spare``.  With c
   tokens present on both sides the proof is that of prefix filtering.
5. Classes with a signature in common are candidates.  Each signature's hub,
   its member with the least unshared tokens, is verified against the others,
   and components are formed.  The members around a hub that still lie in
   different components are compared in blocks, by size and by parity bitmaps,
   which bound the intersection; what passes is verified.  Verification
   intersects the shared tokens.

Sets are named by 64-bit hashes: N distinct sets collide with probability
about N * N / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as tk
from .common import free_shuffles, land, prefilter, shuffle_partitions, text_or_empty
from .graph import components

SHINGLE = 5
PERCENT = 80
EXTRA_IN = 10        # one in so many tokens is added to the hash-ordered prefix
RARE = 24            # a token in more classes than this is frequent
LOCAL_HEAVY = 64     # a token in so many classes of one batch is counted there, not in its bucket
BLOCK = 512          # members of a hub compared at once, at most
BLOCK_BYTES = 4 << 20  # and of their bitmaps
SUBCLASS = 3         # prefix tokens of a set in a sub-class, about
EMIT_BYTES = 12 << 20
HEAVY = np.uint32(2 ** 32 - 1)


def spare(n: np.ndarray | int, percent: int):
    """Tokens of a set of n that a partner may lack."""
    return n - (n * percent + 99) // 100


def extra(n):
    """Further tokens of the hash-ordered prefix, all of which two linked sets must share."""
    return n // EXTRA_IN


def _sets(it: Iterator[pa.RecordBatch], size: int, emit_bytes: int):
    """Per emission: rows (batch, row) and sets, for about ``emit_bytes`` of text."""
    held, weight = [], 0
    for batch in it:
        buf, off = tk.binary_parts(batch.column("text"))
        for a, b in tk.doc_chunks(off):
            sets = tk.shingle_sets(buf[off[a]:off[b]], off[a:b + 1] - off[a], size)
            held.extend((batch, a + i, s) for i, s in enumerate(sets))
            weight += int(off[b] - off[a])
            if weight >= emit_bytes:
                yield held
                held, weight = [], 0
    if held:
        yield held


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64) if len(values) else [], pa.int64())


PROBE = ("kind string, doc_id {id}, row_key long, key long, n long, bucket int, tokens binary, keys binary, "
         "counts binary")


def _probe(size: int, percent: int, buckets: int, schema: pa.Schema):
    """A ``doc`` row for each document; prefix tokens by bucket (``tok``), marks and own answers."""
    def run(it):
        for held in _sets(it, size, EMIT_BYTES):
            keys = [tk.set_key(s) if len(s) else None for _, _, s in held]
            ids = pa.concat_arrays([b.column("doc_id").slice(i, 1) for b, i, _ in held])
            n = len(held)
            yield pa.RecordBatch.from_arrays([
                pa.array(["doc"] * n), ids,
                pa.concat_arrays([b.column("row_key").slice(i, 1) for b, i, _ in held]),
                pa.array(keys, pa.int64()), pa.array([len(s) for _, _, s in held], pa.int64()),
                pa.array(np.arange(n) % buckets, pa.int32()), *[pa.nulls(n, pa.binary())] * 3,
            ], schema=schema)
            distinct = {k: s[:spare(len(s), percent) + 1 + extra(len(s))] for k, (_, _, s) in zip(keys, held) if k is not None}
            tokens = np.concatenate([*distinct.values(), np.empty(0, np.uint64)])
            owner = np.repeat(np.array(list(distinct), np.int64), [len(s) for s in distinct.values()])
            # tokens are hash-ordered prefixes, so small: spread them again
            buckets_of = tk.bucket_of(tk.mix(tokens), buckets)
            order = np.argsort(tokens, kind="stable")
            at = tk.group_starts(tokens[order])
            sizes = np.diff(np.append(at, len(tokens)))
            many = np.empty(len(tokens), bool)
            many[order] = np.repeat(sizes > 1, sizes)
            single, marked = np.flatnonzero(~many), order[at[sizes > 1]]
            # a token that several classes of the batch hold is settled here; its bucket gets one mark
            rows = [("tok", b, tokens[single[i]].tobytes(), *_owners(owner[single[i]]))
                    for b, i in tk.by_bucket(buckets_of[single], buckets)]
            rows += [("mark", b, tokens[marked[i]].tobytes(), b"", b"")
                     for b, i in tk.by_bucket(buckets_of[marked], buckets)]
            hit, count = np.unique(owner[many], return_counts=True)
            rows += [("own", b, count[i].astype(np.uint64).tobytes(), *_owners(hit[i]))
                     for b, i in tk.by_bucket(_home(hit, buckets), buckets)]
            if rows:
                m = len(rows)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows]), pa.nulls(m, schema.field("doc_id").type), none, none, none,
                    pa.array([r[1] for r in rows], pa.int32()),
                    *[pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3, 4)]], schema=schema)
    return run


def _owners(owner: np.ndarray) -> tuple[bytes, bytes]:
    """Runs of equal owners: the owners and the runs' lengths."""
    first = tk.group_starts(owner)
    return owner[first].tobytes(), np.diff(np.append(first, len(owner))).astype(np.uint32).tobytes()


def _per_token(keys: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(keys, np.int64), np.frombuffer(counts, np.uint32))


def _shared(schema: pa.Schema):
    """Passes ``doc`` rows on; per class, the numbers of prefix tokens it shares with others.

    ``hit`` rows hold what a partition has found, ``own`` rows what a batch had.
    """
    def answer(kind, keys, counts):
        m = len(keys)
        return pa.RecordBatch.from_arrays([
            pa.array([kind] * m), pa.nulls(m, schema.field("doc_id").type), pa.nulls(m, pa.int64()),
            pa.array(keys), pa.array(counts, pa.int64())], schema=schema)

    def run(it):
        tokens, keys, marks = [], [], [np.empty(0, np.uint64)]
        for batch in it:
            kind = batch.column("kind")
            docs = batch.filter(pa.compute.equal(kind, "doc"))
            if docs.num_rows:
                yield docs.select(["kind", "doc_id", "row_key", "key", "n"]).cast(schema)
            for i in np.flatnonzero(~np.asarray(pa.compute.equal(kind, "doc"))).tolist():
                t = np.frombuffer(batch.column("tokens")[i].as_py(), np.uint64)
                if kind[i].as_py() == "mark":
                    marks.append(t)
                    continue
                k = _per_token(batch.column("keys")[i].as_py(), batch.column("counts")[i].as_py())
                if kind[i].as_py() == "own":
                    yield answer("own", k, t.view(np.int64))
                else:
                    tokens.append(t)
                    keys.append(k)
        if not tokens:
            return
        t, k = np.concatenate(tokens), np.concatenate(keys)
        order = np.argsort(t)
        t, k = t[order], k[order]
        at = tk.group_starts(t)
        sizes = np.diff(np.append(at, len(t)))
        shared = np.logical_or.reduceat(k != np.repeat(k[at], sizes), at) | np.isin(t[at], np.concatenate(marks))
        shared = np.repeat(shared, sizes)
        t, k = t[shared], k[shared]
        order = np.lexsort((t, k))
        t, k = t[order], k[order]
        fresh = np.ones(len(t), bool)      # copies of a class that other tasks have read
        fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        hit, count = np.unique(k[fresh], return_counts=True)
        if len(hit):
            yield answer("hit", hit, count)
    return run


COUNT = "kind string, bucket int, tokens binary, keys binary, counts binary"


def _count_probe(size: int, buckets: int):
    """Each class's tokens by bucket (``tok``), and its size (``size``, by class).

    Tokens heavy in the batch are answers already (``own``), with a ``mark`` in their bucket.
    """
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("tokens", pa.binary()),
                        ("keys", pa.binary()), ("counts", pa.binary())])

    def rows(kind, tokens, owner, buckets_of):
        out = [(kind, b, tokens[at].tobytes(), *_owners(owner[at]))
               for b, at in tk.by_bucket(buckets_of, buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)],
                                          schema=schema)

    def run(it):
        for held in _sets(it, size, EMIT_BYTES):
            wanted = {}
            for batch, i, s in held:
                key = tk.set_key(s) if len(s) else None
                if key is not None and key == batch.column("want")[i].as_py():
                    wanted[key] = s
            if not wanted:
                continue
            tokens, names = np.concatenate(list(wanted.values())), np.array(list(wanted), np.int64)
            sizes = np.array([len(s) for s in wanted.values()], np.int64)
            yield rows("size", sizes.view(np.uint64), names, _home(names, buckets))
            owner = np.repeat(names, sizes)
            order = np.argsort(tokens, kind="stable")
            at = tk.group_starts(tokens[order])
            sizes = np.diff(np.append(at, len(tokens)))
            marks = tokens[order][at[sizes >= LOCAL_HEAVY]]
            heavy = np.empty(len(tokens), bool)
            heavy[order] = np.repeat(sizes >= LOCAL_HEAVY, sizes)
            yield rows("tok", tokens[~heavy], owner[~heavy], tk.bucket_of(tokens[~heavy], buckets))
            if len(marks):
                yield rows("mark", marks, np.zeros(len(marks), np.int64), tk.bucket_of(marks, buckets))
                yield rows("own", tokens[heavy], owner[heavy], _home(owner[heavy], buckets))
    return run


def _home(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The partition in which a class is assembled."""
    return tk.bucket_of(tk.mix(keys.view(np.uint64)), buckets)


ANSWER = "bucket int, tokens binary, keys binary, lengths binary, counts binary, sizes binary"


def _count(buckets: int):
    """The tokens that several classes hold, with the number of classes, by the classes' home partitions."""
    schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("keys", pa.binary()),
                        ("lengths", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary())])

    def answer(t, k, c):
        order = np.argsort(k, kind="stable")
        t, k, c = t[order], k[order], c[order]
        rows = [(b, t[at].tobytes(), *_owners(k[at]), c[at].tobytes(), b"")
                for b, at in tk.by_bucket(_home(k, buckets), buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                          schema=schema)

    def run(it):
        tokens, keys, marks = [], [], [np.empty(0, np.uint64)]
        for batch in it:
            for kind, b, t, k, c in zip(*(batch.column(x) for x in ("kind", "bucket", "tokens", "keys", "counts"))):
                kind, t = kind.as_py(), np.frombuffer(t.as_py(), np.uint64)
                if kind == "mark":
                    marks.append(t)
                    continue
                k = _per_token(k.as_py(), c.as_py())
                if kind == "own":
                    yield answer(t, k, np.full(len(t), HEAVY, np.uint32))
                elif kind == "size":
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.as_py()], pa.int32()), pa.array([b""]), pa.array([k.tobytes()]),
                         pa.array([b""]), pa.array([b""]), pa.array([t.tobytes()])], schema=schema)
                else:
                    tokens.append(t)
                    keys.append(k)
        if not tokens:
            return
        t, k = np.concatenate(tokens), np.concatenate(keys)
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        fresh = np.ones(len(t), bool)           # a class counts once, however many copies were read
        fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        t, k = t[fresh], k[fresh]
        at = tk.group_starts(t)
        sizes = np.diff(np.append(at, len(t)))
        counts = np.minimum(sizes, int(HEAVY) - 1).astype(np.uint32)
        counts[np.isin(t[at], np.concatenate(marks))] = HEAVY
        counts = np.repeat(counts, sizes)
        keep = counts > 1
        if keep.any():
            yield answer(t[keep], k[keep], counts[keep])
    return run


def signatures(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Signatures of one set; ``tokens`` are its shared ones, rarest first.

    Sub-classes depend on the size class, so a set signs for its own size class
    and that of the largest partner; a pair meets in the larger set's.
    """
    limit = spare(n, percent) + 1
    out: set[int] = set()
    single = tk.mix(tokens ^ np.uint64(0x5151))
    for level in {int(n).bit_length(), int(n * 100 // percent).bit_length()}:
        subclasses = max(1, (1 << level) * (100 - percent) // 100 // (2 * SUBCLASS))
        sub = (tk.mix(tokens + np.uint64(level)) % np.uint64(subclasses)).tolist()
        units, members = n - len(tokens), {}     # unshared tokens come first: one miss each, no signature
        for i, c in enumerate(counts.tolist()):
            if units >= limit:
                break
            if c <= RARE:
                out.add(int(single[i]))
                units += 1
                continue
            before = members.setdefault(sub[i], [])
            if before:
                units += 1
                pair = tk.mix(tokens[before] * tk.BASE + tokens[i] + np.uint64(level))
                out.update(tk.mix(pair).tolist())
            before.append(i)
    return np.fromiter(out, np.uint64, len(out))


def bitmap_bytes(n: int) -> int:
    """Four to eight bits a token, a power of two."""
    return 1 << max(4, int(n).bit_length() - 1)


def parity_bitmap(tokens: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bit (token mod bits) flipped once per token."""
    bits = np.bincount((tokens % np.uint64(n_bytes * 8)).astype(np.int64), minlength=n_bytes * 8) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def _assemble(percent: int):
    """Per class that may have links: sizes, tokens, signatures and a bitmap of all shared tokens."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()),
                        ("tokens", pa.list_(pa.int64())), ("sigs", pa.list_(pa.int64())),
                        ("bits", pa.binary())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                          schema=schema)

    def run(it):
        tokens, keys, counts, names, sizes = ([np.empty(0, x)] for x in (
            np.uint64, np.int64, np.uint32, np.int64, np.int64))
        for batch in it:
            for t, k, m, c, n in zip(*(batch.column(x) for x in ("tokens", "keys", "lengths", "counts", "sizes"))):
                if n := n.as_py():
                    names.append(np.frombuffer(k.as_py(), np.int64))
                    sizes.append(np.frombuffer(n, np.int64))
                else:
                    tokens.append(np.frombuffer(t.as_py(), np.uint64))
                    keys.append(_per_token(k.as_py(), m.as_py()))
                    counts.append(np.frombuffer(c.as_py(), np.uint32))
        t, k, c = np.concatenate(tokens), np.concatenate(keys), np.concatenate(counts)
        names, first = np.unique(np.concatenate(names), return_index=True)
        sizes = np.concatenate(sizes)[first]
        order = np.lexsort((t, c, k))            # per class, rarest first
        t, k, c = t[order], k[order], c[order]
        fresh = np.ones(len(t), bool)            # copies of one class may have answered twice
        fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        t, k, c = t[fresh], k[fresh], c[fresh]
        ends = np.searchsorted(k, names, "right").tolist()
        out = []
        for key, n, a, b in zip(names.tolist(), sizes.tolist(), np.searchsorted(k, names).tolist(), ends):
            if n - (b - a) <= spare(n, percent):
                sigs = signatures(t[a:b], c[a:b], n, percent)
                out.append((key, n, b - a, np.sort(t[a:b]).view(np.int64), np.sort(sigs).view(np.int64),
                            parity_bitmap(t[a:b], bitmap_bytes(n)).tobytes()))
            if len(out) == 1000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)
    return run


def _fits(n1, s1, n2, s2, percent: int):
    """Whether sets of these sizes and shared tokens can reach the similarity."""
    both = np.minimum if isinstance(n1, np.ndarray) else F.least
    return both(s1, s2) * (100 + percent) >= (n1 + n2) * percent


def _fold(bits: np.ndarray, n_bytes: int) -> np.ndarray:
    while bits.shape[-1] > n_bytes:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _meet(percent: int):
    """Pairs of two blocks around one hub that lie in different components and may link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def side(members):
        out = {c: np.array([m[c] for m in members], np.int64) for c in ("key", "n", "shared", "component")}
        return out | {"bits": [np.frombuffer(m["bits"], np.uint8) for m in members]}

    def pairs(a, b, same):
        ok = (a["component"][:, None] != b["component"][None, :]) & _fits(
            a["n"][:, None], a["shared"][:, None], b["n"][None, :], b["shared"][None, :], percent)
        if same:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        need = (percent * (a["n"][i] + b["n"][j]) + 99 + percent) // (100 + percent)
        good = np.zeros(len(i), bool)
        widths = [np.array([len(x) for x in y["bits"]]) for y in (a, b)]
        width = np.minimum(widths[0][i], widths[1][j])
        for w in np.unique(width):
            folded = [np.stack([_fold(x, w) if len(x) >= w else np.resize(x, w) for x in y["bits"]])
                      for y in (a, b)]
            at, step = np.flatnonzero(width == w), max(1, BLOCK_BYTES // int(w))
            for k in range(0, len(at), step):
                p = at[k:k + step]
                apart = np.bitwise_count(folded[0][i[p]] ^ folded[1][j[p]]).sum(axis=1, dtype=np.int64)
                good[p] = (a["shared"][i[p]] + b["shared"][j[p]] - apart) // 2 >= need[p]
        return a["key"][i[good]], b["key"][j[good]]

    def run(it):
        for batch in it:
            for r in range(batch.num_rows):
                members, others = (batch.column(c)[r].as_py() for c in ("members", "members2"))
                a = side(members)
                x, y = pairs(a, a if others is None else side(others), others is None)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))],
                                                     schema=schema)
    return run


def _verified(pairs: DataFrame, core: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    one = core.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = core.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(one, "a").join(two, "b")
            .where(both * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b"))


def links_between(core: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links (a, b) between class keys: enough of them to give every component."""
    signed = core.select("key", "n", "shared", F.explode("sigs").alias("sig"))
    central = F.struct((F.col("shared") * 1_000_000 / F.col("n")).cast("long").alias("rank"), "key", "n", "shared")
    hubs = (signed.groupBy("sig").agg(F.max(central).alias("hub"), F.count(F.lit(1)).alias("m"))
            .where("m > 1").select("sig", "hub"))
    around = land(signed.join(hubs, "sig").select(
        F.col("hub.key").alias("hub"), "key",
        _fits(F.col("n"), F.col("shared"), F.col("hub.n"), F.col("hub.shared"), percent).alias("fits"))
        .distinct(), "join-hubs")
    stars = around.where("fits and key <> hub").select("hub", "key")
    links = land(_verified(stars.select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b"))
                           .distinct(), core, percent), "join-links")
    parts = components(links).select(F.col("node").alias("key"), "component")
    placed = around.select("hub", "key").join(parts, "key", "left").select(
        "hub", "key", F.coalesce("component", "key").alias("component"))
    placed = land(placed, "join-placed")
    split = (placed.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("hub"))
    facts = core.select("key", "n", "shared", "bits")
    weight = F.greatest(F.length("bits"), F.lit(BLOCK_BYTES // BLOCK))
    members = land(placed.join(split, "hub", "left_semi").join(facts, "key").withColumn("weight", weight),
                   "join-members")
    # large components get blocks of their own, small ones share blocks; hashes deal out the members
    per_part = members.groupBy("hub", "component").agg(F.sum("weight").alias("part_weight"))
    small = F.col("part_weight") * 2 <= BLOCK_BYTES
    rest = (per_part.where(small).groupBy("hub").agg(F.sum("part_weight").alias("rest_weight")))
    dealt = per_part.join(rest, "hub", "left").select(
        "hub", "component", F.when(small, F.lit(None)).otherwise(F.col("component")).alias("alone"),
        F.ceil(F.when(small, 2 * F.col("rest_weight")).otherwise(F.col("part_weight")) / F.lit(BLOCK_BYTES))
        .alias("pieces"))
    piece = F.pmod(F.xxhash64(F.when(F.col("alone").isNull(), F.col("component")).otherwise(F.col("key"))),
                   F.col("pieces"))
    blocks = (members.join(dealt, ["hub", "component"])
              .withColumn("blk", F.concat_ws(":", F.coalesce(F.col("alone").cast("string"), F.lit("")), piece.cast("string")))
              .groupBy("hub", "blk").agg(
                  F.min("component").alias("lo"), F.max("component").alias("hi"),
                  F.collect_list(F.struct("key", "n", "shared", "component", "bits")).alias("members")))
    blocks = land(blocks, "join-blocks")
    one = blocks.where("lo <> hi").select("members", F.lit(None).cast(blocks.schema["members"].dataType)
                                          .alias("members2"))
    other = blocks.select("hub", F.col("blk").alias("blk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"),
                          F.col("members").alias("members2"))
    # two blocks that lie in one component have nothing left to find
    two = (blocks.join(other, "hub").where("blk < blk2")
           .where("not (lo = hi and lo2 = hi2 and lo = lo2)").select("members", "members2"))
    met = one.union(two).mapInArrow(_meet(percent), "a long, b long").distinct()
    return links.union(land(_verified(met, core, percent), "join-links"))


def classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, doc_id: str = "doc_id",
            text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, core): documents as (doc_id, key, n), core as the classes that may have links."""
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    id_type = rows.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    five = pa.schema([("kind", pa.string()), ("doc_id", arrow_id), ("row_key", pa.int64()), ("key", pa.int64()),
                      ("n", pa.int64())])
    full = five.append(pa.field("bucket", pa.int32())).append(pa.field("tokens", pa.binary())).append(
        pa.field("keys", pa.binary())).append(pa.field("counts", pa.binary()))
    id_name = id_type.simpleString()
    probed = (rows.mapInArrow(_probe(size, percent, buckets, full), PROBE.format(id=id_name))
              .repartition(buckets, "bucket")
              .mapInArrow(_shared(five), f"kind string, doc_id {id_name}, row_key long, key long, n long"))
    probed = land(probed, "join-probe")
    base = probed.where("kind = 'doc'").select("doc_id", "row_key", "key", "n")
    # copies of a class may each have settled tokens in their batch: the most counts, at the least what is shared
    found = F.sum(F.when(F.col("kind") == "hit", F.col("n")).otherwise(0))
    own = F.max(F.when(F.col("kind") == "own", F.col("n")).otherwise(0))
    hits = probed.where("kind in ('hit', 'own')").groupBy("key").agg((found + own).alias("hits"))
    reps = (base.where("key is not null").groupBy("key")
            .agg(F.min(F.struct("doc_id", "row_key")).alias("r"), F.max("n").alias("n"))
            .join(hits, "key")
            # the smaller of two linked sets has percent of n tokens at least
            .where(F.col("hits") > F.floor(F.ceil(F.col("n") * percent / 100) / EXTRA_IN))
            .select("key", "n", F.col("r.row_key").alias("row_key")))
    reps = land(reps, "join-reps")
    free_shuffles(spark)
    wanted = reps.select("row_key", F.col("key").alias("want"))
    counted = (prefilter(rows.select("row_key", "text"), wanted, "row_key").join(wanted, "row_key").select("want", "text")
               .mapInArrow(_count_probe(size, buckets), COUNT).repartition(buckets, "bucket")
               .mapInArrow(_count(buckets), ANSWER).repartition(buckets, "bucket"))
    core = counted.mapInArrow(_assemble(percent), "key long, n long, shared long, tokens array<long>, "
                                                  "sigs array<long>, bits binary")
    core = land(core, "join-core")
    free_shuffles(spark)
    return base.select("doc_id", "key", "n"), core


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs of characters other than ASCII white space, A-Z
    lower-cased; a set holds the distinct ``size``-word shingles, or the whole
    sequence of a shorter text.  Two documents link when 100 * intersection >=
    percent * union.  component_id is the smallest doc_id reached by links.

    Null, empty and blank texts have no shingles, link with nothing and are
    their own component.  Equal sets link.  Repeated rows each get a row; a
    null doc_id is never the smallest unless its component has no other.  Texts
    are read whole.  An empty table gives an empty result.  Only the id and
    text columns are read, so other columns may have any name.
    """
    base, core = classes(docs, percent, size, doc_id, text)
    parts = components(links_between(core, percent))
    least = base.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = least.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").select("key", "component_id")
    own: Column = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return base.join(named, "key", "left").select(
        F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id"))
