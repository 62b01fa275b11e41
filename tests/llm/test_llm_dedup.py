import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_cases import LONG, PROSE, TEXTS, documents
from shelfgap.llm import graph, ngram_join, suffix_dedup
from shelfgap.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    """(id, text) rows to the component id of each row, by row number."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            posting[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in posting[x] if j > i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(doc, least.get(r, doc))
    return [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


def check_join(spark, rows, clashes=False):
    got = ngram_join.near_duplicates(documents(spark, rows, clashes)).collect()
    want = Counter((i, len(shingles(t)), c) for (i, t), c in zip(rows, brute_components(rows)))
    assert Counter(tuple(r) for r in got) == want


def family(rng, base, copies, most_edits, start):
    words = base.split()
    out = []
    for i in range(copies):
        w = list(words)
        for _ in range(rng.randint(0, most_edits)):
            at, what = rng.randrange(len(w)), rng.randint(0, 2)
            if what == 0:
                w[at] = f"new{rng.randint(0, 40)}"
            elif what == 1:
                w.insert(at, f"in{rng.randint(0, 5)}")
            elif len(w) > 1:
                del w[at]
        out.append((start + i, " ".join(w)))
    return out


def test_join_edge_cases(spark):
    check_join(spark, TEXTS, clashes=True)
    assert ngram_join.near_duplicates(documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize("rare", [1, 24])
def test_join_dense_families_against_brute_force(spark, monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "LOCAL_HEAVY", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4096)
    rng = random.Random(11 + rare)
    rows = []
    for k, (length, copies, edits) in enumerate([(60, 80, 6), (12, 40, 2), (150, 40, 14), (7, 20, 1)]):
        base = " ".join(f"w{k}x{rng.randint(0, length)}" for _ in range(length))
        rows += family(rng, base, copies, edits, 1000 * k)
    passage = " ".join(f"shared{i}" for i in range(30))
    rows += [(9000 + i, passage + " " + " ".join(f"own{i}y{j}" for j in range(rng.randint(0, 20))))
             for i in range(40)]
    check_join(spark, rows)


def test_join_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op2_ngram_join"](spark, SF).collect()}
    assert got == {i: (len(shingles(t)), c) for (i, t), c in zip(rows, brute_components(rows))}


def test_signatures_bear_the_misses(spark):
    """Sets that reach the similarity share a signature, whatever the token classes."""
    rng = np.random.default_rng(3)
    counts = rng.integers(2, 60, 400).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(5, 120))
        x = rng.choice(400, n, replace=False)
        y = np.union1d(rng.choice(x, n - int(rng.integers(0, n // 6 + 1)), replace=False),
                       rng.choice(400, int(rng.integers(0, n // 8 + 1)), replace=False))
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        sigs = []
        for s in (x, y):
            s = s[np.lexsort((s, counts[s]))]
            sigs.append(set(ngram_join.signatures(s.astype(np.uint64), counts[s], len(s), 80).tolist()))
        assert sigs[0] & sigs[1] or (len(x) == 1 or len(y) == 1)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randint(100, 160), rng.randint(100, 160))
                                                                  for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(rows, m):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i:i + m] for x in raw for i in range(len(x) - m + 1))
    out = []
    for (doc, _), x in zip(rows, raw):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - m + 1):
            if seen[x[i:i + m]] > 1:
                gone[i:i + m] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((doc, len(x), int(gone.sum()), spans, kept))
    return out


@pytest.mark.parametrize("m", [11, 40, 200])
def test_repeats_match_brute_force(spark, monkeypatch, m):
    monkeypatch.setattr(suffix_dedup, "EMIT_ENTRIES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)       # several buckets a task
    rng = random.Random(m)
    pieces = ["".join(rng.choices("ab é", k=rng.randint(m // 2, 2 * m))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(pieces) if rng.random() < 0.4 else "".join(rng.choices("xyz wé", k=m))
                        for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a" * (3 * m)), (None, rows[3][1]), (503, pieces[0] * 3),
             (503, pieces[0] * 3), (504, "short")]
    got = suffix_dedup.remove_repeats(documents(spark, rows), min_bytes=m).collect()
    want = Counter(brute_repeats(rows, m))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def test_repeats_edge_cases_and_query(spark):
    got = suffix_dedup.remove_repeats(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_removed"] == 0 if len(PROSE) < 200 else by[1]["n_removed"] == len(PROSE)
    assert by[9]["n_removed"] == len(LONG) and bytes(by[10]["kept"]) == b" tail"
    assert suffix_dedup.remove_repeats(documents(spark).limit(0)).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(d, n, g, s, hashlib.sha256(k).hexdigest()) for d, n, g, s, k in brute_repeats(rows, 200)}
    assert {tuple(r) for r in QUERIES["op4_suffix_dedup"](spark, SF).collect()} == want


def test_covers_are_difference_covers():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
