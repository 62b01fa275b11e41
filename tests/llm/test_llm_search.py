import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import LONG, TEXTS, documents
from shelfgap.llm import ann, decontaminate
from shelfgap.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.binary(max_size=80))
def test_myers_matches_dynamic_programming(item, text):
    item, text = bytes(b % 4 for b in item), bytes(b % 4 for b in text)
    d, end = decontaminate.best_match(item, text)
    assert d == distance(item, text)
    assert d == distance(item, text[:end]) and 0 <= end <= len(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB .é\n!9", max_size=12), min_size=1, max_size=6))
def test_normalise_matches_regex(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    out, ends = decontaminate.normalise(np.frombuffer(b"".join(raw), np.uint8), off)
    for i, r in enumerate(raw):
        assert out[ends[i]:ends[i + 1]].tobytes() == re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", r.lower()).strip(b" ")


def test_matches_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    rng = random.Random(8)
    items = [(i, " ".join("".join(rng.choices("abcde", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 30))))
             for i in range(20)] + [(90, None), (91, ""), (92, "..."), (93, "ab")]
    docs = []
    for i in range(80):
        text = " ".join("".join(rng.choices("abcde", k=rng.randint(2, 6))) for _ in range(30))
        if i % 2:
            leak = list(rng.choice(items[:20])[1])
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(leak))
                leak[at:at + rng.randint(0, 1)] = rng.choices("xyz", k=rng.randint(0, 1))
            text += ".. " + "".join(leak).upper() + "!! " + text
        docs.append((i, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"]
           for r in decontaminate.matches(documents(spark, docs), bench).collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            a, b = decontaminate.normalise_text(item), decontaminate.normalise_text(t)
            if a and (x := distance(a, b)) <= decontaminate.budget(len(a)):
                want[d, i] = x
    assert got == want and len(want) > 30


def test_the_whole_error_share_is_searched(spark):
    """Against int(share * m) itself, for items of all lengths, with as many errors as the share allows or one more."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate(
        [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 19, 20, 24, 25, 30, 45, 60, 80, 100])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for share in (0.0, 0.1, 0.3):
        docs = []
        for i, item in items * 4:
            leak = list(item)
            for at in sorted(rng.sample(range(len(leak)), int(share * len(leak)) + len(docs) % 2), reverse=True):
                leak[at:at + 1] = rng.choice(["", "x", leak[at] + "x"])
            docs.append((len(docs), f"{word()} {word()} {''.join(leak)} {word()}"))
        got = {(r["doc_id"], r["item_id"]): r["distance"]
               for r in decontaminate.matches(documents(spark, docs), bench, share=share).collect()}
        want, beyond_a_twelfth = {}, 0
        for d, t in docs:
            for i, item in items:
                x = distance(item.encode(), decontaminate.normalise_text(t)) if len(item) < 60 else \
                    decontaminate.best_match(item.encode(), decontaminate.normalise_text(t))[0]
                if x <= int(share * len(item)):
                    want[d, i] = x
                    beyond_a_twelfth += x > len(item) // 12 - 1 and x > 0
        assert got == want
        assert not share or beyond_a_twelfth > 20


def test_pieces_cover_items():
    for m in range(1, 60):
        for k in range(m):
            found = decontaminate.pieces(m, k)
            assert len(found) == k + 1 and all(a < b for a, b, _, _ in found)
            assert [a for a, *_ in found] == [0, *(b for _, b, _, _ in found[:-1])] and found[-1][1] == m
            assert sum(c == d for _, _, c, d in found) == (k + 1) % 2


def test_decontaminate_edge_cases(spark):
    bench = spark.createDataFrame([(1, LONG), (2, "one TWO"), (2, "one TWO"), (None, "no id"), (3, None)],
                                  "item_id long, text string")
    rows = decontaminate.matches(documents(spark), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(9, 1), (10, 1), (7, 2), (8, 2)}
    kept = decontaminate.clean(documents(spark), bench)
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(TEXTS) - 4
    assert decontaminate.matches(documents(spark).limit(0), bench).collect() == []
    assert decontaminate.matches(documents(spark), bench.limit(0)).collect() == []


def test_ids_of_items_keep_their_type(spark):
    docs = spark.createDataFrame([("d1", "a long passage of the test"), ("d2", "nothing")], "doc_id string, text string")
    items = [("x-1", "long passage"), (None, "of the test")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.matches(docs, bench)
    assert dict(got.dtypes)["item_id"] == "string"
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {("d1", "x-1"), ("d1", None)}
    assert decontaminate.clean(docs, bench).collect()[0]["doc_id"] == "d2"


def test_a_matchs_plan_keeps_its_size(spark, monkeypatch):
    from test_plans import plan_text
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"number {i}") for i in range(20)], "item_id long, text string")
    one = decontaminate.matches(docs, bench)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    many = decontaminate.matches(docs, bench)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert len(plan_text(one).splitlines()) == len(plan_text(many).splitlines())


def test_decontaminate_query_finds_every_exact_passage(spark):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontaminate"](spark, SF).collect()}
    docs = [(r["doc_id"], decontaminate.normalise_text(r["text"]))
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], decontaminate.normalise_text(r["text"]))
             for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= got


def nearest(rows, q, own, k):
    """All rows are candidates but one that has the query's id and vector."""
    others = list(rows)
    others.remove((q, own))
    out = []
    for i, v in others:
        if len(v) == len(own):
            total = 0.0
            for a, b in zip(own, v):
                total += a * b
            out.append((-total, i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def check(spark, data, k, monkeypatch, **blocks):
    for name, value in blocks.items():
        monkeypatch.setattr(ann, name, value)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string, first string")
    rows, asking = [], {}
    for i, v, *_ in data:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        rows.append((i, v))
        asking[i] = min(v, asking.get(i, v))
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 20 = 0"), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {q: nearest(rows, q, own, k) for q, own in asking.items() if q % 20 == 0}
    assert {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()} == {q: w for q, w in want.items() if w}
    assert all([r for r, _, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values())


def test_search_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=16).tolist(), "x", None) for i in range(600)]
    data += [(1000 + i, data[7][1], None, None) for i in range(120)]           # a hot vector
    data += [(2000 + i, rng.integers(-1, 2, 16).astype(float).tolist(), None, None) for i in range(200)]  # many ties
    check(spark, data, 20, monkeypatch, QUERY_BLOCK=16, CANDIDATE_BLOCK=64, PASS_BYTES=3000, PAIRS_AT_ONCE=500)


def test_rows_that_share_an_id_are_all_candidates(spark, monkeypatch):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (0, [7.0, 1.0]), (0, [1.0, 0.0]),
            (20, [0.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (2, [0.0, 1.0])]
    data += [(3, [0.5, 0.5])] * 40                     # a row repeated more often than is asked for
    check(spark, [(i, v, None, None) for i, v in data], 4, monkeypatch, CANDIDATE_BLOCK=7)
    check(spark, [(i, v, None, None) for i, v in data], 60, monkeypatch, CANDIDATE_BLOCK=7)


def test_plan_and_broadcast_keep_their_size(spark, monkeypatch):
    from test_plans import plan_text
    rng = np.random.default_rng(2)
    sizes = []
    for n in (40, 400):
        monkeypatch.setattr(ann, "PASS_BYTES", 1000)
        monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
        frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "vec_id long, embedding array<float>")
        sizes.append(len(plan_text(ann.search(frame, frame)).splitlines()))
    assert sizes[0] == sizes[1]


def test_search_edge_cases(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0], None, None), (20, [0.0, 0.0], None, None), (40, None, None, None), (60, [], None, None),
            (80, [nan, 1.0], None, None), (1, [inf, 1.0], None, None), (2, [None, 1.0], None, None),
            (3, [1e30, -1e30], None, None), (4, [1e-30, 1e-30], None, None), (None, [1.0, 1.0], None, None),
            (5, [1.0, 2.0, 3.0], None, None), (100, [3.0, 2.0, 1.0], None, None), (6, [1.0, 2.0], None, None),
            (6, [1.0, 2.0], None, None), (7, [2.0, 1.0], None, None), (7, [0.5, 1.0], None, None),
            (-20, [1.0, 0.0], None, None)]
    check(spark, data, 3, monkeypatch)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(empty, empty).collect() == []


def test_products_are_exact_beyond_a_floats_digits():
    rng = np.random.default_rng(1)
    v = rng.choice([-1.0, 1.0], (6, 5000))
    side = ann._Side(5000, np.arange(6).tobytes(), np.ones(6, bool).tobytes(), v.tobytes())
    assert (ann._products(side, side) == side.q.astype(np.int64) @ side.q.astype(np.int64).T).all()


def test_recall_of_the_query(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in
            spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    m = np.array([rows[i] for i in ids])
    got = {}
    for r in QUERIES["op10_ann"](spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        s = m @ rows[q]
        s[ids == q] = -np.inf
        hits += len(found & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / (20 * len(got)) > 0.99
