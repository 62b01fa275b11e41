import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from llm_cases import TEXTS, documents
from shelfgap.llm import quality, toxicity
from shelfgap.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(spark, rng, n=600):
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        text = rng.choices(words, k=rng.randint(5, 60))
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["nasty", "vileness", "vilely", "viler", "rotten"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(bad)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, random.Random(1))
    frame = documents(spark, docs)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score(frame, toxicity.fit(frame, labels)).collect()
    assert len(rows) == len(docs)
    out = [r for r in rows if r["held_out"]]
    assert out and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(spark, random.Random(2), 300)
    frame = documents(spark, docs)
    flipped = spark.createDataFrame([(r[0], r[1], 1 - r[2] if held_out(r[0]) else r[2]) for r in labels.collect()],
                                    labels.schema)
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.score(frame, toxicity.fit(frame, x)).collect())
              for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_counterfactual_penalty_frees_identity_terms():
    """Insults that co-occur with one group's name do not make the name toxic."""
    rng = random.Random(4)
    sets, y = [], []
    for i in range(800):
        toxic = rng.random() < 0.3
        words = [f"w{rng.randint(0, 50)}" for _ in range(8)]
        group = rng.choice(["muslim", "christian", "jewish"])
        if toxic:
            words.append(rng.choice(["scumbag", "filth"]))
            group = "muslim" if rng.random() < 0.95 else group
        words.append(group)
        sets.append(np.unique(toxicity.hash_words(words)))
        y.append(float(toxic))

    def gap(weight):
        m = toxicity.fit_sets(sets, np.array(y), counterfactual_weight=weight)
        score = {g: m.logit(np.unique(toxicity.hash_words(["i", "am", g]))) for g in ("muslim", "christian")}
        assert m.logit(np.unique(toxicity.hash_words(["you", "filth"]))) > m.logit(toxicity.hash_words(["hello"])) + 2
        return abs(score["muslim"] - score["christian"])

    assert gap(0.0) > 1.0
    assert gap(toxicity.COUNTERFACTUAL_WEIGHT) < 0.2 * gap(0.0)


def test_counterfactual_penalty_frees_whole_terms_of_texts(spark):
    """Plural and long terms count no further by their beginnings, from the fit to the score."""
    rng = random.Random(5)
    groups = [("muslims", "christians", "jews"), ("immigrants", "natives"), ("women", "men"),
              ("transgender", "cisgender")]
    docs, labels = [], []
    for i in range(1200):
        toxic = rng.random() < 0.3
        words = [f"w{rng.randint(0, 50)}" for _ in range(8)]
        if toxic:
            words.append(rng.choice(["scumbag", "filth"]))
        for g in groups:
            words.append(g[0] if toxic and rng.random() < 0.95 else rng.choice(g))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, docs), labels)
    texts = [f"they are {term}" for g in groups for term in g] + ["you filth"]
    rows = toxicity.score(documents(spark, list(enumerate(texts))), model).collect()
    score = {texts[r["doc_id"]]: r["score"] for r in rows}
    logit = {t: np.log(p / (1 - p)) for t, p in score.items()}
    assert score["you filth"] > 0.9
    for first, *others in groups:
        for other in others:
            assert abs(logit[f"they are {first}"] - logit[f"they are {other}"]) < 0.3, (first, other)


def test_inflected_words_and_case(spark):
    docs, labels = labelled(spark, random.Random(1))
    model = toxicity.fit(documents(spark, docs), labels)
    rows = toxicity.score(documents(spark, [(1, "so VILEST!"), (2, "hello there")]), model).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1] > 3 * score[2]


def test_without_usable_labels_nothing_is_rejected(spark, tmp_path):
    docs = documents(spark)
    held = [i for i in range(100) if held_out(i)]
    for name, ids in (("none", []), ("held out", held)):
        labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] < 0.01 and r["predicted"] == 0 for r in rows)
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path / name)).count() == len(TEXTS)


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op6_quality"](spark, SF).collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_word_vectors_match_a_loop(spark):
    texts = ["a b c. a", "b!! c b", None, ""]
    vectors, weights = quality.word_vectors(documents(spark, list(enumerate(texts))))
    import re
    sums = np.zeros((quality.ROWS, quality.DIM))
    from shelfgap.llm import textkit as tk
    for t in texts:
        words = re.findall(r"[a-z]+|[^a-z\s]+", t or "")
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words]) if words else np.empty(0, int)
        rows = [int(tk.Spans(raw).hash(np.array([e - len(w)]), np.array([e]))[0] % quality.ROWS)
                for w, e in zip(words, ends)]
        for i, r in enumerate(rows):
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                if j != i:
                    for k in range(quality.NONZERO):
                        sums[r, quality._COLUMN[rows[j], k]] += quality._SIGN[rows[j], k]
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    assert np.allclose(vectors, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0), atol=1e-6)
    assert weights.min() > 0


def test_training_texts_do_not_meet_in_one_task(spark):
    """The features are computed before the ordered limit, so that no whole text passes it."""
    docs = documents(spark, [(i, f"text {i} " * 50) for i in range(40)] + [(3, "another"), (3, "third")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    lengths = lambda buf, offsets: np.diff(offsets).reshape(-1, 1)
    rows = toxicity.training_rows(docs, labels, "toxic", 1000, lengths)
    want = [(r["doc_id"] % 2, len(r["text"])) for r in docs.collect() if not held_out(r["doc_id"])]
    assert sorted((r["label"], int(np.frombuffer(r["x"], np.int64)[0])) for r in rows.collect()) == sorted(want)
    assert toxicity.training_rows(docs, labels, "toxic", 7, lengths).count() == 7
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Sort") < plan.index("MapInArrow"), plan      # the plan's last step is its first line


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_cases(spark, module):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 1), (None, 1, 1), (5, None, None), (9, 7, 7)],
                                   "doc_id long, quality int, toxic int")
    docs = documents(spark)
    rows = module.score(docs, module.fit(docs, labels)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    none = module.fit(docs.limit(0), labels.limit(0))
    assert len(module.score(docs, none).collect()) == len(TEXTS)
    assert module.score(docs.limit(0), none).collect() == []


def test_pooled_vectors_match_a_loop(monkeypatch):
    monkeypatch.setattr(quality, "POOLED_AT_ONCE", 7)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(quality.ROWS, quality.DIM)).astype(np.float32)
    weights = rng.random(quality.ROWS).astype(np.float32)
    texts = ["", "one", "Two two, two", " ".join(f"w{i % 9}" for i in range(40)), "naïve — ünïcode!"]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    got = quality._pool(buf, off, vectors, weights)
    token, bounds = quality._tokens(buf, off)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        mean, near = np.zeros(quality.DIM), np.zeros(quality.DIM)
        own = [int(t) for t in token[a:b]]
        for t in own:
            mean += weights[t] * vectors[t]
        for s, t in zip(own, own[1:]):
            near += vectors[s] * vectors[t]
        mean /= max(sum(float(weights[t]) for t in own), 1e-9)
        near /= max(len(own) - 1, 1)
        assert np.allclose(got[i], np.concatenate((mean, near)), atol=1e-4)


def test_network_steps_match_plain_loops():
    """Two epochs of the two-layer network by sums over rows and units, and the temperature by trying all."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 5)), (rng.random(60) < 0.5).astype(float)
    center, spread, w1, b1, w2, b2, temperature = quality.fit_network(x, y, epochs=2, seed=3)
    own = np.random.default_rng(3)
    hidden = quality.HIDDEN
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    share = (y.sum() + 0.5) / 61
    p = {"w1": own.normal(0, 5 ** -0.5, (5, hidden)), "b1": np.zeros(hidden), "w2": np.zeros(hidden),
         "b2": np.array(np.log(share / (1 - share)))}
    aside = own.permutation(60)
    hold, train = aside[:12], aside[12:]
    first, second = {k: v * 0.0 for k, v in p.items()}, {k: v * 0.0 for k, v in p.items()}
    for t in (1, 2):
        rows = own.permutation(train)
        g = {k: v * 0.0 for k, v in p.items()}
        for r in rows:
            h = [np.tanh(sum(z[r, i] * p["w1"][i, j] for i in range(5)) + p["b1"][j]) for j in range(hidden)]
            out = sum(h[j] * p["w2"][j] for j in range(hidden)) + p["b2"]
            err = (1 / (1 + np.exp(-out)) - y[r]) / len(rows)
            g["b2"] = g["b2"] + err
            for j in range(hidden):
                g["w2"][j] += err * h[j]
                d = err * p["w2"][j] * (1 - h[j] ** 2)
                g["b1"][j] += d
                for i in range(5):
                    g["w1"][i, j] += z[r, i] * d
        g["w1"] += 1e-4 * p["w1"]
        g["w2"] += 1e-4 * p["w2"]
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - 0.01 * (1 - t / 3) * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    for mine, theirs in ((p["w1"], w1), (p["b1"], b1), (p["w2"], w2), (p["b2"], b2)):
        assert np.allclose(mine, theirs, atol=1e-9)
    logit = np.tanh(z[hold] @ w1 + b1) @ w2 + b2

    def loss(s):
        return np.mean([np.log(1 + np.exp(-v / s)) if k else np.log(1 + np.exp(v / s)) for v, k in zip(logit, y[hold])])

    assert loss(temperature) <= min(loss(s) for s in np.exp(np.linspace(np.log(0.25), np.log(8), 81))) + 1e-12
    assert np.allclose(center, x.mean(axis=0)) and np.allclose(spread, x.std(axis=0) + 1e-6)
