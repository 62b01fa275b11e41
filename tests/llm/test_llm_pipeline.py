from collections import Counter

import corpus_pipeline
from llm_cases import documents
from shelfgap.llm import decontaminate
from shelfgap.llm.queries import QUERIES
from test_llm_dedup import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r["doc_id"] for r in QUERIES["op1_toxicity"](spark, SF).collect() if r["predicted"]}
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        assert all(before[i] == r for i, r in rows.items())
        gone = set(before) - set(rows)
        if name == "toxicity":
            assert gone == bad
        elif name == "near copies":
            data = [(i, r["text"]) for i, r in before.items()]
            assert gone == {i for (i, _), c in zip(data, brute_components(data)) if c != i}
        elif name == "decontamination":
            found = decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
            assert gone == {r["doc_id"] for r in found}
        else:
            assert not gone
            uses = Counter(r["doc_id"] for r in out.collect())
            assert set(uses.values()) == {1, 2}
        before, docs = rows, spark.createDataFrame([tuple(r) for r in out.collect()], docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in docs.collect())


def test_run_and_awkward_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.collect()}
        assert None in ids and 4 in ids and 5 in ids
        docs = out
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark).limit(0), SF).collect() == []
    once = corpus_pipeline.drop_near_copies(spark, documents(spark), SF).collect()
    assert Counter(r["doc_id"] for r in once)[1] == 1 and 2 not in {r["doc_id"] for r in once}


def test_each_row_has_its_own_fate(spark, tmp_path):
    """Rows without an id are dropped like others; of rows with one id only those that must go."""
    toxic, leak = "you scumbag", "the answer to this question of the benchmark is forty two and nothing else"
    a = " ".join(f"copy{i}" for i in range(60))
    b = " ".join(f"other{i}" for i in range(60))
    clean = "a harmless row of words"
    train = [(100 + i, f"w{i % 7} and " + ("scumbag" if i % 3 == 0 else "friend")) for i in range(200)]
    spark.createDataFrame([(i, int("scumbag" in t)) for i, t in train], "doc_id long, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def left(stage, rows):
        out = stage(spark, documents(spark, rows), str(tmp_path)).collect()
        return Counter((r["doc_id"], r["text"]) for r in out if r["doc_id"] is None or r["doc_id"] < 100)

    for stage, bad, more in ((corpus_pipeline.drop_toxic, toxic, train), (corpus_pipeline.drop_leaks, leak, [])):
        rows = [(None, bad), (None, clean), (1, bad), (1, clean), (2, None), (None, None)]
        assert left(stage, rows + more) == Counter([(None, clean), (1, clean), (2, None), (None, None)])
    rows = [(5, a), (5, a + " x"), (5, b), (6, b), (None, a), (7, a), (6, clean), (None, "no name " + b[:300]),
            (None, "no name " + b[:300]), (None, None), (None, ""), (8, None)]
    kept = left(corpus_pipeline.drop_near_copies, rows)
    first = Counter({t: n for (i, t), n in kept.items() if i == 5 and t != b})
    assert sum(first.values()) == 1 and set(first) <= {a, a + " x"}
    assert kept - Counter((5, t) for t in first) == Counter(
        [(5, b), (6, clean), (None, "no name " + b[:300]), (None, None), (None, ""), (8, None)])
