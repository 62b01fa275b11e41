"""Ranked lexical search against a plain loop."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from llm_cases import PROSE, documents
from shelfgap.llm import lexical

ITEMS = "item_id long, text string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    docs = [(i, Counter(words(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked, found = words(text), []
        for i, c, length in docs:
            m = 25 + 75 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lexical.search(df, spark.createDataFrame(items, ITEMS), **options).collect()
    return sorted([tuple(r) for r in got], key=str)


def corpus(n=400, seed=1):
    pick = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "文字", "Straße"]
    share = 1.0 / np.arange(1, len(vocabulary) + 1)
    def text(size):
        return " ".join(pick.choice(vocabulary, size, p=share / share.sum()))
    docs = [(i, text(int(pick.integers(1, 120)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [(n + 100, text(6000))]
    return docs, [(i, text(int(pick.integers(1, 30)))) for i in range(25)] + [(90, docs[3][1]), (91, docs[5][1] * 3)]


def test_equals_a_plain_loop(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)


def test_false_positives_and_small_passes_change_nothing(spark, monkeypatch):
    docs, items = corpus(200, 2)
    expected = brute(docs, items, 5)
    monkeypatch.setattr(lexical, "BITS_PER_ENTRY", 1)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 16)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 40)
    monkeypatch.setattr(lexical, "PASS_TERMS", 150)
    monkeypatch.setattr(lexical, "EMIT_TERMS", 100)
    assert run(spark, docs, items, k=5) == expected


def test_bounds_are_never_below_the_scores(monkeypatch):
    docs, items = corpus(120, 3)
    n, total = len(docs), sum(len(words(t)) for _, t in docs)
    df = Counter(t for _, text in docs for t in set(words(text)))

    def hashed(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return lexical.terms_of(buf, np.array([0, len(buf)]))

    asked = lexical.Asked(np.arange(len(items)), [], [], n, total)
    for _, text in items:
        _, terms, counts, _ = hashed(text)
        by_hash = {int(hashed(t)[1][0]): t for t in set(words(text))}
        asked.terms.append(terms)
        asked.weights.append(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[by_hash[int(t)]] + 1))) * c
                                       for t, c in zip(terms, counts)], float))
    widths = lexical._Widths()
    blocks = []
    for i, text in docs:
        _, terms, tf, lengths = hashed(text)
        block = widths.add(i, int(lengths[0]), terms, tf)
        blocks += [block] if block is not None else []
    blocks += list(widths.rest())
    exact = {(j, i): s for j, _, i, s in brute(docs, list(enumerate(t for _, t in items)), len(docs))}
    groups, seen, equal = list(asked.groups()), 0, 0
    for block in blocks:
        for width, ids, lengths, most, slices in lexical._blocks_of(block):
            for item, bound in lexical.bounds(asked, groups, width, lengths, most, slices):
                for i, b in zip(ids.tolist(), bound.tolist()):
                    score = exact.get((item, i), 0)
                    assert b >= score
                    seen, equal = seen + 1, equal + (b == score)
    assert seen == len(docs) * len(items) and equal > 0.5 * seen


def test_awkward_rows(spark):
    docs = documents(spark)
    items = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "naïve CAFÉ 文字"), (5, "tail word5x5"), (6, "absent")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clashing = spark.createDataFrame([(*x, "q") for x in items], ITEMS + ", rank string")
    got = sorted([tuple(r) for r in lexical.search(docs, clashing).collect()], key=str)
    assert got == brute(rows, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None), (2, "")], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == []
