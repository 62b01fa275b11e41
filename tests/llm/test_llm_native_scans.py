import hashlib
import re

import duckdb

from llm_cases import TEXTS, documents
from shelfgap.llm import secrets, url_filter
from shelfgap.llm.oracle import ORACLE_SQL
from shelfgap.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


AWKWARD = [
    (1, 'password: token = abcdefghijk'), (2, "Api_Key='AKIAABCDEFGHIJKL' SECRET==12345678 😀 token:abc token=abcdefgh"),
    (3, "AKIAAKIA0123456789 AKIA12 " + "0123456789abcdef" * 3), (4, None), (5, ""),
    (6, "x9Kd82LmQ0pZr7Tn4VbW1yHs key and zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"), (7, "apikey=" + "é" * 40),
    (8, "x9Kd82LmQ0pZr7Tn4VbW1yHsEXAMPLE"), (9, "tokentoken=abcdefgh" * 3), (9, "tokentoken=abcdefgh" * 3),
    (None, "passwd=hunter2hunter2"), (10, "pad " * 50_000 + "secret = 'zzzzzzzzzz'"),
]


def test_base_spans_match_python(spark):
    docs = documents(spark, AWKWARD + TEXTS)
    rows = secrets.scan(docs).select("doc_id", "text", secrets.span_text(secrets.F.col("base_spans")).alias("s"))
    for r in rows.collect():
        assert r["s"] == base_spans(r["text"]), r["doc_id"]


def test_query_columns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(s.encode()).hexdigest()
        assert r["n_assign"] == s.count("assign") and r["n_hex"] == s.count("hex")
        assert set(filter(None, s.split(","))) <= set(r["spans"].split(","))


def spans_of(spark, texts):
    docs = documents(spark, list(enumerate(texts)))
    return {r["doc_id"]: r["s"] for r in secrets.scan(docs).select(
        "doc_id", secrets.span_text(secrets.F.col("spans")).alias("s")).collect()}


def test_entropy_adds_spans_and_allow_list_suppresses(spark):
    rows = {r["doc_id"]: r["s"] for r in secrets.scan(documents(spark, AWKWARD)).select(
        "doc_id", secrets.span_text(secrets.F.col("spans")).alias("s")).collect()}
    assert rows[6] == "ent_b64:0:24"        # a run of equal letters has no entropy
    assert rows[8] == "ent_b64:0:31"        # an allowed part does not hide the secret beside it


def test_kinds_of_secrets_that_entropy_finds(spark):
    body = "x9Kd82LmQ0pZr7Tn4VbW1yHsq3Gf6JcA5eXu0TiN"
    texts = [f"EXAMPLE_KEY={body}", "KEY 7QX2M9ZK4TB8WJ3PL6RN5VD1YH0SGCFA", "id k3v9x2m7q4t8w1z6p5r0b2nj end",
             "run Kd82LmQ0pZr7Tn4VbW1yH.", f"{body}== tail", "f3a9c1e07b2d48566a0e"]
    got = spans_of(spark, texts)
    assert got == {0: "ent_b64:12:52", 1: "ent_upper:4:36", 2: "ent_lower:3:27", 3: "ent_b64:4:25", 4: "ent_b64:0:42",
                   5: "ent_hex:0:20"}


def test_harmless_runs_are_left_alone(spark):
    texts = ["123e4567-e89b-12d3-a456-426614174000", "12345678901234567890123456", "some_long_snake_case_name_of_code",
             "ABCDEFGHIJ0123456789ABCDEFGHIJ0123456789", "exampleexampleexample12Ab", "z" * 40 + "1B", "path/to/some/longer/file-name",
             "qwertyuiopQWERTYUIOP1aA"]
    assert set(spans_of(spark, texts).values()) == {""}


def test_entropy_spans_equal_the_sql(spark):
    import random
    pick = random.Random(9)
    alphabets = ["ABCDEF0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                 "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "aab1B"]
    rows = [(i, " ".join(pick.choice(["", "example", "key=", "=="]) + "".join(pick.choices(pick.choice(alphabets), k=pick.randint(15, 50)))
                         + pick.choice(["", "=", "EXAMPLE", "0123456789"]) for _ in range(6))) for i in range(120)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, spans FROM ({ORACLE_SQL['op3_secrets']})").fetchall()}
    assert spans_of(spark, [t for _, t in rows]) == want


def test_window_entropy_matches_direct_computation(spark):
    from collections import Counter
    from math import log2
    words = ["ab" * 30, "abcdefghijklmnopqrstuvwxyz0123456789", "aaaa", "abcabcabd" * 4]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", secrets.max_window_bits(secrets.F.col("w"), 24).alias("b")).collect():
        best = 0.0
        for i in range(len(r["w"]) - 23):
            c = Counter(r["w"][i:i + 24])
            best = max(best, -sum(v / 24 * log2(v / 24) for v in c.values()))
        assert abs(r["b"] - best) < 1e-9


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a secret = 'abcdefgh1' b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert got == {1: "a [secret]' b", 2: None}


URLS = [
    (1, "http://example.org/es/x?q"), (2, "https://A.Example.ORG/en/12#f"), (3, "http://notexample.org/es/"),
    (4, "http://b.com/fr/1"), (5, "http://com/de/"), (6, "http://x.com"), (7, "nohost"), (8, None), (9, ""),
    (10, "http://org"), (11, "http://org/"), (12, "ftp://u@h.org:80/p"), (13, "http://a.b.example.org/en/1/../z"),
    (14, "x://y://org/"), (15, "http://example.org/en"), (16, "http://EXAMPLE.org/ES/"), (16, "http://EXAMPLE.org/ES/"),
    (None, "http://q.net/"),
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in URL_RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")


def test_url_rules(spark):
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in URLS],
                                  "page_id long, url string, host string, verdict string")
    got = sorted((tuple(r) for r in url_filter.filter_urls(pages, rules).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u in URLS), key=str)
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_hosts_of_many_labels_are_looked_up_by_the_rules_labels(spark):
    host = ".".join(f"l{i}" for i in range(4000)) + ".example.org"
    pages = spark.createDataFrame([(1, f"http://{host}/es/x"), (2, f"http://{host}/fr/"), (3, "http://solo/x")], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: "example.org/es/", 2: "org/", 3: None}


def test_nested_rules_and_many_hosts(spark):
    import random
    random.seed(5)
    parts = ["a", "b", "ab"]
    rules = [(".".join(random.choices(parts, k=random.randint(1, 3))), "/" + "".join(random.choices("xy/", k=k)),
              random.choice(["allow", "block"])) for k in range(4) for _ in range(12)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [(i, f"http://{'.'.join(random.choices(parts, k=random.randint(1, 4)))}/{''.join(random.choices('xy/', k=5))}")
            for i in range(400)]
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(
        spark.createDataFrame(urls, "page_id long, url string"),
        spark.createDataFrame(rules, url_filter.RULE_SCHEMA), default="block").collect()}
    for i, u in urls:
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fit = [(len(h) + len(p), len(h), h + p) for h, p, _ in rules
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fit)[2] if fit else None), u


def test_url_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    df = QUERIES["op9_url_filter"](spark, SF)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(ORACLE_SQL["op9_url_filter"]).fetchall(),
                                                               key=str)


def test_native_plans_have_no_python(spark):
    for name in ("op3_secrets", "op9_url_filter"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_secrets_oracle_on_awkward_rows(spark):
    """The query's SQL over rows with every kind of span, entropy spans included."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [r for r in dict(AWKWARD + TEXTS).items() if r[0] is not None]
    rows += [(50, "X9kd82lmq0pzr7tn4vbw1yhs-ABCDEFGHIJ"), (51, "see 9f86d081884c7d659a2feaa0c55ad015A3BF4F1B"),
             (52, "f" * 23 + "0123456789abcdefABCDEF9876543210")]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: (r[1:4], r[4], r[5]) for r in con.execute(ORACLE_SQL["op3_secrets"]).fetchall()}
    found = secrets.scan(documents(spark, rows)).select(
        "doc_id", secrets.span_text(secrets.F.col("base_spans")).alias("b"), secrets.span_text(secrets.F.col("spans")).alias("s"))
    for r in found.collect():
        counts = tuple(sum(x.startswith(k) for x in r["b"].split(",")) for k in ("assign", "access", "hex"))
        assert (counts, hashlib.sha256(r["b"].encode()).hexdigest(), r["s"]) == want[r["doc_id"]], r["doc_id"]


def test_join_and_search_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op2_ngram_join", "op10_ann"):
        got = QUERIES[name](spark, SF)
        want = con.execute(ORACLE_SQL[name])
        order = [got.columns.index(d[0]) for d in want.description]
        assert sorted(tuple(r[i] for i in order) for r in got.collect()) == sorted(want.fetchall()), name
