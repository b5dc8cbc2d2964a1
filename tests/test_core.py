"""Retrieval, maintenance and evaluation operators on small tables with known results."""

import json
import math
import subprocess
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hayrake import errors
from hayrake.engine import Engine, MockEmbedder
from hayrake.functions import paths, terms, text, vectors
from hayrake.operators import chunks as C
from hayrake.operators import dense, evaluation, fusion, labels, lexical, lookup, metrics, search, store
from hayrake.plans import catalogue, oracle
from hayrake.session import work_path
from hayrake.sources import files, git
from hayrake.streaming import incremental

SF = "/root/testdata/sf0.001"


def ask(spark, column, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.r for r in df.select("k", column(F.col("v")).alias("r")).orderBy("k").collect()]


# Catalogue against SQL

def test_catalogue_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations", "events", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    wrong = []
    for name, query in catalogue.QUERIES.items():
        got = query(spark, SF)
        if name not in oracle.ORACLE_SQL:
            assert got.count() > 0
            continue
        want = con.sql(oracle.ORACLE_SQL[name])
        if sorted(got.columns) != sorted(want.columns) or sorted(map(plain, got.select(*want.columns).collect()), key=str) != sorted(map(plain, want.fetchall()), key=str):
            wrong.append(name)
    assert wrong == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracle.ORACLE_SQL) <= set(__spark_entry__.queries())


# Text

def test_identifiers(spark):
    want = {
        "normalizeTimestamp": "normalizetimestamp normalize timestamp", "normalize_timestamp": "normalize_timestamp normalize timestamp", "parseHTTPResponse": "parsehttpresponse parse http response",
        "Tracker::update": "tracker update", "sha256": "sha256", "read_utf8_bom": "read_utf8_bom read utf8 bom", "EAGAIN": "eagain", "Iechä.": "iech", "!!!": "", "": "",
    }
    assert [" ".join(x) for x in ask(spark, text.split_identifier, *want)] == list(want.values())
    got = ask(spark, text.token_positions, "a -> b")[0]
    assert [(x.term, x.position) for x in got] == [("a", 0), ("b", 1)]
    odd = ["parseHTTPResponse next", "a -> b", "-- _ _a a_ foo_barBaz, foo_barBaz x.y.z (Foo) FooBar. 3dModel AABb HTTPServer2Go é fooé ÉfooBar \x01a\x02 a\x01b", "", " \t\n ", None, "don't -- stop-it_now ***", "XMLHttpRequest(aB,cD)"]
    plain = ask(spark, lambda t: F.flatten(F.transform(text.blank_words(t), text.split_identifier)), *odd)
    assert ask(spark, text.code_tokens, *odd) == plain
    got = ask(spark, text.token_positions, "parseHTTPResponse next")[0]
    assert [(x.term, x.position) for x in got] == [("parsehttpresponse", 0), ("parse", 0), ("http", 0), ("response", 0), ("next", 1)]


def test_normalised_bodies(spark):
    one, two, three, four = ask(spark, text.normalise_body, "\r\n\n    a  \r\n\n      b\t\n\n", "    a\n\n      b", "", " \n\t\n")
    assert one == two == "a\n\n  b" and three == four == ""
    assert ask(spark, text.normalise_body, "\t x\n \t y\n\n\t  z", "  a\rb", None, " \x0b\n  é \x0bq\n") == ["x\n y\n\n z", "  a\nb", None, "é \x0bq"]
    digest = spark.createDataFrame([(None, "a", "b"), ("a", None, "b"), ("a", "b", None)], "l string, s string, b string").select(text.content_hash(F.col("l"), F.col("s"), F.col("b")).alias("h"))
    assert digest.distinct().count() == 3


def test_normalising_is_linear(spark):
    import time

    took = []
    for n in (2000, 16000):
        began = time.perf_counter()
        (row,) = ask(spark, text.normalise_body, "".join(f"    line {k} {' ' * 50} x   \n" for k in range(n)) + " " * n + "x")
        took.append(time.perf_counter() - began)
        assert row.count("\n") == n
    assert took[1] < 10


def test_previews(spark):
    assert ask(spark, text.preview, "a" * 370, "x" * 319 + "€more", "short", "é" * 200, None) == ["a" * 320, "x" * 319, "short", "é" * 160, None]


def test_line_functions(spark):
    assert ask(spark, text.signature_line, "\n  \n  fn a() \nb", "", " ") == ["fn a()", None, None]
    assert ask(spark, text.is_doc_comment, " // a", "/* b", " * c", "#[d]", "e //") == [True, True, True, True, False]
    assert ask(spark, text.strip_doc_comments, "/// a\n// b\n  //! c\nd") == ["// b\nd"]
    assert ask(spark, lambda c: text.byte_to_line(c, F.lit(4)), "a\nb\nc", "é\n\nx") == [3, 3]
    assert ask(spark, text.maintenance_pattern, "Fix typo and WIP", "bumper", "lint: all", "none") == ["wip", None, "lint", None]
    assert ask(spark, text.length_bucket, "a b c d", "a b c d e", "a " * 11) == ["short", "medium", "long"]
    assert ask(spark, text.map_kind, "function_item", "impl_item", "x") == ["function", "impl", "other"]
    assert ask(spark, text.repo_path, "a\\b\\c.rs") == ["a/b/c.rs"] and ask(spark, text.commit_subject, " a b \n\nc") == ["a b"]


def test_exclusions(spark):
    want = {
        ".env": "secret", ".env.local": "secret", "certs/server.pem": "secret", "tls/server.key": "secret", "id_rsa": "secret", "credentials.json": "secret", "secrets.yaml": "secret", "node_modules/x/index.js": "vendor",
        "vendor/p/m.go": "vendor", "target/debug/foo": "vendor", "dist/b.js": "vendor", ".venv/lib/p.py": "vendor", "foo_pb2.py": "generated", "bar.generated.ts": "generated", "x.txt": "language", "a.RS": "language", "a.rs": None, "old/skip.rs": "gitignore",
    }
    assert dict(zip(want, ask(spark, lambda c: paths.skip_reason(c, "old/\n"), *want))) == want


# Vectors

def test_vector_functions(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [1, 1, 1]), ([[10.0, 20.0], [99.0, 99.0], [88.0, 88.0]], [1, 0, 0])], "h array<array<double>>, m array<int>")
    got = {how: [r[0] for r in df.select(vectors.pool(F.col("h"), F.col("m"), how)).collect()] for how in ("mean", "last_token", "cls")}
    assert got == {"mean": [[3, 4], [10, 20]], "last_token": [[5, 6], [10, 20]], "cls": [[1, 2], [10, 20]]}
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in v.select(vectors.l2_normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert spark.range(1).select(vectors.dead_fraction(F.lit(0), F.lit(0)), vectors.dead_fraction(F.lit(3), F.lit(1))).first()[:] == (0.0, 0.25)


# Lexical

CORPUS = [
    (0, "clamp_decoder_timestamps", "fn clamp_decoder_timestamps()", "Clamps regressing decoder timestamps", "src/decoder.rs", "if timestamp < previous { timestamp = previous + 1 }"),
    (1, "parse_decoder_timestamps", "fn parse_decoder_timestamps()", "Parses decoder timestamps", "src/parser.rs", "decode timestamp values"),
    (2, "enforce_monotonic_order", "fn enforce_monotonic_order()", "Enforces monotonic order", "src/order.rs", "sort values into monotonic order"),
    (3, "symbol3", "fn symbol3()", "documentation 3", "file3.rs", "body3 unique3"),
]


def test_bm25(spark):
    index = lexical.build(spark.createDataFrame(CORPUS, "row_id bigint, symbol string, signature string, doc_first_line string, file string, body string"))
    queries = spark.createDataFrame(list(enumerate(["decoder timestamps", "regressing timestamps", "monotonic order", "!!! :::", ""])), "query_id bigint, query string")
    got = {}
    for r in lexical.search(index, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row_id, r.score))
    want = {0: [(0, 12.01637), (1, 11.768679)], 1: [(0, 7.836977), (1, 5.8843393)], 2: [(2, 23.206722)]}
    assert got.keys() == want.keys()
    for k, rows in want.items():
        assert [r for r, _ in got[k]] == [r for r, _ in rows]
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in rows], rel=1e-5)
    assert lexical.search(index, queries, 0).count() == 0


def test_bm25_equals_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 12)))) for k in range(60)]
    index = lexical.build(spark.createDataFrame(rows, "row_id bigint, body string"), {"body": 1.0})
    asked = [(k, " ".join(rng.choice(words, 3))) for k in range(8)]
    got = {(r.query_id, r.row_id): r.score for r in lexical.scores(index, spark.createDataFrame(asked, "query_id bigint, query string"), {"body": 1.0}).collect()}
    texts = [t.split() for _, t in rows]
    mean = sum(map(len, texts)) / len(texts)
    want = {}
    for q, query in asked:
        for w in dict.fromkeys(query.split()):
            n = sum(w in t for t in texts)
            for k, t in enumerate(texts):
                if w in t:
                    f = t.count(w)
                    want[q, k] = want.get((q, k), 0) + math.log(1 + (60 - n + 0.5) / (n + 0.5)) * 2.2 * f / (f + 1.2 * (0.25 + 0.75 * len(t) / mean))
    assert got == pytest.approx(want, abs=1e-6)


def test_rows_are_counted_and_scored_where_they_are_read(spark):
    kinds = "row_id bigint, symbol string, body string"
    rng = np.random.default_rng(3)
    words = ["plain", "Word,", "fooBar", "foo_bar", "XMLHttp", "--", "é", "aéB", "(x.y)", "don't", "A1b", "HTTPServer2Go", "\x01a\x02", "_", "a\xa0b", "3dModel", "ABc", "\u2003"]
    rows = [(k, None if k % 7 == 0 else f"s{k % 3}", " \t\n".join(rng.choice(words, rng.integers(0, 9)))) for k in range(90)]
    rows += [(5, "s5", "fooBar twice"), (5, None, "word"), (91, "s", None), (None, "none", "plain word"), (None, None, "plain")]
    index = lexical.build(spark.createDataFrame(rows, kinds).repartition(4), {"symbol": 4.0, "body": 1.0})
    pairs = spark.createDataFrame([(i, f, t) for i, s, b in rows for f, t in (("symbol", s), ("body", b)) if t is not None], "row_id bigint, field string, text string")
    want = pairs.select("row_id", "field", F.explode(text.code_tokens(F.col("text"))).alias("term")).groupBy("field", "term", "row_id").agg(F.count("*").alias("tf"))
    assert sorted(map(str, index.postings.select("field", "term", "row_id", "tf").collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(k, " ".join(rng.choice(words, 4))) for k in range(12)] + [(None, "word")], "query_id bigint, query string")
    plain = lexical.Index(index.postings, index.documents, index.lengths, index.n)  # without records: by the shuffle
    by_key = lambda df: {(r.query_id, r.row_id): r.score for r in df.collect()}
    for boosts in ({"symbol": 4.0, "body": 1.0}, {"symbol": 2.0}):
        some = lexical.scores(index, asked, boosts)
        assert "Exchange" not in some._jdf.queryExecution().executedPlan().toString()
        assert by_key(some) == pytest.approx(by_key(lexical.scores(plain, asked, boosts)), abs=2e-8)
        for limit in (1, 3, 200):
            tell = lambda x: sorted((str(r.query_id), r["rank"], str(r.row_id), round(r.score, 6)) for r in lexical.search(x, asked, limit, boosts).collect())  # noqa: B023, E731
            assert tell(index) == tell(plain)
    held = terms.HELD, terms.CELLS
    try:  # many small prunings
        terms.HELD, terms.CELLS = 0, 40
        records = [b for b in index.records.filter("row_id is not null").toArrow().to_batches(max_chunksize=5)]
        known = lexical._known(index, asked.filter("query_id is not null"), None).toArrow()
        got = [(r["query_id"], r["row_id"]) for b in terms.scorer(known, 1.2, 0.75, 8, 2)(iter(records)) for r in b.to_pylist()]
    finally:
        terms.HELD, terms.CELLS = held
    assert sorted(got) == sorted((r.query_id, r.row_id) for r in lexical.search(index, asked.filter("query_id is not null"), 2).filter("row_id is not null").collect())
    assert terms.rounded(np.array([0.125, 1.000000005, 2.5e-9, 7.0]), 2).tolist() == [0.13, 1.0, 0.0, 7.0]


def test_large_batches_of_queries_go_to_the_records_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(f"w{j}" for j in rng.zipf(1.5, n) % 40)
    index = lexical.build(spark.createDataFrame([(k, some(12), some(2)) for k in range(150)], "row_id bigint, body string, symbol string"), {"symbol": 4.0, "body": 1.0})
    asked = [(k, some(k % 9)) for k in range(60)] + [(60, "nowhere"), (None, "w1 w2"), (61, " ".join(f"w{j}" for j in range(40)))]
    asked = spark.createDataFrame(asked, "query_id bigint, query string")
    tell = lambda limit: sorted((str(r.query_id), r["rank"], r.row_id, r.score) for r in lexical.search(index, asked, limit).collect())
    want = {limit: tell(limit) for limit in (1, 7)}
    every, shuffled = lexical._all_scores, []

    def counted(index, known):
        found = every(index, known)
        shuffled.append({r.query_id for r in found.select("query_id").distinct().collect()})
        return found

    monkeypatch.setattr(lexical, "_all_scores", counted)
    for terms_held, rows_held, by_shuffle in ((40, 10**6, {61}), (10**6, 20, set()), (100, 50, set())):
        monkeypatch.setattr(lexical, "BROADCAST_ROWS", terms_held)
        monkeypatch.setattr(lexical, "BEST_ROWS", rows_held)
        for limit in want:
            shuffled.clear()
            assert tell(limit) == want[limit]
            assert set().union(*shuffled) == by_shuffle  # all the others' scores are summed where the rows are read


def test_row_stats_whatever_is_broadcast(spark, monkeypatch):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 11 + 1)) + f" own{k // 2} own{k // 2}") for k in range(50)]
    index = lexical.build(spark.createDataFrame(rows, "row_id bigint, body string"), {"body": 1.0})
    want = sorted((k, k % 11 + 2, k % 11 + 3, 2) for k in range(50))
    for most in (10**6, 8, 0):
        monkeypatch.setattr(lexical, "BROADCAST_ROWS", most)
        assert sorted(map(tuple, lexical.row_stats(index).collect())) == want


def test_hashed_vectors_equal_a_plain_loop():
    def plain(data, dims):
        state, mask, out = 0xC0FFEE, (1 << 64) - 1, np.zeros(dims, dtype=np.float32)
        for i, byte in enumerate(data.encode()):
            state = (state * 0x9E3779B97F4A7C15 + byte + i) & mask
            out[state % dims] += np.float32(state >> 32) / np.float32(0xFFFFFFFF) * np.float32(2) - np.float32(1)
        if not out.any():
            out[0] = 1
        return (out / np.sqrt((out.astype(np.float64) ** 2).sum())).astype(np.float16).astype(np.float32)

    long = "é plain words, " * 9000  # more than one block
    for data, dims in (("", 16), ("a", 16), ("é\x00\n", 7), (long, 16), (long[:65536], 3), (long[:61166], 1)):
        assert vectors.hashed_vector(data, dims).tobytes() == plain(data, dims).tobytes()
    began = time.process_time()
    vectors.hashed_vector(long * 20, 16)  # 2.9 MB: a loop over bytes takes seconds
    assert time.process_time() - began < 1.5


# Dense and fusion

def test_a_maintained_index_equals_a_new_one(spark):
    kind = "row_id bigint, symbol string, body string, extra int, live boolean"
    rows = {0: ("alpha", "one two two"), 1: ("beta", None), 2: (None, ""), 3: ("alpha", "three"), 4: ("gone", "four words of it"), 5: ("alpha", "one two two")}
    table = lambda some, live=True: spark.createDataFrame([(k, *v, 7, live) for k, v in some.items()], kind)
    ids = lambda *some: spark.createDataFrame([(k,) for k in some], "row_id bigint")

    def same(index, some):
        want = lexical.build(table(some))
        for name in ("postings", "documents", "lengths"):
            a, b = getattr(index, name), getattr(want, name)
            assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
        assert index.n == want.n == len(some) and sorted(r.row_id for r in index.rows.collect()) == sorted(some)

    first = lexical.build(table(rows))
    same(first, rows)
    edits = {0: ("alpha", "other words"), 1: ("beta", "now"), 9: ("new", "one three")}
    second = lexical.upsert(first, table(edits), ids(4, 4, 77, 0))  # 0 is of both, 77 was never there
    now = {k: v for k, v in (rows | edits).items() if k != 4}
    same(second, now)
    same(first, rows)
    same(lexical.upsert(second, table({3: rows[3]}, live=False), ids()), {k: v for k, v in now.items() if k != 3})
    same(lexical.upsert(second, table({}), ids()), now)
    same(lexical.upsert(lexical.build(table({})), table(rows), ids(1)), rows)
    mapping = {9: 0, 5: 1, 0: 2}
    third = lexical.renumber(second, spark.createDataFrame(list(mapping.items()), "old_id bigint, new_id bigint"))
    same(third, {new: now[old] for old, new in mapping.items()})
    changed, gone = store.changed_rows(table(rows), table(now), ["symbol", "body"])
    assert sorted(r.row_id for r in changed.collect()) == [0, 1, 9] and [r.row_id for r in gone.collect()] == [4]


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0], True), (1, [0.0, 1.0, 0.0], True), (2, [0.0, 0.0, 1.0], True), (3, [1.0, 1.0, 0.0], False), (4, [-1.0, 0.0, 0.0], True)], "row_id bigint, vector array<float>, live boolean")
    q = spark.createDataFrame([(0, [1.0, 0.5, -1.0])], "query_id bigint, query_vector array<double>")
    assert [(r.row_id, r.score) for r in dense.search(v, q, 10).orderBy("rank").collect()] == [(0, 1.0), (1, 0.5), (2, -1.0), (4, -1.0)]
    assert dense.search(v, q, 0).count() == 0
    bad = spark.createDataFrame([(0, [1.0, float("nan"), 0.0])], "row_id bigint, vector array<float>")
    with pytest.raises(Exception, match="not finite"):
        dense.search(bad, q, 3).collect()
    with pytest.raises(Exception, match="dimensions"):
        dense.search(spark.createDataFrame([(0, [1.0])], "row_id bigint, vector array<float>"), q, 3).collect()
    with pytest.raises(errors.ModelMismatch):
        dense.check_model("a", "b")


def test_dense_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(1000, 64)).astype(np.float32), rng.normal(size=(50, 64)).astype(np.float32)
    v = spark.createDataFrame([(k, x.tolist(), k % 19 != 0) for k, x in enumerate(m)], "row_id bigint, vector array<float>, live boolean").repartition(5)
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "query_id bigint, query_vector array<float>")
    got = {}
    for r in dense.search(v, asked, 25).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.row_id)
    scores = np.round(q.astype(float) @ m.astype(float).T, 9)
    assert got == {k: sorted((i for i in range(1000) if i % 19), key=lambda i: (-scores[k, i], i))[:25] for k in range(50)}


def test_only_the_best_vectors_of_a_task_leave_it(spark, monkeypatch):
    rng = np.random.default_rng(8)
    matrix, asked = rng.integers(-3, 4, (4500, 3)).astype(float), rng.integers(-3, 4, (3, 3)).astype(float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(matrix)], "row_id bigint, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "query_id bigint, query_vector array<double>")
    for limit in (4, 5000):
        want = [(q, k, r, (matrix @ asked[q])[r]) for q in range(3) for k, r in enumerate(np.lexsort((np.arange(4500), -(matrix @ asked[q])))[:limit], 1)]
        for most in (10**6, 2):
            monkeypatch.setattr(dense, "BEST_ROWS", most)
            assert sorted((r.query_id, r["rank"], r.row_id, r.score) for r in dense.search(table, queries, limit).collect()) == want
    monkeypatch.setattr(dense, "BEST_ROWS", 10**6)
    assert dense._best(table, [0, 1, 2], asked, 4).count() == 12  # there are several Arrow batches


def ranked(spark, *rows):
    return spark.createDataFrame([(0, r, 1.0 / (k + 1), k + 1) for k, r in enumerate(rows)], "query_id bigint, row_id bigint, score double, rank int")


@pytest.mark.parametrize("lexical_rows, dense_rows, order", [
    ((10, 20), (30, 40, 10), [10, 30, 20, 40]), ((99,), (), [99]), ((11, 2, 12, 13, 5), (21, 22, 23, 24, 5), [5, 11, 21, 2, 22, 12, 23, 13, 24]), ((7,), (3,), [3, 7]),
])
def test_fusion(spark, lexical_rows, dense_rows, order):
    got = fusion.fuse(ranked(spark, *lexical_rows), ranked(spark, *dense_rows)).orderBy("rank").collect()
    assert [r.row_id for r in got] == order
    if order == [99]:
        assert got[0].fused_score == pytest.approx(1 / 61, abs=1e-12) and got[0].dense_rank is None and got[0].dense_score is None
    if order[0] == 10:
        assert got[0].fused_score == pytest.approx(1 / 61 + 1 / 63, abs=1e-12)


def test_degradation(spark):
    v = spark.createDataFrame([(0, [1.0])], "row_id bigint, vector array<float>")
    q = spark.createDataFrame([(0, "a", [1.0])], "query_id bigint, query string, query_vector array<float>")
    broken = lexical.Index(spark.createDataFrame([], "x int"), spark.createDataFrame([], "x int"), spark.createDataFrame([], "x int"), 1)
    a, b, told = search.candidates(broken, v, q)
    assert (told.lexical_ok, told.dense_ok, a.count(), b.count()) == (False, True, 0, 1)
    with pytest.raises(errors.SearchFailed):
        search.candidates(broken, v.withColumn("vector", F.lit("x")), q)
    with pytest.raises(errors.SearchFailed):
        search.similar(v, v, q.withColumn("query_vector", F.array(F.lit(1.0), F.lit(2.0))))


def test_results_keep_absent_scores(spark):
    c = spark.createDataFrame([(1, "f", "s", "g", None, 1, 2, "b" * 400, True), (2, "f", "s", "g", None, 1, 2, "b", False)], "row_id bigint, file string, symbol string, signature string, doc_first_line string, line_start int, line_end int, body string, live boolean")
    got = fusion.assemble(fusion.fuse(ranked(spark, 1, 2), ranked(spark)), c, 5)
    told = json.loads(fusion.as_json(got).first().json)
    assert list(told) == ["file", "symbol", "signature", "doc", "preview", "lines", "lexical_score", "dense_score", "fused_score"]
    assert told["dense_score"] is None and told["lines"] == [1, 2] and len(told["preview"]) == 320 and got.count() == 1


# Lookups

def test_lookups(spark):
    c = spark.createDataFrame([(k, "f" if k < 3 else "g", "s" if k in (1, 3, 4) else f"s{k}", f"sig{k}", k != 2, f"h{k}") for k in range(5)], "row_id bigint, file string, symbol string, signature string, live boolean, content_hash string")
    request = spark.createDataFrame([(k, r) for k, r in enumerate([4, 2, 0, 1, 3, 9])], "ord int, row_id bigint")
    assert [r.signature for r in lookup.get_many(c, request).orderBy("ord").collect()] == ["sig4", None, "sig0", "sig1", "sig3", None]
    wanted = spark.createDataFrame([("f", "s"), ("g", "s"), ("f", "s2"), ("f", "no")], "file string, symbol string")
    got = {(r.file, r.symbol): (r.outcome, r.row_id, r.candidates) for r in lookup.symbol_lookup(c, wanted).collect()}
    assert got == {("f", "s"): ("found", 1, None), ("g", "s"): ("ambiguous", None, ["g:sig3", "g:sig4"]), ("f", "s2"): ("not_found", None, None), ("f", "no"): ("not_found", None, None)}
    assert lookup.get(c, 2).count() == 0 and lookup.get_by_hash(c, "h3").first().row_id == 3 and [r.row_id for r in lookup.rows_for_file(c, "f").collect()] == [0, 1]


def test_containment_and_names(spark):
    spans = spark.createDataFrame([("f", 0, 0, 9000, "outer"), ("f", 1, 10, 5000, "mid"), ("f", 2, 4990, 5000, "leaf"), ("f", 3, 8990, 9001, "apart"), ("g", 4, 10, 20, "other")], "file string, id int, start bigint, end bigint, name string")
    assert {(r.outer_id, r.inner_id) for r in lookup.contained(spans, ["file"]).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert {r.id: r.qualified for r in lookup.qualified_names(spans, ["file"]).collect()} == {0: "outer", 1: "outer::mid", 2: "outer::mid::leaf", 3: "apart", 4: "other"}


# Metrics

def test_percentiles(spark):
    p = lambda values, q: spark.createDataFrame([(float(v),) for v in values], "x double").agg(metrics.nearest_rank(q, "x")).first()[0]
    assert (p(range(1, 101), 0.95), p([10, 20, 30, 40], 0.5), p([42], 0.1), p([], 0.5)) == (95, 20, 42, 0)


def test_ranks_and_bytes(spark):
    results = spark.createDataFrame([(0, 1, "a", "x", "11"), (0, 2, "a", "y", "22222"), (1, 1, "b", "x", "333"), (1, 2, "b", "y", "4")], "query_id bigint, rank int, file string, symbol string, json string")
    expected = spark.createDataFrame([(0, "a", "y"), (0, "z", "z"), (1, "b", "q"), (2, "c", "c")], "query_id bigint, file string, symbol string")
    hits = metrics.first_hits(results, expected)
    assert {r.query_id: r.first_rank for r in hits.collect()} == {0: 2, 1: None, 2: None}
    got = metrics.summary(hits).first()
    assert (got.labels_scored, got.top_1, got.top_3, got.mrr) == (3, 0, pytest.approx(1 / 3), pytest.approx(1 / 6))
    assert {r.query_id: r.bytes for r in metrics.bytes_before_hit(results, hits).collect()} == {0: 7, 1: 4}
    assert metrics.summary(hits.limit(0)).first().mrr == 0


# Maintenance

def test_first_hits_without_pairs_of_items_and_vectors(spark, tmp_path, monkeypatch):
    items, n = list(range(0, 120, 3)) + [0, 900], 400
    label = lambda k: None if k % 10 == 6 else k % 7
    spark.createDataFrame([(k, f"item {k}") for k in items], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, [float(k)], label(k)) for k in range(n)], "vec_id bigint, embedding array<float>, label bigint").write.parquet(f"{tmp_path}/embeddings.parquet")
    rng = np.random.default_rng(2)
    lists = [[(q, int(r), 1.0, k + 1) for q in sorted(set(items)) for k, r in enumerate(rng.choice(n + 9, 12, replace=False))] for _ in range(2)]
    frames = [spark.createDataFrame(rows, "query_id bigint, row_id bigint, score double, rank int") for rows in lists]
    written, keep = [], catalogue.materialise

    def counted(df, name):
        found = keep(df, name)
        written.append(found.count())
        return found

    monkeypatch.setattr(catalogue, "materialise", counted)
    got = {(r.config, r.query_id): r.first_rank for r in catalogue._first_hits(spark, str(tmp_path), *frames).collect()}
    known = lambda k: k < n and label(k) is not None
    want = {}
    for config, some in (("fused", lists), ("lexical_only", lists[:1]), ("dense_only", lists[1:])):
        for q in set(filter(known, items)):
            score = {}
            for _, r, _, k in (x for rows in some for x in rows if x[0] == q):
                score[r] = score.get(r, 0) + 1 / (60 + k)
            order = sorted(score, key=lambda r: (-round(score[r], 12), r))[:10]
            want[config, q] = next((k + 1 for k, r in enumerate(order) if known(r) and label(r) == label(q)), None)
    assert got == want and {None, 1, 2} <= set(want.values())
    assert max(written) <= 30 * len(items)  # best rows, not vectors of the item's label (about 50 an item)


def test_evaluation(spark, tmp_path):
    hits = spark.createDataFrame([("fused", 0, 1), ("fused", 1, 4), ("fused", 2, None), ("lexical_only", 0, None), ("lexical_only", 1, 1), ("lexical_only", 2, 11), ("fused", 9, 1)], "config string, query_id bigint, first_rank int")
    asked = spark.createDataFrame([(0, "few words", "commit_subject"), (1, "this one has as many as six", "docstring"), (2, "few", None)], "query_id bigint, query string, source string")
    found = evaluation.evaluate(hits, asked, 5)
    got = {(r.part, r.name): (r.labels_scored, r.top_1, r.top_3, r.top_10, r.mrr) for r in found.collect()}
    third = 1 / 3
    assert got == {
        ("ablation", "fused"): (3, third, third, 2 / 3, pytest.approx(1.25 / 3)), ("ablation", "lexical_only"): (3, third, third, third, pytest.approx((1 + 1 / 11) / 3)),
        ("source", "commit_subject"): (1, 1, 1, 1, 1), ("source", "docstring"): (1, 0, 0, 1, 0.25), ("source", None): (1, 0, 0, 0, 0),
        ("length", "short"): (2, 0.5, 0.5, 0.5, 0.5), ("length", "medium"): (1, 0, 0, 1, 0.25),
    }
    evaluation.write_report(found, evaluation.RunManifest("a", "b", "mock", "mined", "now"), str(tmp_path / "report"))
    told = json.loads("".join(p.read_text() for p in (tmp_path / "report").glob("part-*")))
    assert told["manifest"]["fusion"] == {"lexical_depth": 50, "dense_depth": 50, "rrf_k": 60.0} and told["manifest"]["harness_version"] == 1
    assert told["per_ablation"]["fused"]["labels_discarded"] == 5 and set(told["by_query_length"]) == {"short", "medium"} and told["by_source"]["docstring"]["mrr"] == 0.25
    assert evaluation.evaluate(hits.limit(0), asked).count() == 0
    read = spark.createDataFrame([(0, 10), (1, 30)], "query_id bigint, bytes bigint")
    base = spark.createDataFrame([(0, 100), (1, 200), (2, 300)], "query_id bigint, bytes bigint")
    assert evaluation.medians(read, base).first() == (10, 200) and evaluation.medians(read.limit(0), base.limit(0)).first() == (0, 0)


def test_dedup_insert_and_compaction(spark):
    live = spark.createDataFrame([(5, "a"), (6, "b")], "row_id bigint, content_hash string")
    batch = spark.createDataFrame([(k, h) for k, h in enumerate(["c", "a", "d", "c"])], "ord bigint, content_hash string")
    got = {r.ord: (r.row_id, r.outcome) for r in store.dedup_insert(live, batch, 7).collect()}
    assert got == {0: (7, "inserted"), 1: (5, "reused"), 2: (8, "inserted"), 3: (7, "reused")}
    c = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") >= 300).alias("live"))
    assert {r.old_id: r.new_id for r in store.compaction_map(c).collect()} == {k: k - 300 for k in range(300, 1000)}
    assert store.stats(c).first()[:] == (700, 300, 0.3)
    assert store.compaction_map(c.limit(0)).count() == 0


def test_snapshot_diff_and_verify(spark):
    old = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "c"), ("h", "d")], "file string, content_hash string")
    new = spark.createDataFrame([("f", "a"), ("f", "x"), ("g", "c"), ("g", "c"), ("i", "e")], "file string, content_hash string")
    got = {(r.file, r.content_hash): r.action for r in store.snapshot_diff(old, new).collect()}
    assert got == {("f", "a"): "keep", ("f", "b"): "tombstone", ("f", "x"): "add", ("g", "c"): "skip", ("h", "d"): "tombstone", ("i", "e"): "add"}
    c = spark.createDataFrame([(0, "a", True), (1, "a", True), (2, "b", True), (3, "b", False)], "row_id bigint, content_hash string, live boolean")
    v = spark.createDataFrame([(0,), (1,), (3,), (9,)], "row_id bigint")
    assert {(r.problem, r.row_id) for r in store.verify(c, v).collect()} == {("orphan", 9), ("missing", 2), ("duplicate", 0), ("duplicate", 1)}


def test_change_work_and_merge(spark):
    kind = "ord int, op string, path string, from_path string"
    got = store.change_work(spark.createDataFrame([(0, "M", "a", None)], kind), spark.createDataFrame([(0, "D", "a", None), (1, "A", "b", None), (2, "M", "b", None)], kind)).collect()
    assert {r.path: (r.op, r.ord) for r in got} == {"a": ("M", 0), "b": ("A", 1)}
    state = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2")], "file string, language string, text string")
    batch = spark.createDataFrame([(1, "M", "a", None, "x", "3"), (2, "D", "a", None, None, None), (3, "R", "c", "b", "x", "2")], incremental.FEED)
    assert {(r.file, r.text) for r in incremental.merge_state(state, batch).collect()} == {("c", "2")}


def test_store(spark):
    path = work_path(spark, "store")
    s = store.Store.create(spark, path, "m", 2)
    with pytest.raises(errors.StoreNotEmpty):
        store.Store.create(spark, path, "m", 2)
    batch = spark.createDataFrame([(k, f"f{k}", f"h{min(k, 3)}", "body") for k in range(5)], "ord bigint, file string, content_hash string, body string")
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "ord bigint, vector array<float>")
    assert {r.ord: r.outcome for r in s.insert(batch, v).collect()} == {0: "inserted", 1: "inserted", 2: "inserted", 3: "inserted", 4: "reused"}
    with pytest.raises(errors.DimensionMismatch):
        s.insert(batch, v.withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    again = store.Store.open(spark, path)
    assert again.chunks.count() == 4 and again.verify().count() == 0 and again.manifest.model_id == "m"
    with pytest.raises(errors.ModelMismatch):
        again.check_model("other")
    s.publish(s.chunks, s.vectors.union(spark.createDataFrame([(8, [0.0, 0.0])], "row_id bigint, vector array<float>")))
    assert store.Store.open(spark, path).vectors.count() == 4
    s = store.Store.open(spark, path)
    s.update(store.tombstone(s.chunks, spark.createDataFrame([(0,), (1,)], "row_id bigint")))
    assert {r.old_id: r.new_id for r in s.compact().collect()} == {2: 0, 3: 1} and s.compact() is None
    assert [(r.row_id, list(r.vector)) for r in s.vectors.orderBy("row_id").collect()] == [(0, [1.0, 2.0]), (1, [1.0, 3.0])]
    s.publish(s.chunks, s.vectors.filter("row_id = 0"))
    with pytest.raises(errors.CorruptStore):
        store.Store.open(spark, path)


# Labels

def test_mining(spark):
    commits = spark.createDataFrame([
        ("1", 1, "Add the alpha helper function"), ("2", 2, "Merge it all back again"), ("3", 1, "Fix typo in the docs"), ("4", 1, "too short"), ("5", 1, "Touch nothing that has symbols"), ("6", 1, "Touch very many symbols here"),
        ("7", 1, "Touch one that is unknown"), ("8", 1, "wip"),
    ], "commit_id string, parents int, message string")
    touched = spark.createDataFrame([("1", "a", "x"), ("1", "a", "x"), ("1", "a", "<file_prelude>"), ("7", "a", "no"), *(("6", "a", f"s{k}") for k in range(4))], "commit_id string, file string, symbol string")
    known = spark.createDataFrame([("a", "x"), *(("a", f"s{k}") for k in range(4))], "file string, symbol string")
    mined = labels.mine_commits(commits, touched, known)
    got = {r.commit_id: r.reason for r in mined.collect()}
    assert got == {"1": None, "2": "merge", "3": "maintenance_pattern", "4": "subject_too_short", "5": "no_symbols_touched", "6": "too_many_symbols", "7": "symbol_not_indexed", "8": "maintenance_pattern"}
    report = labels.mining_report(mined).first()
    assert (report.commits_examined, report.labels_accepted) == (8, 1) and sum(report.rejected.values()) == 7
    only = labels.commit_labels(mined).first()
    assert (only.query, [tuple(x) for x in only.expected], only.provenance) == ("Add the alpha helper function", [("a", "x")], "1")


def test_custom_patterns(spark):
    subjects = ["WIP on it", "a c++ fix (release)", "release it", "nothing", "typo release", None]
    assert ask(spark, lambda c: text.maintenance_pattern(c, ("release", "Typo", "a.b")), *subjects) == [None, "custom", "custom", None, "custom", None]
    assert ask(spark, lambda c: text.maintenance_pattern(c, ("Typo", "release")), "typo release", "a.b axb") == ["typo", None]
    assert ask(spark, lambda c: text.maintenance_pattern(c, ()), "wip") == [None] and ask(spark, text.maintenance_pattern, *subjects)[:2] == ["wip", None]


def test_baseline_in_blocks(spark, monkeypatch):
    asked = spark.createDataFrame([(k, w) for k, w in enumerate(["ab x", "b", "ab y", "", "zz", "c d"])], "query_id bigint, query string")
    bodies = spark.createDataFrame([("f1", "xabx"), ("f2", "b c"), ("f3", None), ("f4", "cc")], "file string, body string")
    expected = spark.createDataFrame([(0, "f1"), (1, "f2"), (5, "f9")], "query_id bigint, file string")
    want = {0: 4, 1: 7, 2: 4, 3: 0, 4: 0, 5: 5}
    for block in (10_000, 1):
        monkeypatch.setattr(metrics, "WORD_BLOCK", block)
        assert {r.query_id: r.bytes for r in metrics.baseline_bytes(asked, bodies, expected).collect()} == want


def test_docstrings_and_held_out(spark):
    c = spark.createDataFrame([(0, "f", "s", "/// One.", 5, "/// One.\nfn s() {}"), (1, "f", "s", "/// Two.", 1, "b"), (2, "f", "<file_prelude>", "/// P", 1, "b"), (3, "g", "t", None, 1, "//! x\n// y")], "row_id bigint, file string, symbol string, doc_first_line string, line_start int, body string")
    assert [(r.query, r.provenance) for r in labels.mine_docstrings(c).collect()] == [("/// Two.", "f::s")]
    assert {r.row_id: (r.doc_first_line, r.body) for r in labels.held_out(c).collect()}[0] == (None, "fn s() {}")


# A repository from end to end

def run(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


def commit(root, message, files_=(), deletes=(), renames=()):
    for name, body in files_:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    for name in deletes:
        (root / name).unlink()
    for a, b in renames:
        run(root, "mv", a, b)
    run(root, "add", "-A")
    run(root, "commit", "-m", message)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run(root, "init", "-q")
    body = lambda name: f"/// Tells of {name}.\nfn {name}() {{\n    let a = \"{name} text\";\n}}\n"
    commit(root, "Begin the whole thing now", [("src/a.rs", body("alpha") + "\n" + body("beta")), ("src/b.rs", body("gamma")), ("vendor/x.rs", body("vendored")), ("skip.me.rs", body("ignored")), (".gitignore", "skip.*\n"), ("bin.rs", "a\0b"), ("src/__init__.py", ""), (".env", "S=1")])
    return root


def test_engine(spark, repo, tmp_path):
    walked = {r.file: r.reason for r in files.walk(spark, str(repo), files.read_gitignore(spark, str(repo))).collect()}
    assert walked["src/a.rs"] is None and walked["vendor"] == "vendor" and walked["src/__init__.py"] is None and walked["skip.me.rs"] == "gitignore" and walked["bin.rs"] == "binary" and walked[".env"] == "secret"
    s = store.Store.create(spark, str(tmp_path / "store"), "mock", 64)
    stages = []
    engine = Engine(spark, s, MockEmbedder(), stages.append)
    first = engine.index_repository(str(repo))
    assert (first["added"], first["live"], first["dead"]) == (3, 3, 0) and stages == ["walking", "parsing", "storing"]
    assert engine.search_code("alpha text", 3).first().symbol == "alpha" and engine.get_symbol("src/b.rs", "gamma")["line_start"] == 1
    assert engine.find_similar_code(engine.get_symbol("src/b.rs", "gamma")["body"], 1).first().symbol == "gamma"
    with pytest.raises(errors.SymbolNotFound):
        engine.get_symbol("src/b.rs", "alpha")
    with pytest.raises(errors.IndexInProgress):
        engine.indexing = True
        engine.index_repository(str(repo))
    engine.indexing = False
    text_ = (repo / "src/a.rs").read_text()
    commit(repo, "Change beta in some way", [("src/a.rs", text_.replace("beta text", "beta words"))])
    second = engine.index_repository(str(repo))
    assert (second["added"], second["removed"], second["embedded"], second["live"]) == (1, 1, 1, 3)
    commit(repo, "Move the file elsewhere now", renames=[("src/b.rs", "src/c.rs")])
    third = engine.index_repository(str(repo))
    assert (third["added"], third["removed"]) == (0, 0) and engine.get_symbol("src/c.rs", "gamma")["symbol"] == "gamma"
    (repo / "src/d.rs").write_text("fn delta() { 1 }\n")
    with pytest.raises(errors.DirtyWorktree, match="src/d.rs"):
        engine.index_repository(str(repo), policy="refuse")
    assert engine.index_repository(str(repo))["added"] == 1 and engine.status()["indexed_commit"].endswith("+dirty")
    (repo / "src/d.rs").unlink()
    commit(repo, "Remove most of the code", deletes=["src/a.rs"])
    last = engine.index_repository(str(repo), full=True)
    built = lexical.build(engine.chunks)
    assert sorted(map(str, engine.index.postings.select(built.postings.columns).collect())) == sorted(map(str, built.postings.collect())) and engine.index.n == built.n == 1
    assert last["live"] == 1 and engine.status()["indexed_commit"] == git.head(str(repo))
    history = git.commits(spark, str(repo))
    assert labels.recent(history, 1).first().message == "Remove most of the code" and history.count() == 4
    changes = git.commit_changes(spark, str(repo), history)
    lines = labels.changed_lines(changes)
    kinds = changes.filter("new_text is not null").select("commit_id", "file", F.lit("rust").alias("language"), F.col("new_text").alias("text")).filter("file like '%.rs'")
    whole = labels.touched_symbols(changes.withColumn("language", F.when(F.col("file").like("%.rs"), "rust")))
    per = None
    for c in history.select("commit_id").collect():
        own = C.chunk_files(kinds.filter(F.col("commit_id") == c.commit_id)).filter("problem is null").withColumn("commit_id", F.lit(c.commit_id))
        per = own if per is None else per.union(own)
    touched = lookup.touched(lines, per)
    assert sorted(whole.collect()) == sorted(touched.collect()) and whole.count() > 3
    second_id = history.filter("message like 'Change beta%'").first().commit_id
    assert [(r.file, r.symbol) for r in touched.filter(F.col("commit_id") == second_id).collect()] == [("src/a.rs", "beta")]
    with pytest.raises(errors.RevisionMismatch):
        git.require_revision(str(repo), "0" * 40)


def test_json_labels(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"query": "a", "expected": [["f", "s"], ["g", "t"]]}, {"query": "b", "expected": []}]))
    got = files.json_labels(spark, str(tmp_path / "l.json")).orderBy("provenance").collect()
    assert [(r.query, [tuple(e) for e in r.expected], r.provenance) for r in got] == [("a", [("f", "s"), ("g", "t")], "handwritten:0"), ("b", [], "handwritten:1")]


def test_handwritten_labels(spark, tmp_path):
    for n in (24, 25):
        (tmp_path / "h.json").write_text(json.dumps([{"query": f"q{k}", "expected": [["f", "s"]]} for k in range(n)]))
        if n == 25:
            assert files.handwritten_labels(spark, str(tmp_path / "h.json")).count() == 25
        else:
            with pytest.raises(ValueError):
                files.handwritten_labels(spark, str(tmp_path / "h.json"))


def test_stream_of_changes(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "1.json").write_text('{"seq": 1, "op": "A", "path": "a.rs", "language": "rust", "text": "fn a() { 1 }"}\n{"seq": 2, "op": "A", "path": "b.rs", "language": "rust", "text": "fn b() { 2 }"}\n')
    s = store.Store.create(spark, str(tmp_path / "store"), "mock", 8)
    embed = lambda rows: rows.select("ord", vectors.mock_embedding(8)(F.col("body")).alias("vector"))
    reports = []
    apply = lambda batch, _: reports.append(incremental.index_changes(s, batch, C.chunk_files, embed))
    incremental.run_stream(spark, str(folder), str(tmp_path / "cp"), apply)
    (folder / "2.json").write_text('{"seq": 3, "op": "D", "path": "b.rs"}\n')
    incremental.run_stream(spark, str(folder), str(tmp_path / "cp"), apply)
    assert [r["added"] for r in reports] == [2, 0] and reports[1]["removed"] == 1
    assert [r.symbol for r in s.chunks.filter("live").collect()] == ["a"]


