"""The operators of hayrake.llm against brute force on small tables, and their behaviour at the edges."""

import base64
import collections
import functools
import hashlib
import io
import itertools
import re
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from hayrake.llm import decontam, graph, langid, linededup, media, neardup, packing, pii, quality, queries, texts, urlfilter, warc
from hayrake.session import table, work_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], DOCS)


def rows_of(spark, name, sf=SF):
    return table(spark, sf, name).collect()


# Words

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.0日", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_are_the_same_in_pieces(column, piece):
    old, texts.PIECE = texts.PIECE, piece
    try:
        data, offsets = texts.text_bytes(pa.array(column, pa.string()))
        s, e, r, h = texts.words(data, offsets, texts.NOT_SPACE)
    finally:
        texts.PIECE = old
    got = [(int(k), data[a:z].tobytes()) for a, z, k in zip(s, e, r)]
    assert got == [(k, w) for k, t in enumerate(column) for w in (t or "").encode().split()]
    seen = {}
    for (_, w), x in zip(got, h):
        assert seen.setdefault(w.lower(), x) == x
    assert len(set(seen.values())) == len(seen)


# 1 URL filters

def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(FOLD)
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_url_rules(spark):
    urls = [
        None, "", "nothing", "http://EXAMPLE.org/es/1", "http://a.example.org/en/1", "http://a.example.org/en/2", "x://notexample.org/es/", "http://b.com/fr/?q", "http://b.com/fr", "http://b.com/de/#x",
        "http://org/", "http://org", "https://é.org/a", "http://b.net/fr/", "http://a.b.com?/fr/", "://com/fr/", "http://h://x.com/de/",
    ]
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in urlfilter.judge(pages, queries.RULES).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule = brute_verdict(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule.text), u
        if rule:
            assert got[k].verdict == rule.verdict
    assert urlfilter.judge(pages.limit(0), queries.RULES).count() == 0


def test_trust_and_distrust_flow_along_and_against_links(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="http://{h}/">l</a>' for h in hosts)
    pages = spark.createDataFrame([
        (1, "http://good.org/", link("near.net")), (2, "http://near.net/", link("far.net")), (3, "http://far.net/", None), (4, "http://bad.com/de/1", link("victim.net")),
        (5, "http://fan.net/", link("bad.com")), (6, "http://victim.net/", ""), (7, "http://alone.net/", "<a href='/de/'>"),
    ], "page_id bigint, url string, html string")
    got = {r.host: r for r in urlfilter.judge(pages, queries.RULES).collect()}
    assert got["near.net"].trust > got["far.net"].trust > 0
    assert {h for h, r in got.items() if r.verdict == "block"} == {"bad.com", "fan.net"}
    assert got["victim.net"].distrust == 0
    seeds, links = {"good.org": 1.0}, {"good.org": ["near.net"], "near.net": ["far.net"], "bad.com": ["victim.net"], "fan.net": ["bad.com"]}
    rank = dict.fromkeys({*links, *sum(links.values(), [])}, 0.0) | seeds
    for _ in range(60):
        lost = sum(v for h, v in rank.items() if h not in links)
        rank = {h: seeds.get(h, 0.0) * (0.15 + 0.85 * lost) + 0.85 * sum(rank[s] / len(t) for s, t in links.items() if h in t) for h in rank}
    for h, v in rank.items():
        assert got[h].trust == pytest.approx(v, abs=1e-2)


def test_distrust_of_small_seeds_is_not_cut_short_by_a_hot_host(spark):
    chain = [f"c{k}.net" for k in range(40)]
    seeds = spark.createDataFrame([("hot.com", 1e6), ("b.com", 1.0)], "host string, seed double")
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in itertools.pairwise(["b.com", *chain])], "src string, dst string, weight double")
    got = {r.host: r.score for r in urlfilter.propagate(seeds, edges).collect()}
    for k, h in enumerate(chain, 1):
        assert got[h] == pytest.approx(got["b.com"] * 0.85**k, rel=1e-2)
    link = lambda h: f'<a href="http://{h}/">l</a>'
    rows = spark.range(1500).selectExpr("id AS page_id", "concat('http://hot.com/de/', id) AS url", "'' AS html")
    few = [(-1, "http://b.com/de/1", None), (-2, "http://c.net/", link("b.com")), (-3, "http://d.net/", link("c.net")), (-4, "http://e.net/", link("d.net"))]
    pages = rows.union(spark.createDataFrame(few, "page_id bigint, url string, html string"))
    assert {r.host for r in urlfilter.judge(pages, queries.RULES).filter("page_id < 0 AND verdict = 'block'").collect()} == {"b.com", "c.net", "d.net", "e.net"}


def test_url_query(spark):
    got = {r.page_id: r for r in queries.op1_url_filters(spark, SF).collect()}
    for r in rows_of(spark, "pages"):
        host, path, rule = brute_verdict(r.url)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule and rule.text)


# 2 packing

def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


ODD = ["", "a.", "a..", "A.b, c", "x'll. don't.", "<|endoftext|> <|ENDOFTEXT|> Hi.", "Été. İ. ΣΣ.", "á. é, 12.", "  .\n, \t\x0b.x  y z. \x00 \x00a.", "ẞ. ﬁ, ª. ʰ. ǅ,", "日本。 b, \U0001d400.", "a<|endoftext|>."]


def same_ids(words, own, column):
    ids, bounds = words.encode(*texts.text_bytes(pa.array(column, pa.string())))
    want = [e.ids for e in own.encode_batch_fast(column, add_special_tokens=False)]
    assert [ids[a:z].tolist() for a, z in itertools.pairwise(bounds.tolist())] == want


@pytest.mark.parametrize("places", [1 << 16, 4])
def test_word_ids_are_those_of_whole_texts(places):
    path, own = tokenizer()
    fast = packing.WordIds(path, places)
    assert fast.known
    alphabet = "abcdeXYZ'`sdtm ..,<|>1290 \t\r\n-_éÀßÿ×÷œŒαΣς日本İıǅ\u0338\u0301=\u00a0\x00\x1c\x85ªʰẞﬁ²½٣"

    @settings(max_examples=80, deadline=None)
    @given(st.lists(st.text(alphabet=alphabet, max_size=60), max_size=8), st.sampled_from([3, 40, 1 << 19]))
    def check(column, piece):
        old, texts.PIECE = texts.PIECE, piece
        try:
            same_ids(fast, own, column)
        finally:
            texts.PIECE = old

    check()
    for _ in range(2):
        same_ids(fast, own, ODD)
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 8, 9, 16, 17, 23, 24, 25, 60):
        same_ids(fast, own, ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), n)) for _ in range(200)])
        same_ids(fast, own, ["".join(rng.choice(list("!#$%&()*+,-./:;<=>?@[]^_`{|}~"), n)) for _ in range(100)])


def test_other_tokenizer_files_are_left_to_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = packing.WordIds(path)
    assert not other.known
    same_ids(other, Tokenizer.from_file(path), ["", "A b.", "é  x"])


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12))
def test_plan_places_all_without_gaps(counts):
    runs, total = packing.plan(counts, 40)
    bins = collections.defaultdict(list)
    for n, own in runs.items():
        rank = 0
        for first, k, sequence, offset in own:
            assert first == rank
            rank += k
            for i in range(k):
                bins[sequence + i].append((offset, n))
        assert rank == counts[n]
    assert sorted(bins) == list(range(total))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 40
        assert sum(3 * n > 40 for _, n in own) <= 2
    size = sum(n * k for n, k in counts.items())
    assert total <= max(1, 1.5 * size / 40 + 1) or total <= sum(k for n, k in counts.items() if 2 * n > 40) + 1.5 * size / 40


def test_pack_documents(spark):
    path, own = tokenizer()
    extra = docs(spark, [(None, None), (7, ""), (7, ""), (8, "word " * 3000), (9, "Ünï cödé. " * 900)]).withColumn("offset", F.lit("x"))
    got = packing.pack(extra, path, with_ids=True).collect()
    check_packing(got, extra.collect(), own)
    assert packing.pack(extra.limit(0), path).count() == 0
    small = table(spark, SF, "documents")
    got = queries.op2_best_fit_packing(spark, SF).collect()
    n = check_packing(got, small.collect(), own)
    assert n <= 1.02 * sum(r.length for r in got) / packing.CAPACITY + 1


def check_packing(got, documents, own):
    want = collections.Counter()
    for d in documents:
        ids = np.array([*own.encode(d.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[d.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        if "ids" in r:
            assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    for own_rows in bins.values():
        at = 0
        for offset, n in sorted(own_rows):
            assert offset == at
            at += n
        assert at <= 2048
    return len(bins)


# 3 language ID

def test_language_of_held_out_documents(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").collect()
    want = {r.doc_id: r for r in rows_of(spark, "documents", "/root/testdata/sf0.01")}
    assert len(got) == len(want)
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == want[r.doc_id].lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    train = spark.createDataFrame([(k, t, g, 1) for k, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 4)], "doc_id bigint, text string, lang string, score int")
    model = langid.fit(train)
    ask = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "12 -- ² Ⅷ!", "x", 1), (4, "THE dogs", "x", 1), (None, "les chiens", None, 1), (4, "THE dogs", "x", 1), (6, "the cat " * 50_000, "x", 1)], "doc_id bigint, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(ask, model).collect()]
    assert [x[1] for x in got] == ["und", "und", "und", "en", "fr", "en", "en"]
    assert [x[2] for x in got[:3]] == [0, 0, 0]
    nothing = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(ask, nothing).collect()} == {"und"}
    assert langid.predict(ask.limit(0), model).count() == 0
    kept = langid.accept(train.unionByName(ask))
    assert kept.columns == train.columns
    assert {r.doc_id for r in kept.filter("text is null").collect()} == set()
    assert {r.score for r in kept.collect()} == {1}


def test_backoff_equals_a_plain_loop():
    """Words, then the longest known n-gram from each place on, by a loop over strings and counts."""
    rng = np.random.default_rng(4)
    letters = {"a": "abcdeß", "b": "cdeféü", "c": "œдabf"}
    train = [(g, " ".join("".join(rng.choice(list(x), rng.integers(1, 7))) for _ in range(400))) for g, x in letters.items()]
    counts = collections.Counter((g, w) for g, t in train for w in re.findall(r"[^\W\d_]+", t.lower()))
    model = langid.Model.fit(pa.table({"lang": [g for g, _ in counts], "word": [w for _, w in counts], "n": list(counts.values())}))
    by = {g: collections.Counter({w: n for (x, w), n in counts.items() if x == g}) for g in letters}
    known = {w for w in {w for _, w in counts} if sum(by[g][w] for g in by) >= langid.LEAST_WORD}
    grams = {g: collections.Counter() for g in letters}
    for g in letters:
        for w, n in by[g].items():
            for size in range(1, langid.LONGEST + 1):
                for i in range(len(w) + 3 - size):
                    grams[g][f" {w} "[i:i + size]] += n
    seen = {x for g in grams for x in grams[g] if sum(grams[h][x] for h in grams) >= (1 if len(x) == 1 else langid.LEAST_GRAM)}

    @functools.cache
    def below(kind, g, size):
        table, names = {"word": (by, known), "gram": (grams, seen)}[kind]
        return sum(n for y, n in table[g].items() if size in (None, len(y))) + 0.5 * sum(size in (None, len(y)) for y in names)

    def log(kind, x, g, size=None):
        return np.log(({"word": by, "gram": grams}[kind][g][x] + 0.5) / below(kind, g, size))

    def plain(word, g):
        if word in known:
            return log("word", word, g)
        said, at, found = f" {word} ", 0, []
        while at < len(said) - 1:
            size = next((n for n in range(langid.LONGEST, 0, -1) if at + n <= len(said) and said[at:at + n] in seen), 0)
            found.append(log("gram", said[at:at + size], g, size) if size else -12.0)
            at += max(1, size - 1)
        return 1.5 * sum(found) / len(found)

    ask = ["", None, "12 -- ² Ⅷ!", "ab ÉÜ, cab/ßa 3x", "a" * 40 + " œа", "qqq abcde. Éfc\tdд\u0301 ª", "zz"] + [" ".join("".join(rng.choice(list("abcdefßéüœдzQÉ'.2 ×"), rng.integers(1, 30))) for _ in range(30)) for _ in range(40)]
    for piece in (1 << 19, 20):
        old, texts.PIECE = texts.PIECE, piece
        try:
            got = langid.Predictor(model)(pa.array(ask, pa.string()))
        finally:
            texts.PIECE = old
        for text, (lang, score) in zip(ask, got):
            own = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(map(str.isalpha, w))]
            if not own:
                assert (lang, score) == ("und", 0.0)
                continue
            logs = np.array([sum(plain(w, g) for w in own) for g in sorted(letters)]) * min(len(own), langid.EVIDENCE) / len(own)
            assert lang == sorted(letters)[int(np.argmax(np.round(logs, 9)))]
            assert score == pytest.approx(1 / np.exp(logs - logs.max()).sum())


# 4 line dedup

def brute_lines(rows, least, bytes_):
    sites, owner = collections.defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            if len(line.encode()) >= bytes_:
                sites[line].add(site or "")
                owner[line] = min(x for x in (owner.get(line), i) if x is not None) if i is not None or line in owner and owner[line] is not None else None
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None))
            continue
        seen, left = set(), []
        for line in text.split("\n"):
            if len(line.encode()) >= bytes_ and len(sites[line]) >= least and not (owner[line] == i and line not in seen):
                continue
            seen.add(line)
            left.append(line)
        out.append((i, "\n".join(left)))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup(spark, limit, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", limit)
    a, b = "a boilerplate line, that is", "another line of many sites"
    rows = [(5, f"{a}\nown\n\n{a}", "s1"), (2, f"x\n{a}\n{a}\n{b}", "s2"), (9, f"{a}\n{b}\nend", "s3"), (9, f"{a}\n{b}\nend", "s3"), (4, None, "s4"), (6, "", "s5"), (7, f"{b}", None), (None, f"{a}\nz", "s1"), (8, "é" * 70_000 + f"\n{a}", "s1")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id bigint, text string, source string, line int, owner string").withColumns({c: F.lit(1) for c in ("_id", "_hash", "_found", "_own", "c0")})
    got = linededup.remove_boilerplate(df, "source", min_sites=3, counts=True)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(brute_lines(rows, 3, 16), key=key)
    assert {(r.line, r.owner) for r in got.collect()} == {(1, "q")}
    emptied = linededup.remove_boilerplate(df, "source", min_sites=3, drop_emptied=True)
    assert emptied.filter("doc_id = 7").count() == 0 and emptied.filter("doc_id = 6").count() == 1
    assert linededup.remove_boilerplate(df.limit(0), "source").count() == 0


# 5 WARC

def test_warc_query(spark):
    pages = [(r.page_id, r.html or "") for r in rows_of(spark, "pages")]
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h, i)
    want = {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in pages}
    got = queries.op5_warc(spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(want)


def test_warc_edges(spark):
    inner = b"".join(warc.record(f"urn:inner:{k}", "http://i/", b"inner%d" % k, None) for k in range(3))
    html = ["", None, "x", "x", "x", inner.decode("latin-1"), "y" * 3_000_000]
    pages = spark.createDataFrame([(k if k != 4 else None, None if k == 2 else f"http://a/\r\n{k}", h, 1) for k, h in enumerate(html)], "page_id bigint, url string, html string, first_id int")
    manifest = warc.write_archives(pages.repartition(3), work_path(spark, "warc"))
    small = {r.record_id: r for r in warc.read_archives(spark, manifest, range_bytes=701).collect()}
    assert len(small) == len(html)
    assert {k: r.record_type for k, r in small.items()} == {"urn:page:0": "response", "urn:page:1": "revisit", "urn:page:2": "response", "urn:page:3": "revisit", "urn:page:": "revisit", "urn:page:5": "response", "urn:page:6": "response"}
    assert bytes(small["urn:page:5"].payload) == html[5].encode() and small["urn:page:2"].target_uri is None
    assert small["urn:page:1"].payload_bytes == 0 and small["urn:page:3"].refers_to == "urn:page:2"
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), work_path(spark, "warc"))).count() == 0


def test_members_inside_a_payload_are_passed_over(spark, tmp_path):
    inner = b"".join(warc.record(f"urn:inner:{k}", "http://i/", b"inner%d" % k, None) for k in range(3))

    def stored(name, payload):  # so that the inner magic stands in the file
        pack = zlib.compressobj(0, zlib.DEFLATED, 31)
        head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%s>\r\nContent-Length: %d\r\n\r\n" % (name, len(payload))
        return pack.compress(head + payload + b"\r\n\r\n") + pack.flush()

    raw = stored(b"outer", inner) + warc.record("urn:mid", None, b"z", None) + stored(b"twice", stored(b"again", inner) + inner) + warc.record("urn:last", None, b"z", None)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    manifest = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(raw))], "path string, bytes bigint")
    for step in (7, 50, 300, 10**6):
        found = warc.read_archives(spark, manifest, step).orderBy("offset").collect()
        assert [r.record_id for r in found] == ["urn:outer", "urn:mid", "urn:twice", "urn:last"]
        assert warc.passed_over(spark, manifest, step).agg(F.sum("records"), F.sum("skipped")).first() == (4, 0)


def test_damage_costs_no_valid_record(spark, tmp_path):
    own = [warc.record(f"urn:{k}", f"http://a/{k}", b"payload %d " % k * 20, None) for k in range(10)]
    bad = own[6][:60] + bytes([own[6][60] ^ 255]) + own[6][61:]
    files = {
        "middle": (b"".join(own[:6]) + bad + b"".join(own[7:]), {*range(10)} - {6}, len(bad)), "cut": (b"".join(own)[:-5], {*range(9)}, len(own[9]) - 5), "zeros": (b"".join(own) + bytes(20), {*range(10)}, 20),
        "start": (b"junk" + warc.MAGIC + b"".join(own), {*range(10)}, 7), "none": (bytes(100), set(), 100), "other": (b"".join(own[:2]) + zlib.compress(b"x" * 99, wbits=31) + own[2], {0, 1, 2}, len(zlib.compress(b"x" * 99, wbits=31))),
    }
    for name, (raw, _, _) in files.items():
        (tmp_path / name).write_bytes(raw)
    manifest = spark.createDataFrame([(str(tmp_path / name), len(raw)) for name, (raw, _, _) in files.items()], "path string, bytes bigint")
    for step in (7, 50, 300, 4 << 20):
        got = collections.defaultdict(set)
        rows = warc.read_archives(spark, manifest, step).collect()
        for r in rows:
            got[r.path.rpartition("/")[2]].add(int(r.record_id[4:]))
        assert got == {name: ids for name, (_, ids, _) in files.items() if ids} and len(rows) == sum(len(ids) for _, ids, _ in files.values())
        skipped = {r.path.rpartition("/")[2]: r.n for r in warc.passed_over(spark, manifest, step).groupBy("path").agg(F.sum("skipped").alias("n")).collect()}
        assert skipped == {name: n for name, (_, _, n) in files.items()}


# 6 quality

def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_quality_classifier(spark, sf).collect()}
    assert len(got) == 1000
    labels = rows_of(spark, "labels", sf)
    right = [got[r.doc_id].kept == bool(r.quality) for r in labels]
    assert np.mean(right) > 0.95
    assert all(0 <= r.p_quality <= 1 for r in got.values())


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [(k, "some words of text here", "big" if k < 200 else f"small{k}", "p") for k in range(210)]
    d = spark.createDataFrame([*rows, (None, None, None, None), (300, "", "big", "p")], "doc_id bigint, text string, host string, path string")
    labels = spark.createDataFrame([(k, int(k % 10 != 0)) for k in range(200)] + [(205, 0), (205, 0), (None, 1), (206, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.judge(d, labels, "host", "path").collect()}
    assert len(got) == 212
    assert 0.5 < got[205].p_path < got[207].p_path and abs(got[207].p_path - got[1].p_path) < 0.1
    assert quality.judge(d.limit(0), labels, "host", "path").count() == 0
    assert quality.judge(d, labels.limit(0), "host", "path").count() == 212


def test_quality_against_plain_loops(spark):
    """Rates, and what moves a document, by loops over all rows; columns with the names of helper columns do no harm."""
    text = lambda k: None if k % 17 == 0 else "" if k % 19 == 0 else "Plain words, and more of them. " * (k % 7 + 1) if k % 3 else "BUY!!! $$$ | NOW | " * (k % 5 + 1)
    rows = [(k, text(k), None if k % 31 == 0 else f"h{min(k % 9, 4)}", f"p{k % 4}", k, float(k), "x", 0.5) for k in range(240)]
    rows += [rows[3], rows[3], (None, "Some text.", "h1", "p1", 0, 0.0, "y", 0.1), (999, "Alone here.", "only", "one", 0, 0.0, "y", 0.1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string, n bigint, w double, label string, p_others double")
    marks = [(k, int(k % 3 != 0)) for k in range(0, 240, 2)] + [(4, 0), (None, 1), (7, None)]
    got = quality.judge(d, spark.createDataFrame(marks, "doc_id bigint, quality int"), "host", "path").collect()
    assert len(got) == len(rows)
    own = collections.defaultdict(list)
    for k, q in marks:
        if k is not None and q is not None:
            own[k].append(q)
    seen = []
    for r in got:
        label = float(np.mean(own[r.doc_id])) if r.doc_id in own else None
        seen.append((r, 1.0, label) if label is not None else (r, quality.UNLABELLED, quality.UNLABELLED * r.p_document))
    total = lambda keep: (sum(w for r, w, _ in seen if keep(r)), sum(e for r, _, e in seen if keep(r)))
    n, a = total(lambda r: True)
    rate = (a + 0.5) / (n + 1)

    def strength(groups):
        n, k = sum(g[0] for g in groups), len(groups)
        noise = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
        excess = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) / n - noise * k / n
        return min(1e6, max(1.0, noise / excess - 1)) if excess > 1e-12 else 1e6

    hosts = {h: total(lambda r, h=h: r.host == h) for h in {r.host for r in got}}
    kh = strength([(*v, rate) for v in hosts.values()])
    p_host = {h: (a + kh * rate) / (n + kh) for h, (n, a) in hosts.items()}
    sites = {s: total(lambda r, s=s: (r.host, r.path) == s) for s in {(r.host, r.path) for r in got}}
    kp = strength([(*v, p_host[s[0]]) for s, v in sites.items()])
    logit = lambda p: np.log(max(1e-6, p) / max(1e-6, 1 - p))
    for r, w, e in seen:
        (hn, ha), (sn, sa) = hosts[r.host], sites[r.host, r.path]
        assert abs(r.p_host - p_host[r.host]) < 1e-9
        assert abs(r.p_path - (sa + kp * p_host[r.host]) / (sn + kp)) < 1e-9
        others = (sa - e + kp * (ha - e + kh * rate) / (hn - w + kh)) / (sn - w + kp)
        assert abs(r.p_others - others) < 1e-9
        want = 1 / (1 + np.exp(-(logit(r.p_document) + logit(others) - logit(rate))))
        assert abs(r.p_quality - want) < 1e-9 and (r.kept == (r.p_quality >= quality.THRESHOLD))
    alone = next(r for r in got if r.doc_id == 999)
    assert abs(alone.p_others - rate) < 1e-9


def test_own_label_does_not_judge_its_document(spark):
    """Two documents alike in text and site, whose labels differ, are judged by each other's label."""
    d = spark.createDataFrame([(k, "Same words of text.", "a" if k < 2 else f"h{k}", "p") for k in range(60)], "doc_id bigint, text string, host string, path string")
    labels = spark.createDataFrame([(0, 1), (1, 0)] + [(k, k % 2) for k in range(2, 60)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.judge(d, labels, "host", "path").collect()}
    assert got[0].p_path == got[1].p_path and got[0].p_others < got[1].p_others and got[0].p_quality < got[1].p_quality


# 7 PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@0123-+ ()é%", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_pii_query(spark):
    got = {r.doc_id: r for r in queries.op7_pii(spark, "/root/testdata/sf0.01").collect()}
    for r in rows_of(spark, "documents", "/root/testdata/sf0.01"):
        want = brute_spans(r.text or "")
        said = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        row = got[r.doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(x[0] == k for x in want) for k in pii.KINDS)
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.spans == said or row.spans.startswith(said)
        if not want:
            assert row.spans == ""


def test_terms_that_reveal_an_entity(spark):
    rows = [(k, f"Filler{chr(97 + k)} words then Zanzibar writes from jo@x.com about something else number {k}") for k in range(5)]
    rows += [(10 + k, f"about many other matters of the day, part {k}") for k in range(30)]
    rows += [(50, None), (51, ""), (0, rows[0][1]), (52, "nothing about " * 20_000 + "jo@x.com")]
    found = {}
    for r in pii.find(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, r.spans)
    text = dict(rows)[1]
    terms = {text[s.start:s.end] for s in found[1] if s.kind == "term"}
    assert "Zanzibar" in terms and "about" not in terms
    assert found[50] == [] and found[10] == []
    clash = docs(spark, rows).withColumns({c: F.lit(1) for c in ("_id", "_hash", "_spans", "c0", "spans", "terms", "text_hash")})
    clean = {r.doc_id: r.text for r in pii.sanitise(clash).collect()}
    assert pii.sanitise(clash).columns == clash.columns
    assert "Zanzibar" not in clean[1] and "[EMAIL]" in clean[1] and clean[50] is None and clean[10] == dict(rows)[10]
    assert pii.find(docs(spark, rows).limit(0)).count() == 0


def test_copies_of_one_text_are_one_witness(spark):
    rows = [(k, f"Zanzibar{'!' * k} writes from jo@x.com, letter {k}") for k in range(3)]
    rows += [(10 + k, f"about many other matters, part {k}") for k in range(60)]
    shares = []
    for copies in (0, 300):
        table_ = docs(spark, rows + [(1000 + k, rows[0][1]) for k in range(copies)])
        shown = pii.disclosing(pii._found(table_), table_, disclosure=0.0)
        shares.append({r.term: r.disclosed for r in shown.distinct().collect()})
    assert shares[0]["zanzibar"] > pii.DISCLOSURE and shares[0] == pytest.approx(shares[1])


def test_rare_entities_and_all_places_of_their_terms(spark):
    filler = " ".join(["matters"] * 40)
    rows = [(1, f"Wu of Zanzibar wrote from jo@x.com. {filler} Later Zanzibar, and Wu, were silent"), (2, f"{filler} jo@x.com {filler} zanzibar"), (3, "Zanzibar jo@x.com")]
    rows += [(10 + k, f"Of the many matters that were wrote from, part {'i' * k}") for k in range(5000)]
    found = {r.doc_id: r.spans for r in pii.find(docs(spark, rows)).collect()}
    said = {k: [text[s.start:s.end] for s in found[k] if s.kind == "term"] for k, text in rows[:3]}
    assert said == {1: ["Wu", "Zanzibar", "Zanzibar", "Wu"], 2: ["zanzibar"], 3: ["Zanzibar"]}
    assert len(found) == len(rows) and not any(found[k] for k, _ in rows[3:])


# 8 decontamination

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_hits(text, items, window):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        i = words(t)
        m = min(window, len(i))
        grams = {tuple(i[p:p + m]) for p in range(len(i) - m + 1)} if m else set()
        for p in range(len(w) - m + 1):
            if tuple(w[p:p + m]) in grams:
                hit.update(range(p, p + m))
                names.add(str(name))
    return len(w), len(hit), names


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=24), min_size=1, max_size=5), st.lists(st.text(alphabet="abAB. ", max_size=60), max_size=5), st.integers(1, 5))
def test_automaton(items, column, window):
    named = [(str(k), t) for k, t in enumerate(items)]
    auto = decontam.Automaton(named, window)
    for text, (n, hits, found, *_) in zip(column, decontam.scan(pa.array(column, pa.string()), auto)):
        assert (n, sum(z - a for a, z in hits), {auto.names[x] for x in found}) == brute_hits(text, named, window)


@pytest.mark.parametrize(("block", "part", "broadcast"), [(512 << 10, 8192, 10), (60, 8192, 10), (60, 11, 0), (512 << 10, 10, 0)])
def test_decontamination(spark, block, part, broadcast, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "PART_WORDS", part)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, ""), (5, "..."), (2, "short item"), (10, "é ü")]
    rows = [(1, None), (2, ""), (3, "x ONE two three, four five six seven eight nine ten y"), (4, "a Short ITEM and é ü"), (4, "a Short ITEM and é ü"), (5, "one two three four five six seven eight nine"), (None, "short item"), (6, "pad " * 30_000 + "é ü")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(sorted(r.item_ids))) for r in decontam.contamination(docs(spark, rows), bench).collect()}
    assert got == {(i, a, b, tuple(sorted(c))) for i, t in rows for a, b, c in [brute_hits(t, items, 10)]}
    clash = docs(spark, rows).withColumns({c: F.lit(7) for c in ("_id", "_hash", "_hits", "_items", "_words", "_longest", "0", "c1")})
    kept = decontam.remove_contamination(clash, bench, max_coverage=0.95)
    cut = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == clash.columns and {tuple(r[5:]) for r in kept.collect()} == {(7,) * 8}
    assert cut[3] == "x y" and cut[4] == "a and " and cut[1] is None and cut[5] == dict(rows)[5] and None not in cut
    assert decontam.contamination(docs(spark, rows).limit(0), bench).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs(spark, rows), bench.limit(0)).collect()} == {0}


# 9 media

@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 3), (4, 6, 3), (9, 8)])
def test_images_round_trip(shape):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_netpbm(x)) == x).all()
    back = media.decode(media.encode_bmp(x))
    assert (back == x).all()


def test_plain_and_bit_netpbm():
    assert media.decode(b"P2 # grey\n2 2\n255\n0 1\n2 255").tolist() == [[0, 1], [2, 255]]
    assert media.decode(b"P1\n2 2\n10\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]


def test_area_resize_equals_brute_force():
    x = np.random.default_rng(2).integers(0, 256, (7, 10)).astype(np.uint8)
    fine = np.kron(x, np.ones((4 * 8, 9))).astype(float)  # both sides divide
    want = fine.reshape(8, 28, 9, 10).mean(axis=(1, 3))
    assert np.allclose(media.resize(x, 8, 9), want)
    assert media.resize(np.zeros((0, 3), np.uint8), 2, 2).tolist() == [[0, 0], [0, 0]]


def test_media_query(spark):
    got = {r.doc_id: r for r in queries.op9_media_columns(spark, SF).collect()}
    for r in rows_of(spark, "documents"):
        raw = (r.text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        row = got[r.doc_id]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert row.media_bytes == row.payload_bytes + len(f"P5\n64 {len(padded) // 64}\n255\n")


def test_stored_tiles_and_features_equal_brute_force(spark):
    rows = [(k, "".join(map(chr, np.random.default_rng(k).integers(32, 500, 150 * k)))) for k in range(8)] + [(8, None), (9, "same"), (10, "same")]
    got = {r.doc_id: r for r in media.stored_media(docs(spark, rows)).collect()}
    assert got[9][1:] == got[10][1:]
    for i, text in rows:
        raw = (text or "").encode()
        x = np.frombuffer(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), np.uint8).reshape(-1, 64).astype(float)
        means = lambda a, b: np.kron(x, np.ones((a, b))).reshape(a, x.shape[0], b, 64).mean(axis=(1, 3))  # noqa: E731, B023
        small = np.round(means(8, 9), 6)
        assert got[i].feature == f"{int(''.join(str(int(small[r, c + 1] > small[r, c])) for r in range(8) for c in range(8)), 2):016x}"
        out = io.BytesIO()
        np.save(out, np.ascontiguousarray(np.rint(np.round(means(32, 32), 6)), dtype=np.uint8))
        assert (got[i].tile_bytes, got[i].tile_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())


def test_media_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 5_000_000), (3, "x" * 5_000_000), (None, "é")]
    clash = docs(spark, rows).withColumn("media", F.lit(1)).withColumn("tile", F.lit("t"))
    got = media.stored_media(clash).collect()
    assert len(got) == 5 and len({r.media_sha256 for r in got if r.n_bytes == 0}) == 1
    assert media.stored_media(docs(spark, [])).count() == 0
    bmp = media.encode_bmp(np.full((4, 4), 200, np.uint8))
    short = bmp[:10] + (54 + 4 * 10).to_bytes(4, "little") + bmp[14:54 + 4 * 10] + bmp[-16:]
    bad = [b"junk", None, b"P5\n9", short, b"P2\n1 1\n255\n" + b"9" * 40, b"P5\n" + b"9" * 30 + b" 2\n255\nx", b"P5\n-1 2\n255\nxxxx", b"BM", bmp[:60], b"P2\n1 1\n255\nx", b"P6\n1 1\n"]
    images = spark.createDataFrame([(1, bytearray(bmp), 5), *((k, x and bytearray(x), 5) for k, x in enumerate(bad, 2))], "i bigint, c binary, width int")
    got = {r.i: r for r in media.media_columns(images, "i", "c").collect()}
    assert got[1].width == 4 and got[1].tile[:6] == b"\x93NUMPY" and len(got) == len(bad) + 1
    assert {(got[k].width, got[k].tile, got[k].feature) for k in got if k > 1} == {(None, None, None)}


# 10 near-duplicates

def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def test_near_duplicates_of_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in rows_of(spark, "documents", "/root/testdata/sf0.01")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op10_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect())
    assert got == sorted(brute_components(rows, 2, 80))


@pytest.mark.parametrize("sizes", [(32, 512), (4, 8)])
def test_a_family_of_near_copies(spark, sizes, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", sizes[0])
    monkeypatch.setattr(neardup, "BLOCK", sizes[1])
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 400, 120)]
    rows = []
    for k in range(150):
        w = list(base)
        for p in rng.integers(0, len(w), rng.integers(0, 14)):
            w[p] = f"x{rng.integers(0, 10**6)}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, " ".join(f"y{x}" for x in rng.integers(0, 9, 6))) for k in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "One"), (3004, "one"), (3005, "one two"), (None, "ONE two"), (3005, "one two"), (3006, "z " * 300_000)]
    got = neardup.near_duplicates(docs(spark, rows).withColumnRenamed("source", "node"), 2, 0.8).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows, 2, 80), key=key)
    kept = neardup.deduplicate(docs(spark, rows), 2, 0.8).collect()
    want = {(c if n else i) for i, n, c in brute_components(rows, 2, 80)}
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)
    assert neardup.near_duplicates(docs(spark, []), 2).count() == 0


def band_of(spark, counts, n_words=60):
    """Sets of a band that is not similar enough to be linked, in components of these sizes."""
    rng = np.random.default_rng(8)
    rows = [(k, comp, np.unique(rng.integers(0, 2**64, n_words, dtype=np.uint64))) for comp, k in enumerate(range(sum(counts)))]
    comps = np.repeat(np.arange(len(counts)), counts)
    key = 77
    members = spark.createDataFrame([(key, k, len(x)) for k, _, x in rows], "key bigint, node bigint, size bigint")
    labels = spark.createDataFrame([(k, -1 - int(c)) for (k, _, _), c in zip(rows, comps)], "node bigint, comp bigint")
    keys = np.zeros(neardup.BANDS, dtype=np.uint64)
    keys[0] = key
    sets = spark.createDataFrame([(k, bytearray(x.tobytes()), bytearray(neardup.sketch(x).tobytes()), bytearray(keys.tobytes())) for k, _, x in rows], "node bigint, items binary, sketch binary, keys binary")
    return members, labels, sets


def test_one_member_in_another_component_does_not_multiply_a_large_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    for n in (100, 400, 1600):
        members, labels, sets = band_of(spark, [n, 1])
        cells = neardup.cells_of(neardup.mixed_of(members, labels))
        assert cells.count() == n + 1 + -(-n // 16)  # once each, and the one with itself and for every block of the others
        assert neardup._rest(members, labels, sets, 80).count() == 0
    monkeypatch.setattr(neardup, "BLOCK", 512)
    monkeypatch.setattr(neardup, "CELL_BYTES", 16 * 60 * 8)
    members, labels, sets = band_of(spark, [100, 1])
    assert neardup.cells_of(neardup.mixed_of(members, labels)).count() == 100 + 1 + 7


def test_one_of_repeated_rows_stays_whatever_their_order(spark):
    rows = [(1, "a b c d e f g", 2), (1, "a b c d e f g", 1), (1, "", 5), (2, "a b c d e f g", 0), (3, None, 4), (3, None, 4)]
    for order in (rows, rows[::-1]):
        clash = spark.createDataFrame(order, "doc_id bigint, text string, _gone_id int").withColumn("_again_id", F.lit("x")).withColumn("_gone_hash", F.lit(0))
        kept = neardup.deduplicate(clash)
        assert kept.columns == clash.columns
        assert sorted((r[0], r[1] or "", r[2]) for r in kept.collect()) == [(1, "", 5), (1, "a b c d e f g", 1), (3, "", 4), (3, "", 4)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketch_estimates_the_similarity():
    rng = np.random.default_rng(3)
    for n, share in ((4000, 0.5), (4000, 0.8), (30000, 0.9)):
        both = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 2**64, n - len(both), dtype=np.uint64)]))
        j = len(np.intersect1d(a, both)) / len(a)
        x, y = neardup.sketch(a), neardup.sketch(np.unique(both))
        assert abs((x == y).mean() - j) < 0.12 and neardup.possible(x, y, j) and not neardup.possible(x, y, min(1.0, j + 0.4))


# SQL and pipeline

def test_oracles(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.sql(sql)
        columns = want.columns
        got = queries.QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline(spark):
    source = rows_of(spark, "documents")
    seen, df = [source], table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        path = work_path(spark, "test")
        stage(spark, df, SF).write.parquet(path)
        df = spark.read.parquet(path)
        seen.append(df.collect())
    columns = table(spark, SF, "documents").columns
    assert [tuple(r.asDict()) for r in (x[0] for x in seen[:-1])] == [tuple(columns)] * 5
    letters = lambda t: any(map(str.isalpha, t or ""))
    assert sum(letters(r.text) for r in source) * 0.99 <= len(seen[1]) <= sum(letters(r.text) for r in source)
    want = {i: t for i, t in brute_lines([(r.doc_id, r.text, r.source) for r in seen[1]], linededup.MIN_SITES, linededup.MIN_BYTES)}
    before = {r.doc_id: r.text for r in seen[1]}
    want = {i: t for i, t in want.items() if t == before[i] or t.replace("\n", "")}
    assert {r.doc_id: r.text for r in seen[2]} == want
    groups = brute_components([(r.doc_id, r.text) for r in seen[2]], 5, 80)
    assert {r.doc_id for r in seen[3]} == {c if n else i for i, n, c in groups}
    items = [(r.item_id, r.text) for r in rows_of(spark, "benchmark")]
    after = {r.doc_id: r.text for r in seen[4]}
    for r in seen[3]:
        n, hit, _ = brute_hits(r.text, items, 10)
        if not hit:
            assert after[r.doc_id] == r.text
        elif r.doc_id in after:
            assert len(words(after[r.doc_id])) in (n - hit, n - hit + 1)
        else:
            assert hit > n / 2 or hit > 200
    check_packing(seen[5], seen[4], tokenizer()[1])
    whole = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in seen[5])
