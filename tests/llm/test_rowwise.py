"""Packing, classifiers, rules, filters, extraction and scoring on small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, corpus, lower, plain_words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import brown, decontam, html, packing, quality, queries, rules, urls
from sparkloom.llm.common import fold

DIR = "/root/testdata/sf0.001"


def crc(x):
    return zlib.crc32(("" if x is None else str(x)).encode())


# -- packing ---------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=80))
def test_plan_is_tight(lengths):
    """Never more bins than first-fit decreasing plus one, and no fewer than the tokens need."""
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= n), None)
        if at is None:
            bins.append(32 - n)
        else:
            bins[at] -= n
    got = sum(t for t, _ in packing.plan_bins(np.bincount(lengths, minlength=33), 32))
    assert -(-sum(lengths) // 32) <= got <= len(bins) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=80))
def test_plan_places_every_piece(lengths):
    counts = np.bincount(lengths, minlength=33)
    plan = packing.plan_bins(counts, 32)
    used = Counter()
    for times, combo in plan:
        assert sum(n * t for n, t in combo) <= 32
        for n, t in combo:
            used[n] += times * t
    assert used == Counter(lengths)
    assert sum(t for t, _ in plan) <= max(1, 2 * -(-sum(lengths) // 32))


def test_packing_round_trip(spark):
    rows = corpus(8) + [(3, "same id", "", 0, ""), (None, "no id", "", 0, ""), (None, None, "", 0, "")]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), queries.public_encoder, capacity=64, end_id=2)
    got = pieces.collect()
    encode = queries.public_encoder()
    want = Counter()
    for d, t, *_ in rows:
        ids = [*encode([t or ""])[0].tolist(), 2]
        head = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    whole = {}
    for s, parts in by.items():
        at = 0
        for o, n, _ in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
        whole[s] = b"".join(x for _, _, x in sorted(parts))
    assert {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces).collect()} == whole
    assert packing.pack(spark.createDataFrame([], SCHEMA), queries.public_encoder).count() == 0
    named = spark.createDataFrame([("a", "x " * 3000, 1), ("b", None, 2), (None, "y", 3)], "doc_id string, text string, length long")
    assert sorted((r.doc_id or "", r.piece) for r in packing.pack(named, queries.public_encoder).collect()) == [("", 0), ("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_encoders_agree(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|> a", "a\u00a0b\u2003c", "  x\t\t\n\n y  ", "don't I'LL 12 345", "日本語 \U0001f600", "\x00\x1f", "ÀÉß 'S ¿qué?"]
    for t, ids in zip(texts, queries.public_encoder()(texts), strict=True):
        assert ids.tolist() == slow.encode(t, add_special_tokens=False).ids


# -- quality ---------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=5), st.integers(0, 99))
def test_forward_backward_is_exact(lengths, seed):
    r = np.random.default_rng(seed)
    lengths = np.array(lengths)
    unary, trans = r.normal(size=lengths.sum()), r.normal(size=(2, 2))
    marginal, pairs, log_z = quality.forward_backward(unary, trans, lengths)
    at, total_z, want_pairs = 0, 0.0, np.zeros((2, 2))
    for n in lengths:
        z, ones, p = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            weight = math.exp(sum(unary[at + i] for i in range(n) if y[i]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += weight
            ones += weight * np.array(y)
            for a, b in zip(y, y[1:]):
                p[a, b] += weight
        assert np.allclose(marginal[at : at + n], ones / z)
        want_pairs, total_z, at = want_pairs + p / z, total_z + math.log(z), at + n
    assert np.allclose(pairs.sum(axis=0), want_pairs) and np.isclose(log_z.sum(), total_z)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, d).collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame(corpus(9), SCHEMA)
    nothing = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert quality.score(named, quality.fit(named, named.select("doc_id", (F.length("text") % 2).alias("quality")))).schema["doc_id"].dataType.simpleString() == "string"
    model = quality.fit(docs, nothing)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    some = spark.createDataFrame([(r[0], int(i % 3 > 0)) for i, r in enumerate(corpus(9))], "doc_id long, quality int")
    model = quality.fit(docs, some)
    scores = quality.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count() and quality.score(docs.limit(0), model).count() == 0


# -- rules -----------------------------------------------------------------


def test_statistics(spark):
    rows = [*corpus(10), (999, "a b c a b c\n a b\n\n a b\n#$ x|y", "", 0, ""), (998, "\x0b\x0c x", "", 0, "")]
    got = {r.doc_id: r for r in rules.statistics(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, t, *_ in rows:
        t = t or ""
        w = plain_words(t)
        c = Counter(zip(w, w[1:], w[2:]))
        rep = np.zeros(len(w), dtype=bool)
        for j in range(len(w) - 2):
            if c[tuple(w[j : j + 3])] > 1:
                rep[j : j + 3] = True
        lines = [x for x in t.split("\n") if plain_words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), int(rep.sum()))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:60]


def test_rules_learn_a_threshold(spark):
    r = np.random.default_rng(0)
    x = {"a": r.random(900), "b": r.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5)
    learned = rules.learn(x, bad)
    hit = np.any([rules._covers(rule, x, 900) for rule in learned], axis=0)
    assert (hit == bad).mean() > 0.97
    docs = spark.createDataFrame(corpus(11), SCHEMA)
    assert rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    out = rules.score(docs, []).collect()
    assert all(r.kept == (not r.base_failed) for r in out) and len(out) == docs.count()


# -- URL filters -----------------------------------------------------------


def test_urls(spark):
    table = spark.createDataFrame(
        [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("dup.org", "/", "allow"), ("dup.org", "/", "block"), (None, "/", "block")], "host string, path string, verdict string"
    )
    cases = [
        ("http://a.EXAMPLE.com/en/77?x", "a.example.com", "/en/77", "example.com/en/7", "allow"), ("http://a.com/en/", "a.com", "/en/", "com/en/", "block"),
        ("ftp://com/en/x#y", "com", "/en/x", "com/en/", "block"), ("http://telecom/en/", "telecom", "/en/", None, "allow"), ("x://dup.org/", "dup.org", "/", "dup.org/", "block"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"), ("http://a.com", "a.com", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i % 3 or None, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = Counter(tuple(r) for r in urls.judge(pages, table).collect())
    assert got == Counter((i % 3 or None, *c[1:]) for i, c in enumerate(cases))
    assert urls.judge(pages.limit(0), table).count() == 0
    assert {r.verdict for r in urls.judge(pages, table.limit(0)).collect()} == {"allow"}


def test_bloom_never_misses(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    row, n = urls.bloom(keys, "key", 2000)
    probe = spark.range(6000).select("id", F.concat(F.lit("k"), "id").alias("key")).withColumn("blocks", row.scalar())
    hit = {r.id for r in probe.filter(urls.may_hold(F.col("blocks"), n, F.col("key"))).select("id").collect()}
    assert set(range(2000)) <= hit and len(hit) < 2400


# -- decontamination -------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    rows = corpus(12, 40)
    items = [(f"i{j}", " ".join(plain_words(rows[j * 2][1])[5:40]).upper()) for j in range(12)] + [("s", "changed"), ("n", None), ("e", "!!"), ("i0", "word1 word2")]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        for j in range(max(1, len(w) - 9) if w else 0):
            patterns[tuple(w[j : j + 10])].add(i)
    clean = 0
    got = {r.doc_id: r for r in decontam.scan(docs, bench, window=10, block_bytes=block_bytes).collect()}
    for d, t, *_ in rows:
        w = word.findall(lower(t or ""))
        hit, found = np.zeros(len(w), dtype=bool), set()
        for p, owners in patterns.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit[j : j + len(p)] = True
                    found |= owners
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.item_ids) == (len(w), int(hit.sum()), len(found), sorted(found))
        clean += not found
    assert decontam.drop_contaminated(docs, bench, block_bytes=block_bytes).count() == clean
    assert decontam.scan(docs, bench.limit(0)).filter("n_hit > 0").count() == 0 and decontam.scan(docs.limit(0), bench).count() == 0


# -- HTML ------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("a  b\n c", "a b c"), ("<p>One <b>two</b><p>three", "One two\n\nthree"), ("<ul><li>a<li>b<ol start=3><li>x</ol></ul>", "- a\n- b\n  3. x"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>t", "aa  b\nc   dddd\n\nt"), ("<script>var t='</p>';</script><style>p{}</style>x", "x"),
        ("<div hidden>a</div><div style='display: none'>b</div><i aria-hidden=true>c</i>d", "d"), ("<pre>a\n  b</pre>", "a\n  b"), ("1 &lt; 2 &amp;&nbsp;3", "1 < 2 &\xa03"),
        ("<title>x</title>y", "y"), ("a<br>b<!-- c --><hr>d", "a\nb\n\nd"), ("</p></b></td>a<", "a<"), ("<p>a</div>b</p>", "ab"),
    ],
)
def test_html(page, want):
    assert html.page_text(page) == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/ab td=pulir\"'!-&;\n", max_size=80))
def test_html_never_fails(page):
    html.page_text(page)


def test_html_deep_and_frame(spark):
    assert html.page_text("<div>" * 50000 + "x") == "x"
    pages = spark.createDataFrame([(1, "<p>a", "u"), (None, None, None)], "page_id long, html string, text string")
    assert sorted((r.text for r in html.extract(pages).collect())) == ["", "a"]


# -- language model --------------------------------------------------------


def test_exchange_finds_two_groups():
    b = np.zeros((7, 7))
    b[np.ix_([0, 2, 4], [1, 3, 5])] = 10  # evens are followed by odds
    b[np.ix_([1, 3, 5], [0, 2, 4])] = 10
    got = brown.exchange(b, np.array([0, 0, 0, 1, 1, 1, 2]), np.array([True] * 6 + [False]), 3, free=2)
    assert got[0] == got[2] == got[4] != got[1] == got[3] == got[5]


def test_lm_held_out(spark):
    held = [r for r in queries.op9_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# -- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    sizes = []
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, DIR)
        if i < len(p.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    from sparkloom.llm import jaccard

    left = spark.read.parquet(str(tmp_path / "1"))
    assert jaccard.near_components(left, n=5, percent=80).filter("component_id <> doc_id").count() == 0
    left = spark.read.parquet(str(tmp_path / "3"))
    assert decontam.scan(left, spark.read.parquet(f"{DIR}/benchmark.parquet")).filter("n_hit > 0").count() == 0
    assert set(r.doc_id for r in docs.select("doc_id").distinct().collect()) == set(r.doc_id for r in left.select("doc_id").collect())
