"""Near-duplicate and substring operators against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, corpus, lower, plain_words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, substrings, suffix
from sparkloom.llm.components import components


def shingles(text, n):
    w = plain_words(lower(text or ""))
    return frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n, percent):
    sets = {d: shingles(t, n) for d, t, *_ in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("n, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3), (3, 100, 4)])
def test_jaccard_components(spark, n, percent, seed):
    rows = corpus(seed, 80)
    got = jaccard.near_components(spark.createDataFrame(rows, SCHEMA), n=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, percent)


@pytest.mark.parametrize("hot_from", [0, 256])
def test_jaccard_with_a_shingle_in_all_documents(spark, hot_from):
    """One line everywhere, alone or beside words of its own, in sizes of all bands; lists cut into parts lose no link."""
    r = np.random.default_rng(8)
    line, rows = "all of this is licensed under the same terms", []
    for i in range(120):
        own = [f"x{v}" for v in r.integers(0, 25 if i % 3 else 9999, int(r.integers(0, 40)))]
        if i % 4 == 0:
            own = ["y"] * (i // 8) + [f"z{i % 16}"]
        rows.append((i, " ".join([line] * (1 + i % 3) + own), "", 0, ""))
    got = jaccard.near_components(spark.createDataFrame(rows, SCHEMA), n=4, percent=70, hot_from=hot_from).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 70)


def test_jaccard_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "", 0, ""), (5, text, "", 0, ""), (5, text, "", 0, ""), (5, "other words", "", 0, ""), (7, None, "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = jaccard.near_components(docs, n=4, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted([(None, 4, None), (5, 4, None), (5, 4, None), (5, 1, 5), (7, 0, 7)], key=repr)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(5, "other words"), (7, None)]
    assert kept.count() == 3
    assert jaccard.near_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_of_each_component_stays(spark, tmp_path, monkeypatch, broadcast):
    """Keys of the rows that go are broadcast up to a bound; beyond it they are joined by a shuffle, with the same rows."""
    spark.createDataFrame(corpus(5, 80), SCHEMA).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    known = {d: c for d, (_, c) in brute_components(docs.collect(), 5, 80).items()}
    if not broadcast:
        monkeypatch.setattr(jaccard, "bounded_broadcast", lambda df: df.hint("merge"))
    kept = jaccard.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in plan) is not broadcast
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in docs.collect() if known[r.doc_id] == r.doc_id)
    assert len(set(known.values())) < len(known)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 999), (999, 998)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1000] == 998


def test_components_of_a_scrambled_path(spark):
    """Ids without order along a chain settle in few rounds."""
    ids = [int(x) for x in np.random.default_rng(3).permutation(600)]
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {(r.node, r.label) for r in components(links, max_rounds=15).collect()} == {(i, 0) for i in ids}


def brute_windows(rows, n):
    seen, out = set(), {}
    for d, t, *_ in rows:
        w = plain_words(t)
        gone = np.zeros(len(w), dtype=bool)
        for j in range(len(w) - n + 1):
            x = tuple(w[j : j + n])
            if x in seen:
                gone[j : j + n] = True
            seen.add(x)
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_windows(spark):
    rows = corpus(5)
    got = substrings.deduplicate(spark.createDataFrame(rows, SCHEMA), window=20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_windows(rows, 20)
    for r in got:
        assert hashlib.sha256(" ".join(plain_words(r.text)).encode()).hexdigest() == r.kept_sha256


def removals(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot_from", [substrings.HOT, 1])
def test_substring_index_in_batches(spark, tmp_path, hot_from):
    """Batches after restarts, compacted; with hot_from 1 many fingerprints are salted."""
    rows = corpus(6)
    got = {}
    for i, lo in enumerate(range(0, len(rows), 17)):
        index = substrings.FingerprintIndex(spark, str(tmp_path / "index"), fanout=2, hot_from=hot_from)  # as after a restart
        got |= removals(index.add(spark.createDataFrame(rows[lo : lo + 17], SCHEMA), batch=str(i)))
        if hot_from == 1:
            assert any(index._table("run-{}-{}-{}".format(*r)).filter("hot IS NOT NULL").limit(1).count() for r in index.runs())
        index.close()
    assert got == brute_windows(rows, 20)
    assert len(index.runs()) == len(index.runs("digests")) == 1  # compacted


def test_substring_batch_again(spark, tmp_path):
    """A committed batch gives its rows again; one that was lost before its commit leaves nothing."""
    rows = [r for r in corpus(6) if r[1]]
    path, texts = str(tmp_path / "index"), [spark.createDataFrame(rows[:20], SCHEMA), spark.createDataFrame(rows[20:], SCHEMA)]
    index = substrings.FingerprintIndex(spark, path)
    want = [removals(index.add(texts[0], batch="a"))]

    class Lost(substrings.FingerprintIndex):
        def _commit(self, seq, batch):
            raise OSError("lost")

    with pytest.raises(OSError):
        Lost(spark, path).add(texts[1], batch="b")
    assert index.commits() == {"a": 0} and len(index.runs()) == 1
    again = substrings.FingerprintIndex(spark, path)
    want.append(removals(again.add(texts[1], batch="b")))
    assert want[0] | want[1] == brute_windows(rows, 20)
    assert [removals(again.add(x, batch=n)) for n, x in zip("ab", texts)] == want and len(again.commits()) == 2
    again.discard()
    assert not again.commits()


def test_history_is_joined_where_it_lies(spark, tmp_path):
    """The merge join of a batch with an earlier run reads both in their buckets."""
    rows = corpus(6)
    index = substrings.FingerprintIndex(spark, str(tmp_path / "index"))
    for i in (0, 1):
        index.add(spark.createDataFrame(rows[i * 30 : i * 30 + 30], SCHEMA), batch=str(i))
    first, second = index.runs()
    parts = index._table("run-{}-{}-{}".format(*second)).groupBy("part").agg(F.sum("n").alias("n")).filter("n = 1").select("part")
    plan = index._beside(parts, first)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.discard()


def test_substring_repeated_rows_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", 9, "a"), (1, text, "fr", 8, "b"), (None, text, "x", 7, "c"), (2, None, None, None, None)], SCHEMA)
    out = substrings.cut_repeats(docs, window=20)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.lang) for r in out.collect()), key=repr) == sorted([(None, text, "x"), (2, "", None)], key=repr)
    assert substrings.deduplicate(docs.limit(0)).count() == 0
    odd = docs.select("doc_id", "text", F.col("lang").alias("lang-code"), F.col("k").alias("n chars"), F.lit("x").alias("_rest"), F.lit(1).alias("fps"))
    assert substrings.cut_repeats(odd, window=20).columns == odd.columns and substrings.cut_repeats(odd, window=20).count() == 2


def brute_bytes(rows, depth, keep):
    count, first = Counter(), {}
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, t in raw:
        for j in range(len(t) - depth + 1):
            count[t[j : j + depth]] += 1
            first.setdefault(t[j : j + depth], (d, j))
    out = {}
    for d, t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for j in range(len(t) - depth + 1):
            x = t[j : j + depth]
            if count[x] > 1 and (keep == "none" or first[x] != (d, j)):
                gone[j : j + depth] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("keep, max_group, hot_from", [("none", 8192, 64), ("none", 1, 1), ("first", 2, 3)])
def test_suffix_dedup(spark, keep, max_group, hot_from):
    """Whole groups, groups split down to single strings, and salted anchors."""
    rows = corpus(7)
    got = suffix.deduplicate(spark.createDataFrame(rows, SCHEMA), depth=60, gram=16, keep=keep, max_group=max_group, part_bytes=5000, with_text=False, hot_from=hot_from)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute_bytes(rows, 60, keep)


def test_a_hot_passage(spark):
    """One passage in every document, between texts of their own: its edges are one anchor with very many segments."""
    r = np.random.default_rng(1)
    own = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    passage = own(150)
    rows = [(i, own(int(r.integers(0, 80))) + passage + own(int(r.integers(0, 80))), "", 0, "") for i in range(150)]
    got = suffix.deduplicate(spark.createDataFrame(rows, SCHEMA), depth=60, gram=16, keep="none", max_group=20, with_text=False)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute_bytes(rows, 60, "none")


def test_suffix_repeated_rows_and_empty(spark):
    r = np.random.default_rng(0)
    text = "".join(chr(97 + c) for c in r.integers(0, 26, 100)) + "é"
    docs = spark.createDataFrame([(1, text, "", 0, ""), (1, text, "", 0, ""), (None, None, "", 0, "")], SCHEMA)
    got = suffix.deduplicate(docs, depth=50, gram=16, keep="first").collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (102, 0), (102, 102)]
    assert suffix.deduplicate(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(97, 99), min_size=1, max_size=120), st.integers(8, 40))
def test_longest_previous_factor(data, depth):
    data = np.array(data, dtype=np.uint8)
    starts = np.arange(max(0, len(data) - depth + 1))
    lpf, source = suffix.longest_previous_factor(data, starts, depth)
    raw = data.tobytes()
    for i in starts:
        best = 0
        for j in range(i):
            m = 0
            while m < depth and i + m < len(raw) and raw[i + m] == raw[j + m]:
                m += 1
            best = max(best, m)
        assert lpf[i] == best
        if best:
            assert source[i] < i and raw[source[i] : source[i] + best] == raw[i : i + best]
