"""Classes of all recurring words, and scores against a plain count over the fitted classes."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import SCHEMA, corpus, lower, plain_words
from pyspark.sql import functions as F

from sparkloom.llm import brown, queries
from sparkloom.llm.common import drop_scratch, fold
from sparkloom.llm.oracles import WORD
from sparkloom.llm.textops import Words
from sparkloom.llm.urls import LOWER, UPPER

END = int(brown.END)
DIR = "/root/testdata/sf0.001"


def tokens(text):
    return [*(int(x) for x in Words([lower(text or "").encode()], lower=True).hash), END]


def fitted(train, **options):
    """(class of every word seen twice by its hash, model)."""
    base = train.select(F.monotonically_increasing_id().alias("k"), F.lit(None).cast("long").alias("id"), F.lit(True).alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    model, _, classes, _, scratch = brown.fit(base, **options)
    out = {r.w % 2**64: r.cls for r in classes.collect()}
    assert {int(w): int(c) for w, c in zip(model.words, model.classes, strict=True)}.items() <= out.items()
    drop_scratch(*scratch)
    return out, model


def test_scores_are_those_of_the_classes(spark):
    """Every word seen twice has a learned class; scores follow from classes and counts alone."""
    rows = corpus(13, vocabulary=300)
    docs, n_classes, alpha = spark.createDataFrame(rows, SCHEMA), 3, 20.0
    options = {"cache_words": 40, "seeds": 6, "n_classes": n_classes}
    learn = fold("doc_id", 7) != 2
    train = docs.filter(learn).select("doc_id", "text")
    kept = {r.doc_id for r in train.collect()}
    texts = {d: tokens(t) for d, t, *_ in rows}
    assert all(len(texts[d]) == len(plain_words(t)) + 1 for d, t, *_ in rows)
    c = Counter(x for d in kept for x in texts[d])
    cls, model = fitted(train, **options)
    assert cls.keys() == {w for w in c if c[w] > 1 and w != END} and set(cls.values()) <= set(range(n_classes))
    rare = n_classes + 1
    cls = {w: cls.get(w, rare) for w in c} | {END: n_classes}
    pairs = np.zeros((rare + 1, rare + 1))
    for d in kept:
        for a, b in zip([END, *texts[d]], texts[d], strict=False):
            pairs[cls[a], cls[b]] += 1
    one = (pairs.sum(axis=0) + 1) / (pairs.sum(axis=0) + 1).sum()
    step = (pairs + alpha * one) / (pairs.sum(axis=1, keepdims=True) + alpha)
    assert np.allclose(10**model.transition, step) and np.allclose((10**model.transition).sum(axis=1), 1)
    total, once, twice = Counter(), sum(n == 1 for w, n in c.items() if w != END), sum(n for w, n in c.items() if n <= 2 and w != END)
    for w, n in c.items():
        total[cls[w]] += n
    unknown = (once + 1) / (twice + 2)
    emission = {w: (n / total[cls[w]] if n > 1 or w == END else (1 - unknown) / once) for w, n in c.items()}
    mass = Counter()
    for w, share in emission.items():
        mass[cls[w]] += share
    assert all(math.isclose(x + (unknown if i == rare else 0), 1) for i, x in mass.items())
    for r in brown.score(docs, learn, **options).collect():
        t = texts[r.doc_id]
        want = sum(math.log10(step[cls.get(a, rare), cls.get(b, rare)] * emission.get(b, unknown)) for a, b in zip([END, *t], t, strict=False))
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_the_cache_decides_nothing(spark):
    """All words in memory, some, or none: one model."""
    docs = spark.createDataFrame(corpus(15, 90, vocabulary=300), SCHEMA)
    options = {"seeds": 12, "n_classes": 4}
    want, _ = fitted(docs, cache_words=1 << 20, **options)
    scores = sorted((r.doc_id, round(r.score, 6)) for r in brown.score(docs, cache_words=1 << 20, **options).collect())
    for cache in (60, 0):
        got, model = fitted(docs, cache_words=cache, **options)
        assert len(model.words) <= cache and got == want
        assert sorted((r.doc_id, round(r.score, 6)) for r in brown.score(docs, cache_words=cache, **options).collect()) == scores


def test_a_word_moves_to_its_best_class():
    """Gains against the class counts with the word taken out, one class at a time."""
    r = np.random.default_rng(4)
    b = r.integers(0, 30, (9, 9)).astype(float) * (r.random((9, 9)) < 0.7)
    np.fill_diagonal(b, 0)
    cls = r.integers(0, 4, 9)

    g = np.eye(5)[cls].T @ b @ np.eye(5)[cls]
    gains = brown.Gains(g, 4)
    for w in range(9):
        side, near = np.repeat([0, 1], 5), np.tile(np.arange(5), 2)
        c = np.concatenate([np.bincount(cls, b[:, w], 5), np.bincount(cls, b[w], 5)]).astype(int)
        keep = c > 0
        got = gains.best(np.zeros(keep.sum(), int), side[keep], near[keep], c[keep], cls[w : w + 1])[0]
        # rows and columns of the word's neighbours stay as they are for any move
        by_hand = []
        for a in range(4):
            into, out = np.bincount(cls, b[:, w], 5), np.bincount(cls, b[w], 5)
            m_in, m_out = g[:, a] - (a == cls[w]) * into, g[a] - (a == cls[w]) * out
            value = (brown._xlogx(m_in + into) - brown._xlogx(m_in)).sum() + (brown._xlogx(m_out + out) - brown._xlogx(m_out)).sum()
            col, row = g[:, a].sum() - (a == cls[w]) * into.sum(), g[a].sum() - (a == cls[w]) * out.sum()
            value -= brown._xlogx(col + into.sum()) - brown._xlogx(col) + brown._xlogx(row + out.sum()) - brown._xlogx(row)
            by_hand.append(value)
        assert by_hand[got] >= max(by_hand) - 1e-5


def test_words_are_exchanged_against_all_classed_neighbours(spark):
    """b words stand after m words only, d words after n words only, and none of the four is among the most frequent."""
    lines = []
    for a, m, last in (("x", "m", "b"), ("y", "n", "d")):
        lines += [f"{a} {m} {last}"] * 300
        lines += [f"{a} {m}{j % 8} {last}" for j in range(64)]
        lines += [f"{a} {m}{j % 8} {last}{j % 6}" for j in range(24)]
    train = spark.createDataFrame([(x,) for x in lines], "text string")
    for cache in (1 << 20, 4):
        cls, _ = fitted(train, n_classes=6, seeds=7, cache_words=cache)
        group = {x: {cls[tokens(f"{x}{i}")[0]] for i in range(6)} for x in "bd"}
        assert not group["b"] & group["d"]


def test_base_columns_against_sql(spark):
    """n_tokens, n_known, train_tokens and base_score of a whole table, stated in SQL."""
    con = duckdb.connect()
    ids = [r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM read_parquet('{DIR}/documents.parquet')").fetchall()]
    import zlib

    con.execute("CREATE TABLE f(doc_id BIGINT, held BOOLEAN)")
    con.executemany("INSERT INTO f VALUES (?, ?)", [(i, zlib.crc32(str(i).encode()) % 7 == 2) for i in ids])
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    want = con.execute(
        f"""WITH t AS (SELECT doc_id, held, list_append(regexp_extract_all({text}, '{WORD}'), ' ') AS w FROM read_parquet('{DIR}/documents.parquet') JOIN f USING (doc_id)),
x AS (SELECT doc_id, held, unnest(w) AS word FROM t), c AS (SELECT word, count(*) AS c FROM x WHERE NOT held GROUP BY word), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held, count(*), count(c), n, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) FROM x LEFT JOIN c USING (word), s GROUP BY doc_id, held, n"""
    ).fetchall()
    got = {r.doc_id: r for r in queries.op9_lm_scoring(spark, DIR).collect()}
    assert len(want) == len(got)
    for d, held, n, known, train, base in want:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_repeated_null_and_empty(spark):
    docs = spark.createDataFrame([(None, None, "", 0, ""), (1, "a b", "", 0, ""), (1, "a b", "", 0, ""), (None, "a", "", 0, "")], SCHEMA)
    nothing = brown.score(docs, F.lit(False)).collect()
    assert [r.n_known for r in nothing] == [0, 0, 0, 0] and all(math.isfinite(r.score) for r in nothing)
    out = brown.score(docs, seeds=2, n_classes=2).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in out) == [(0, 1, 1, 9), (0, 2, 2, 9), (1, 3, 3, 9), (1, 3, 3, 9)]
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert brown.score(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        brown.score(docs, rounds=0)
