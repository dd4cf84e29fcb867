"""Base columns of the quality rules against SQL, exact repeats, and Spark's conditional against the learned list."""

import duckdb
import numpy as np
import pytest
from helpers import SCHEMA, corpus
from pyspark.sql import functions as F

from sparkloom.llm import queries, rules
from sparkloom.llm.oracles import WORD

DIR = "/root/testdata/sf0.001"


def test_base_columns_against_sql(spark):
    want = duckdb.connect().execute(
        f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM read_parquet('{DIR}/documents.parquet')),
tw AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM d),
x AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM tw),
t AS (SELECT doc_id, i, a || ' ' || lead(a) OVER v || ' ' || lead(a, 2) OVER v AS g FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM t),
c AS (SELECT doc_id, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM r),
tn AS (SELECT doc_id, sum(hit) AS n FROM c GROUP BY doc_id),
tl AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS l FROM d)
SELECT doc_id, len(w) AS words, length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]', '', 'g')), length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')),
 len(l) - len(list_distinct(l)), coalesce(n, 0) AS rep, words < 50 OR 100 * rep > 50 * words FROM tw LEFT JOIN tn USING (doc_id) JOIN tl USING (doc_id)"""
    ).fetchall()
    got = queries.op4_quality_rules(spark, DIR).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 200


def test_hashes_only_nominate(spark):
    """Windows of different words never count as repeats, however many there are; equal ones always do."""
    r = np.random.default_rng(5)
    words = [f"{x:x}" for x in r.integers(0, 60, 4000)]
    spread = " ".join(words[:200]), " ".join(f"u{i}" for i in range(30000)), "a b c " * 3, "a b", "a b c a b", "\n".join(["q r s"] * 2)
    got = [r.n_repeat_words for r in rules.statistics(spark.createDataFrame(list(enumerate(spread)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[1:] == [0, 9, 0, 0, 6]


def test_spark_judges_like_the_learned_list(spark):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(["Word" if r.random() < 0.5 else "#x!"] * int(r.integers(1, 90)) + ["y"] * int(r.integers(0, 9)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("#" not in t)) for i, t in rows], "doc_id long, quality int")
    learned = rules.fit(docs, labels)
    assert learned
    x = rules.statistics(docs).select("doc_id", *[c.alias(k) for k, c in rules.features().items()]).orderBy("doc_id").toPandas()
    cols = {k: x[k].to_numpy() for k in rules.features()}
    hit = np.any([rules._covers(rule, cols, len(x)) for rule in learned], axis=0)
    got = rules.statistics(docs).select("doc_id", rules.verdict(learned).alias("v")).orderBy("doc_id").collect()
    assert [r.v for r in got] == list(~hit)


@pytest.mark.parametrize("ids", [[None, 1, 1, 2]])
def test_odd_rows(spark, ids):
    docs = spark.createDataFrame([(d, t, "x", i, "c") for i, (d, t) in enumerate(zip(ids, ["a " * 60, "a b " * 40, "a b " * 40, None]))], "doc_id long, text string, n_words string, s long, w string")
    out = rules.score(docs, []).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in out) == [(0, 60, False), (1, 80, False), (1, 80, False), (2, 0, False)]
    assert rules.score(docs.limit(0), []).count() == 0 and rules.score(spark.createDataFrame(corpus(3), SCHEMA).limit(0), []).count() == 0
    assert rules.statistics(docs.withColumn("bits", F.lit(1))).count() == 4
