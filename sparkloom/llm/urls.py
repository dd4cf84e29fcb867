"""URL rules: a blocked Bloom filter in front of an exact hash join.  [native]

A rule is a host (matching itself and all subdomains) with a path prefix.
Every URL expands to the canonical keys host-suffix + path-prefix that a rule
could list; only suffixes of as many labels and prefixes of such lengths as
occur among the rules are formed.  A split-block Bloom filter of the listed
keys (blocks of eight 64-bit words, one bit in each) drops the keys that are
certainly not listed; an exact join on the key removes false positives; the
longest rule wins.

The filter has a fixed upper size (``max_filter_bytes``), whatever the list:
beyond it only more false positives reach the join.  The join leaves its
strategy to Spark: a list under the broadcast threshold is sent to the tasks,
a larger one is shuffled, with skewed keys split by AQE.  URLs without a
possible hit are not shuffled; for that the two columns are read twice.

Defined cases: a NULL url, or one without ``://``, has empty host and path and
fits no rule; NULL rules are ignored; a key listed more than once blocks if
any of its rules blocks; rules of equal length prefer the longer host; an
empty list allows everything; repeated rows and NULL ids are judged a row at a
time; further columns of ``pages`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int")


def bloom(keys: DataFrame, key: str, n_keys: int, *, bits_per_key: int = 24, max_filter_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """(one row with ``blocks``: array of eight-word structs, number of blocks)."""
    n_blocks = max(1, min(max_filter_bytes // (8 * WORDS), -(-n_keys * bits_per_key // (64 * WORDS))))
    k = F.col(key)
    bits = [F.bit_or(F.expr(f"shiftleft(1L, pmod(xxhash64(`{key}`, {w}), 64L))")).alias(f"w{w}") for w in range(WORDS)]
    filled = keys.groupBy(_block(k, n_blocks).alias("b")).agg(*bits)
    every = keys.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("b")).join(filled, "b", "left")
    words = [F.coalesce(F.col(f"w{w}"), F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)]
    return every.agg(F.array_sort(F.collect_list(F.struct("b", *words))).alias("blocks")), n_blocks


def may_hold(blocks: Column, n_blocks: int, key: Column) -> Column:
    """False if ``key`` is certainly not among the listed keys."""
    block = F.get(blocks, _block(key, n_blocks))
    hit = None
    for w in range(WORDS):
        one = F.getbit(block[f"w{w}"], _bit(key, w)) == 1
        hit = one if hit is None else hit & one
    return hit


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (listed key or NULL) and verdict of every row.

    ``rules``: host, path, verdict ('allow' or 'block').
    """
    listed = (
        rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(F.concat("host", "path").alias("key"), F.length("host").alias("host_len"), "verdict")
        .groupBy("key").agg(F.max("host_len").alias("host_len"), F.max("verdict").alias("verdict"))
    )
    facts = rules.filter("host IS NOT NULL AND path IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lens")
    ).first()  # one row: a count, a number of labels and the distinct prefix lengths
    base = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not facts["n"]:
        return base.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    filter_row, n_blocks = bloom(listed, "key", facts["n"])
    # a scalar subquery: evaluated once, of bounded size
    base = base.withColumn("blocks", filter_row.scalar()).withColumn("labels", F.split("host", r"\."))
    n = F.size("labels")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), n - facts["labels"] + 1), n), lambda i: F.array_join(F.slice("labels", i, n), ".")
    )
    lens = F.filter(F.array(*[F.lit(x) for x in facts["lens"]]), lambda x: x <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(lens, lambda x: F.concat(h, F.substring(F.col("path"), F.lit(1), x)))))
    possible = base.withColumn("keys", keys).withColumn("keys", F.filter("keys", lambda k: may_hold(F.col("blocks"), n_blocks, k)))
    # only rows with a possible hit are joined and gathered again; all others are judged where they were read
    some = F.size("keys") > 0
    rows = possible.filter(some).select("rid", "id", "host", "path", F.explode("keys").alias("key"))
    hits = rows.join(listed, "key", "left")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("key").alias("len"), "host_len", "key", "verdict"))).alias("best")
    judged = hits.groupBy("rid", "id", "host", "path").agg(best).select("id", "host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict"))
    clear = possible.filter(~some).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return clear.unionAll(judged).select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
