"""Scratch tables in the shared folder, row keys and labelled folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Orders before every doc_id: stands for a NULL doc_id inside an operator.
NULL_KEY = -(2**63)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Only a local session, whose executors share one disk, may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "") or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/sparkloom"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a shared table and read it back, cutting its lineage.

    A lost executor costs a re-read of the files, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, key: str, name: str, *, dealt: bool = False, **options: str) -> DataFrame:
    """Like ``materialize``, with one sorted file for each hash bucket of ``key``:
    aggregations and joins on it need no further shuffle.  ``dealt``: ``df`` comes
    from ``repartition(buckets(spark), key)`` and is sorted by it."""
    spark = df.sparkSession
    n = buckets(spark)
    table = f"loom_{name}_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, key).sortWithinPartitions(key)
    path = f"{scratch_dir(spark)}/{table}"
    rows.write.bucketBy(n, key).sortBy(key).options(**options).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._scratch, out._table = path, table
    return out


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables written by ``materialize`` or ``bucketed`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            spark = t.sparkSession
            if getattr(t, "_table", None):
                spark.sql(f"DROP TABLE IF EXISTS {t._table}")
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no DataFrame uses any more.

    Spark deletes them when the driver's JVM finds their handles unreachable;
    operators of several actions ask for that between phases, so their disk
    need is that of a phase, not of their sum.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()


def bounded_broadcast(df: DataFrame, max_rows: int = 1 << 21) -> DataFrame:
    """``df`` (a narrow table already written) marked for broadcast if it has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def doc_key(column: str = "doc_id") -> Column:
    """A never-NULL long that orders like doc_id, NULL first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY).cast("long"))


def key_to_id(column: str) -> Column:
    return F.when(F.col(column) != F.lit(NULL_KEY).cast("long"), F.col(column))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k long, text string): the two columns that text operators read; NULL text is empty."""
    return docs.select(doc_key(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))



def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None) -> DataFrame:
    """(k long, text string) with a unique, never-NULL k that orders like (id, text), NULL id first.

    k is the id itself where ids are unique and not NULL.  Otherwise rows are
    sorted into a scratch table and numbered, so repeated rows become separate
    documents that follow one another, and a column ``id`` is kept beside k.
    A column named ``extra`` is carried along.
    """
    more = [extra] if extra else []
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} is {kind.simpleString()}; this operator orders documents by an integer id")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    if not rows.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").limit(1).count():
        return rows.select(F.coalesce("id", F.lit(NULL_KEY).cast("long")).alias("k"), "text", *more)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "text").sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("k"), "id", "text", *more), "keyed")


def id_of(base: DataFrame) -> Column:
    """The document id of a row of ``keyed``."""
    return F.col("id") if "id" in base.columns else F.col("k")


class Places:
    """(k, position) pairs as one sortable column: a long where the ranges fit, else a struct."""

    def __init__(self, base: DataFrame):
        low, high, size = base.agg(F.min("k"), F.max("k"), F.max(F.octet_length("text"))).first()
        self.low, self.bits = low or 0, max(1, int(size or 0).bit_length())
        self.packed = ((high or 0) - self.low).bit_length() + self.bits <= 62

    def code(self, k: str, at: str) -> Column:
        if self.packed:
            return F.shiftleft(F.col(k) - F.lit(self.low), self.bits).bitwiseOR(F.col(at).cast("long"))
        return F.struct(F.col(k).alias("k"), F.col(at).cast("long").alias("at"))

    def k(self, code: str) -> Column:
        return F.shiftright(code, self.bits) + F.lit(self.low) if self.packed else F.col(f"{code}.k")

    def at(self, code: str) -> Column:
        at = F.col(code).bitwiseAND(F.lit((1 << self.bits) - 1)) if self.packed else F.col(f"{code}.at")
        return at.cast("int")


def exact_copies(base: DataFrame) -> DataFrame:
    """(k, first, copies) of every document whose whole text occurs more than once; first is the smallest k.  A scratch table."""
    digests = base.select("k", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    digests = materialize(digests, "digests")
    groups = digests.groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # written out, so that the join reads both sides plainly and AQE can split a digest of very many copies
    groups = materialize(groups, "groups")
    out = materialize(digests.join(groups, "digest").select("k", "first", "copies"), "copies")
    drop_scratch(digests, groups)
    return out


def dealt(key: str, salt: str) -> Column:
    """What a hash's rows are bucketed by: itself, or for a salted (hot) one a hash of both."""
    return F.when(F.col(salt) < 0, F.col(key)).otherwise(F.xxhash64(key, salt))
