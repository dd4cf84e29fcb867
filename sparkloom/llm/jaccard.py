"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct ``n``-word shingles.  Two sets link when
the intersection is at least ``percent`` % of the union.  Under any fixed
order of shingles, linked sets share one of their first
``size - ceil(size * percent / 100) + 1`` shingles, their prefixes.

Equal sets collapse into one class, and classes with identical prefixes and
size into one group; group prefixes are exploded and joined on the shingle;
group pairs are filtered by size and by what the two prefixes prove about the
whole sets; surviving group pairs expand to members, whose whole sets are
intersected exactly.

Shingles that are likely to recur come last in the order, so that prefixes
hold what is particular to a document: two sketches of fixed size (``CELLS``
counters) count all words and all shingles of all documents, and the order is
(magnitude expected from the words or counted for the shingle, hash).  The
sketches only order; they decide no pair.

Only connection is asked for, so pairs come in two rounds.  The first takes
neighbours in each posting list (at most two pairs a posting); the second
takes every pair of the same list that the first left unconnected.  A cluster
of thousands of near copies is connected by the first round and costs the
second nothing, and no link between unconnected sets can be missed.

A shingle that a task meets in very many prefixes is hot: the first round cuts
its list into parts by a hash of shingle and document, and chains the parts by
their first members.  The second round joins lists by shingle and band of sizes
(linked sizes are in the same or the next band), so a list falls apart by size
before any pair is formed.  What remains are pairs of unconnected documents of
alike sizes that share a prefix shingle; their number is not bounded by the
method, but shingles that recur often stand last in the order and enter the
prefixes of few other documents.

Defined cases: NULL, empty and blank texts have the empty set and link with
nothing; texts of fewer than ``n`` words have their whole sequence as one
shingle; equal texts, repeated rows, equal and NULL ids are separate rows with
one component (its smallest id, NULL first); an empty table gives no rows;
further columns are not read.  Shingles are compared
by 64-bit hashes (56 bits in prefixes, where a collision only adds a candidate).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_broadcast, buckets, drop_scratch, keyed, materialize, release
from sparkloom.llm.components import components
from sparkloom.llm.textops import BASES, Often, Words, batches, grams, mix, prefix, signed, spans

CELLS = 1 << 20
HASH_BITS = 56
CHUNK = 1 << 19  # bytes of text hashed at once


class Order:
    """The order of shingles: magnitude of the expected or counted occurrences, then hash.

    A shingle's magnitude is the larger of what its words' frequencies predict
    (their product) and what the shingle sketch counts above its ordinary
    level.  All arithmetic is on integers, so equal shingles always agree.
    """

    def __init__(self, words: np.ndarray, shingles: np.ndarray):
        total = max(1, int(words.sum()))
        #: eighths of a binary logarithm of each word counter's share
        self.word = np.round(8 * np.log2((words + 1) / (total + CELLS))).astype(np.int32)
        self.base = int(np.ceil(8 * np.log2(total + CELLS)))
        over = shingles // (16 + 4 * int(shingles.mean()))
        self.shingle = np.where(over > 0, np.floor(np.log2(np.maximum(over, 1))) + 7, 0).astype(np.int32)

    def codes(self, word_hash: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """Codes that sort in this order: seven bits of magnitude above 56 bits of hash."""
        w = self.word[(word_hash & np.uint64(CELLS - 1)).astype(np.int64)]
        m = len(gram)
        expected = np.full(m, self.base, dtype=np.int32)
        for i in range(n):
            expected += w[i : i + m]
        level = np.maximum((expected + 56) // 8, 0)  # 0: fewer than 1/128 expected by chance
        level = np.maximum(level, self.shingle[(gram & np.uint64(CELLS - 1)).astype(np.int64)])
        return (np.minimum(level, 127).astype(np.uint64) << np.uint64(HASH_BITS)) | (gram >> np.uint64(64 - HASH_BITS))


def shingle_sets(texts: list[bytes], n: int, order: Order | None = None) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted: as codes in ``order``, else as hashes."""
    w = Words(texts, lower=True)
    g = grams(w.hash, n)
    if order is not None:
        g = order.codes(w.hash, g, n)
    pre = prefix(w.hash, BASES[1])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(spans(pre, np.array([a]), np.array([b]), BASES[1]) >> np.uint64(64 - HASH_BITS))
        else:
            out.append(g[:0])
    return out


def sketches(base: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of all words and of all shingles by the low bits of their hash: ``CELLS`` counters each.

    Partial counters are added up in two steps; the driver reads a bounded
    number of them, one at a time.
    """

    def pack(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["cells"])

    def unpack(raw: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, CELLS * 16, "zstd", asbytes=True), dtype=np.int64).reshape(2, CELLS)

    def count(it):
        total = np.zeros((2, CELLS), dtype=np.int64)
        for batch in it:
            for _, _, texts in batches(batch, "text", CHUNK):
                w = Words(texts, lower=True).hash
                for i, x in enumerate((w, grams(w, n))):
                    total[i] += np.bincount((x & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        yield pack(total)

    def add(it):
        total = np.zeros((2, CELLS), dtype=np.int64)
        for batch in it:
            for raw in batch.column(0).to_pylist():
                total += unpack(raw)
        yield pack(total)

    parts = base.select("text").mapInArrow(count, "cells binary")
    total = np.zeros((2, CELLS), dtype=np.int64)
    for row in parts.repartition(16).mapInArrow(add, "cells binary").toLocalIterator():
        total += unpack(bytes(row["cells"]))
    return total[0], total[1]


def _digest(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    a = x.sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(x ^ np.uint64(0x5851F42D4C957F2D))) if len(x) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _prefixes(base: DataFrame, order, n: int, percent: int, hot_from: int) -> DataFrame:
    """(k, n, s1, s2, p1, p2, last, prefix, codes, hot): size, digests of the set and of its
    prefix, the prefix's last shingle, the prefix, 16 bits of each of its shingles, and the
    places in it of shingles that this task has met in very many prefixes."""

    def run(it):
        often = Often(1, hot_from)
        for batch in it:
            k = batch.column(0)
            for lo, hi, texts in batches(batch, "text", CHUNK):
                sizes, sets, heads, lasts, prefixes = [], [], [], [], []
                for u in shingle_sets(texts, n, order.value):
                    size = len(u)
                    p = size - -(-size * percent // 100) + 1 if size else 0
                    lasts.append(int(u[p - 1]) if p else 0)
                    sizes.append(size)
                    sets.append(_digest(u))
                    heads.append(_digest(u[:p]))
                    prefixes.append(signed(u[:p]))
                cut, flat = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))), pa.int32()), np.concatenate(prefixes)
                is_hot = often.salt(flat, flat) >= 0
                place = (np.arange(len(flat)) - np.repeat(cut.to_numpy()[:-1], np.diff(cut.to_numpy())))[is_hot]
                hot_cut = pa.array(np.concatenate(([0], np.cumsum(is_hot)))[cut.to_numpy()], pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(flat, pa.int64())), pa.ListArray.from_arrays(cut, pa.array(flat.astype(np.int16)))]
                lists.append(pa.ListArray.from_arrays(hot_cut, pa.array(place, pa.int32())))
                columns = [k.slice(lo, hi - lo), pa.array(sizes, pa.int64())]
                columns += [pa.array([x[i] for x in part], pa.int64()) for part in (sets, heads) for i in (0, 1)]
                columns.append(pa.array(lasts, pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=["k", "n", "s1", "s2", "p1", "p2", "last", "prefix", "codes", "hot"])

    return base.select("k", "text").mapInArrow(run, "k long, n long, s1 long, s2 long, p1 long, p2 long, last long, prefix array<long>, codes array<short>, hot array<int>")


def _whole_sets(base: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(k, set) of the documents in ``wanted`` (k)."""

    def run(it):
        for batch in it:
            for lo, hi, texts in batches(batch, "text", CHUNK):
                sets = shingle_sets(texts, n)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32()), pa.array(signed(np.concatenate(sets)), pa.int64())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["k", "set"])

    return base.select("k", "text").join(wanted, "k", "left_semi").mapInArrow(run, "k long, set array<long>")


def _near_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _can_link(n1: str, pos1: str, n2: str, pos2: str, percent: int) -> Column:
    """Whether sets of these sizes can link if a shingle at these places is the first they share.

    What comes before it in either order is in one set only.  A pair is lost
    to no test: it passes at the first shingle that it really shares.
    """
    rest = F.least(F.col(n1) - F.col(pos1), F.col(n2) - F.col(pos2))
    return _near_sizes(n1, n2, percent) & (rest * (100 + percent) >= percent * (F.col(n1) + F.col(n2)))


class _Verifier:
    """Decides member pairs (a, b): first by prefixes, then by whole sets."""

    def __init__(self, base: DataFrame, prefixes: DataFrame, n: int, percent: int):
        self.base, self.prefixes, self.n, self.percent = base, prefixes.select("k", "n", "last", "codes"), n, percent
        self.held: list[DataFrame] = []

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that their prefixes do not rule out.

        If x's prefix ends first in the order, its shingles missing from y's
        prefix are missing from y, so the intersection is at most
        n_x - missing.  Codes of 16 bits can only make fewer seem missing.
        """
        x, y = ({c: c + side if c != "k" else side for c in self.prefixes.columns} for side in "ab")
        both = pairs.join(self.prefixes.withColumnsRenamed(x), "a").join(self.prefixes.withColumnsRenamed(y), "b")
        xs, ys = F.col("na") - F.size(F.array_except("codesa", "codesb")), F.col("nb") - F.size(F.array_except("codesb", "codesa"))
        bound = F.when(F.col("lasta") < F.col("lastb"), xs).when(F.col("lasta") > F.col("lastb"), ys).otherwise(F.greatest(xs, ys))
        t = self.percent
        ok = _near_sizes("na", "nb", t) & (bound * (100 + t) >= t * (F.col("na") + F.col("nb")))
        return both.filter(ok).select("a", "b", "na", "nb")

    def links(self, possible: DataFrame) -> DataFrame:
        """(a, b) of the pairs whose whole sets link."""
        ends = possible.select(F.col("a").alias("k")).unionByName(possible.select(F.col("b").alias("k")))
        wanted = materialize(ends.distinct(), "wanted")
        sets = materialize(_whole_sets(self.base, bounded_broadcast(wanted), self.n), "sets", compression="none")
        self.held += [wanted, sets]
        rows = possible.join(sets.withColumnsRenamed({"k": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"k": "b", "set": "sb"}), "b")
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        return rows.withColumn("both", both).filter(100 * F.col("both") >= self.percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _band(n: str, percent: int) -> Column:
    """Sizes that can link are in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / max(float(np.log(100 / percent)) * 1.000001, 0.01))


def near_components(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot_from: int = 256) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every document."""
    base = keyed(docs, id_col, text_col)
    order = docs.sparkSession.sparkContext.broadcast(Order(*sketches(base, n)))  # two integers a cell
    rows = materialize(_prefixes(base, order, n, percent, hot_from), "prefixes", compression="none")
    full = rows.filter("n > 0")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("k").alias("m"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("m").alias("g"), F.count(F.lit(1)).alias("members"))
    hot = materialize(full.select(F.explode(F.transform("hot", lambda p: F.get("prefix", p))).alias("tok")).distinct(), "hot")  # each in very many prefixes
    heads = full.select(F.col("k").alias("g"), "prefix", "hot").join(groups.select("g", "n", (F.col("members") > 1).alias("many")), "g")
    postings = heads.select("g", "n", "many", "hot", F.posexplode("prefix").alias("pos", "tok"))
    part = F.when(F.array_contains("hot", F.col("pos")), F.pmod(F.xxhash64("g", "tok"), F.lit(buckets(docs.sparkSession)))).otherwise(-1).cast("int")
    postings = postings.select("g", "n", "many", "pos", "tok", part.alias("part"))
    by = Window.partitionBy("tok", "part").orderBy("n", "g")
    so_far = by.rowsBetween(Window.unboundedPreceding, -1)
    postings = postings.select(
        "tok", "g", "n", "pos", F.lag(F.struct("g", "n", "pos")).over(by).alias("prev"), F.lead("g").over(by).alias("next"),
        F.min(F.struct("g", "n", "pos")).over(so_far).alias("head"), F.coalesce(F.lag("g", 2).over(by), F.lead("g", 2).over(by)).isNotNull().alias("end_of_long"),
        (F.col("many") | F.coalesce(F.lag("many").over(by), F.lit(False)) | F.coalesce(F.lead("many").over(by), F.lit(False))).alias("many"),
    ).join(bounded_broadcast(hot.withColumn("is_hot", F.lit(True))), "tok", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    postings = postings.filter("prev IS NOT NULL OR next IS NOT NULL OR is_hot")
    # a list of two classes is settled by its one pair of neighbours; only others have more pairs
    long_list = F.col("is_hot") | F.col("end_of_long") | F.col("many") | (F.col("prev").isNotNull() & F.col("next").isNotNull())
    sides = [F.when(_can_link(f"{x}.n", f"{x}.pos", "n", "pos", percent), F.col(f"{x}.g")).alias(x) for x in ("prev", "head")]
    first = F.col("is_hot") & F.col("prev").isNull()
    postings = materialize(postings.select("tok", "g", "n", "pos", *sides, long_list.alias("long_list"), first.alias("first")), "postings")
    chain = Window.partitionBy("tok").orderBy("n", "g")  # the parts of a hot list, at most one a bucket
    parts = postings.filter("first").select("g", F.lag("g").over(chain).alias("prev")).filter("prev IS NOT NULL")
    release(docs.sparkSession)
    # members of groups that hold more than one class
    members = classes.join(groups.filter("members > 1"), ["n", "p1", "p2"]).select("m", "g", "n", "p1", "p2")
    inner = Window.partitionBy("n", "p1", "p2").orderBy("m")
    chains = members.select("m", "g", F.lag("m").over(inner).alias("prev")).filter("prev IS NOT NULL")

    check = _Verifier(base, rows, n, percent)
    near = postings.filter("prev IS NOT NULL").select(*_ordered("prev", "g")).unionByName(postings.filter("head IS NOT NULL").select(*_ordered("head", "g")))
    near = near.unionByName(parts.select(*_ordered("prev", "g")))
    near = near.unionByName(chains.select(*_ordered("prev", "m"))).unionByName(chains.select(*_ordered("g", "m")))
    tried = materialize(near.filter("a <> b").distinct(), "pairs")
    release(docs.sparkSession)
    possible = materialize(check.possible(tried), "possible")
    release(docs.sparkSession)
    links = materialize(check.links(possible), "links")
    drop_scratch(possible, *check.held)
    release(docs.sparkSession)
    labels = components(links)
    release(docs.sparkSession)

    # second round: pairs of one list whose members are not connected yet
    lists = postings.filter("long_list").select("tok", "g", "n", "pos").join(members.select("g", "m"), "g", "left").select("tok", "n", "pos", F.coalesce("m", "g").alias("m"))
    lists = lists.unionByName(members.select(F.xxhash64("n", "p1", "p2").alias("tok"), "n", F.lit(0).alias("pos"), "m"))
    lists = lists.join(labels.withColumnsRenamed({"node": "m"}), "m", "left").select("tok", "n", "pos", "m", F.coalesce("label", "m").alias("c"))
    per = lists.groupBy("tok", "c").agg(F.count(F.lit(1)).alias("here"))
    main = per.groupBy("tok").agg(F.max_by("c", F.struct("here", "c")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    lists = materialize(lists.join(main.select("tok", "main"), "tok").withColumn("band", _band("n", percent)), "lists")
    bands = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")
    few = lists.filter("c <> main").select("tok", bands, F.col("m").alias("m1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"), F.col("c").alias("c1"))
    other = lists.select("tok", "band", F.col("m").alias("m2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("c").alias("c2"), (F.col("c") == F.col("main")).alias("in_main"))
    cross = few.join(other, (few["tok"] == other["tok"]) & (few["band"] == other["band"]) & (F.col("c1") != F.col("c2")) & (F.col("in_main") | (F.col("m1") < F.col("m2"))) & _can_link("n1", "pos1", "n2", "pos2", percent))
    cross = cross.select(*_ordered("m1", "m2")).distinct().join(tried, ["a", "b"], "left_anti")
    drop_scratch(postings, hot)
    release(docs.sparkSession)
    more = materialize(check.possible(cross), "possible")
    drop_scratch(lists, tried)
    release(docs.sparkSession)
    if more.limit(1).count():
        found = materialize(check.links(more), "links")
        if found.limit(1).count():
            before, labels = labels, components(links.unionByName(found))
            drop_scratch(before)
        drop_scratch(found, *check.held)
    drop_scratch(more, links)

    # classes back to documents: only classes with copies or a label differ from their own id
    of_class = classes.join(labels.withColumnsRenamed({"node": "m"}), "m", "left").filter("copies > 1 OR label IS NOT NULL")
    of_class = of_class.select("n", "s1", "s2", F.coalesce("label", "m").alias("c"))
    out = rows.select("k", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left").select("k", F.col("n").alias("n_shingles"), F.coalesce("c", "k").alias("c"))
    if "id" not in base.columns:
        out = out.select(F.col("k").alias(id_col), "n_shingles", F.col("c").alias("component_id"))
    else:
        ids = base.select("k", "id")
        out = out.join(ids, "k").join(ids.withColumnsRenamed({"k": "c", "id": "component_id"}), "c").select(F.col("id").alias(id_col), "n_shingles", "component_id")
    out = materialize(out, "components")
    drop_scratch(rows, classes, labels, base)
    release(docs.sparkSession)
    return out


def keep_one(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, the first in (id, text) order, with all its columns.

    Documents with an empty set are kept.  The keys of the rows that go are
    broadcast to the rows if there are at most two million of them, so that no
    text is shuffled; more of them are joined by a shuffle on the key.
    """
    base = keyed(docs.withColumn("_row", F.struct(*docs.columns)), id_col, text_col, "_row")
    found = near_components(base.select("k", "text"), n=n, percent=percent, id_col="k", text_col="text")
    gone = found.filter("component_id <> k AND n_shingles > 0").select("k")
    return base.join(bounded_broadcast(gone), "k", "left_anti").select("_row.*")
