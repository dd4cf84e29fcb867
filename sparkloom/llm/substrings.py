"""Substring deduplication with a log-structured fingerprint index.

A window is ``window`` consecutive words.  From every window one fingerprint
is selected, the smallest hash among its ``gram``-word pieces: equal windows
select equal fingerprints, and consecutive windows mostly select the same one,
so about one fingerprint for seven words is stored.  The fingerprints of each
batch of documents form an immutable run, sorted and bucketed by fingerprint
with one number of buckets for the whole index; a new batch's run is
merge-joined with every earlier run bucket by bucket, so history is read but
never shuffled.  Fingerprints found more than once only nominate windows: their
128-bit hashes of all words verify them, and the earliest place of each window
content decides.  Runs are compacted in tiers.

A batch has a name and takes effect by a commit file that is written last.
What a lost job left behind is discarded by the next one; adding a committed
batch again gives its stored result.  A run that a longer one covers is
ignored, so a crash during compaction leaves a valid index.

Hot groups: a fingerprint that a task meets very often is dealt over all
buckets by a hash of the document (a salt), and listed as hot, so that later
batches look it up in all of them.  A window content shared by a third of all
documents is pre-aggregated to its earliest place before the shuffle; a
document receives the list of its windows that come first, and all its other
nominated windows are repetitions.  Exact copies of an earlier text are found
by digest (one row a text, pre-aggregated) and are not fingerprinted.  Nothing
is enumerated in pairs.

Defined cases: NULL and empty texts have no words; documents of fewer words
than a window lose nothing; rows with equal or NULL ids are ordered by (id,
text), NULL first, and count as separate documents; an empty batch gives no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import Places, bucketed, buckets, dealt, drop_scratch, id_of, keyed, materialize, release, scratch_dir
from sparkloom.llm.textops import BASES, Often, Words, anchors, batches, grams, mix, signed

WINDOW, GRAM = 20, 8
HOT = 64  #: documents of a task from which a fingerprint can be hot


class Selected:
    """The windows of a run of texts and the fingerprint that each selects."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.words = w = Words(texts, lower=False)
        n = len(w.hash)
        end_of = np.repeat(w.first[1:], w.counts())  # end of the text of each word
        self.gram = grams(w.hash, gram)
        inside = np.arange(len(self.gram)) + gram <= end_of[: len(self.gram)]
        chosen = anchors(self.gram, inside, window - gram + 1)
        at = np.arange(len(chosen))
        ok = at + window <= end_of[: len(chosen)] if n else at.astype(bool)
        self.at, self.anchor = at[ok], chosen[ok]  # window starts (word indexes) and their anchors
        self.owner = np.searchsorted(w.first, self.at, side="right") - 1

    def distinct(self) -> np.ndarray:
        """Indexes into ``at``: the first window of each anchor."""
        return np.flatnonzero(np.diff(self.anchor, prepend=-1)) if len(self.anchor) else np.empty(0, dtype=np.int64)


def _nominated(s: Selected, shared: list) -> np.ndarray:
    """Which windows select one of the fingerprints that these documents share with others."""
    if not len(s.at):
        return np.empty(0, dtype=bool)
    known = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in shared if x is not None and len(x)] or [np.empty(0, np.int64)]))
    return np.isin(signed(s.gram[s.anchor]), known)


def fingerprints(base: DataFrame, window: int, gram: int, salts: int, hot_from: int = HOT) -> DataFrame:
    """(fp, k, n, salt): the selected fingerprints of every document and how many places select each.

    salt: -1, or for fingerprints that this task has met often a number below ``salts`` by the document.
    """

    def run(it):
        often = Often(salts, hot_from)
        for batch in it:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, texts in batches(batch, "text"):
                s = Selected(texts, window, gram)
                one = s.distinct()
                fp, owner = signed(s.gram[s.anchor[one]]), s.owner[one]
                order = np.lexsort((fp, owner))
                fp, owner = fp[order], owner[order]
                cut = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])))) if len(fp) else order
                n = np.diff(np.append(cut, len(fp)))
                fp, key = fp[cut], k[lo + owner[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(key), pa.array(n.astype(np.int32)), pa.array(often.salt(fp, key))], names=["fp", "k", "n", "salt"])

    return base.select("k", "text").mapInArrow(run, "fp long, k long, n int, salt int")


def _numpy_lists(column: pa.Array) -> list:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def window_hashes(nominated: DataFrame, window: int, gram: int) -> DataFrame:
    """(h1, h2, k, at) of the nominated windows; one row for equal windows of a document, the earliest."""

    def run(it):
        for batch in it:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            fps = _numpy_lists(batch.column(2))
            for lo, hi, texts in batches(batch, "text"):
                s = Selected(texts, window, gram)
                pick = np.flatnonzero(_nominated(s, fps[lo:hi]))
                at, owner = s.at[pick], s.owner[pick]
                h1 = grams(s.words.hash, window, BASES[0])[at]
                h2 = grams(mix(s.words.hash), window, BASES[1])[at]
                order = np.lexsort((at, h2, h1, owner))
                same = np.zeros(len(order), dtype=bool)
                a, b = order[1:], order[:-1]
                same[1:] = (owner[a] == owner[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
                one = order[~same]
                start = at[one] - s.words.first[owner[one]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h1[one])), pa.array(signed(h2[one])), pa.array(k[lo + owner[one]]), pa.array(start.astype(np.int32))], names=["h1", "h2", "k", "at"]
                )

    return nominated.select("k", "text", "fps").mapInArrow(run, "h1 long, h2 long, k long, at int")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class FingerprintIndex:
    """An index below ``path``: runs of batches lo to hi, each batch's texts, results and commit files.

    ``run-lo-hi-n``: (part, hot, seq, k, n) in n buckets by part, the
    fingerprint itself or, of a hot one (named in ``hot``), a hash of it and a
    salt.  ``digests-lo-hi-n``: (digest) of all distinct texts.  ``texts-seq-n``:
    a batch's texts in buckets by k.  ``result-seq``: its removals.
    """

    COLUMNS = {"run": ("part", "part BIGINT, hot BIGINT, seq INT, k BIGINT, n INT"), "digests": ("digest", "digest BINARY"), "texts": ("k", "k BIGINT, text STRING")}

    def __init__(self, spark: SparkSession, path: str, *, window: int = WINDOW, gram: int = GRAM, fanout: int = 4, hot_from: int = HOT):
        self.spark, self.path, self.window, self.gram, self.fanout, self.hot_from = spark, path.rstrip("/"), window, gram, fanout, hot_from
        self._tables: set[str] = set()

    # -- files -------------------------------------------------------------
    def _fs(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[re.Match]:
        p, fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return [m for x in names if (m := re.fullmatch(pattern, x))]

    def _delete(self, name: str) -> None:
        if (table := self._name(name)) in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self._tables.discard(table)
        p, fs = self._fs(name)
        fs.delete(p, True)

    def commits(self) -> dict[str, int]:
        """The number of every committed batch by its name."""
        out = {}
        for m in self._names(r"commit-(\d+)"):
            p, fs = self._fs(m[0])
            stream = fs.open(p)
            try:
                out[bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()] = int(m[1])
            finally:
                stream.close()
        return out

    def _commit(self, seq: int, batch: str) -> None:
        p, fs = self._fs(f"commit-{seq}")
        stream = fs.create(p, False)  # fails if another job was first
        stream.write(bytearray(batch.encode()))
        stream.close()

    def runs(self, kind: str = "run") -> list[tuple[int, int, int]]:
        """(lo, hi, buckets) of the complete runs of committed batches that no other run covers."""
        last = len(self.commits()) - 1
        every = sorted({tuple(map(int, m.groups())) for m in self._names(kind + r"-(\d+)-(\d+)-(\d+)") if self._fs(f"{m[0]}/_SUCCESS")[1].exists(self._fs(f"{m[0]}/_SUCCESS")[0])})
        every = [r for r in every if r[1] <= last]
        return [r for r in every if not any(o[0] <= r[0] and r[1] <= o[1] and (o[0], o[1]) != (r[0], r[1]) for o in every)]

    def buckets(self) -> int:
        """Of all tables of the index: as many as its first batch had shuffle partitions."""
        found = self._names(r"run-\d+-\d+-(\d+)")
        return int(found[0][1]) if found else buckets(self.spark)

    def _name(self, name: str) -> str:
        return "loom_" + hashlib.md5(f"{self.path}/{name}".encode()).hexdigest()

    def _table(self, name: str) -> DataFrame:
        kind, n = name.split("-")[0], name.split("-")[-1]
        key, columns = self.COLUMNS[kind]
        table = self._name(name)
        if table not in self._tables:
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{self.path}/{name}'"
            )
            self._tables.add(table)
        return self.spark.table(table)

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        n, key = int(name.split("-")[-1]), self.COLUMNS[name.split("-")[0]][0]
        self._delete(name)
        one_file_a_bucket = rows.repartition(n, key).sortWithinPartitions(key)
        one_file_a_bucket.write.bucketBy(n, key).sortBy(key).option("path", f"{self.path}/{name}").mode("overwrite").saveAsTable(self._name(name))
        self._tables.add(self._name(name))
        return self.spark.table(self._name(name))

    def close(self) -> None:
        """Forget the session's tables; the files stay."""
        for t in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._tables.clear()

    def discard(self) -> None:
        """Delete everything but the results."""
        for m in self._names(r"(run|digests|texts|hot|commit)-.*"):
            self._delete(m[0])
        self.close()

    # -- operations --------------------------------------------------------
    def add(
        self, docs: DataFrame, *, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, extra: str | None = None, compact: bool = True
    ) -> DataFrame:
        """Removals in a new batch: id, n_words, n_removed, kept_sha256 (kept words
        joined by one space) and, if asked for, the text with the removed words cut out.
        A column named ``extra`` is carried through.

        Earlier batches precede this one; within it (id, text) decides.  ``batch``
        names it: a job that is run again gives the same name and gets the same rows.
        """
        done = self.commits()
        batch = batch or uuid.uuid4().hex
        if batch in done:
            return self.spark.read.parquet(f"{self.path}/result-{done[batch]}")
        seq = len(done)
        for m in [*self._names(r"(?:run|digests|hot)-\d+-(\d+).*"), *self._names(r"(?:texts|result)-(\d+).*")]:
            if int(m[1]) >= seq:  # a job that did not commit
                self._delete(m[0])
        nb = self.buckets()
        old, scratch = self.runs(), []
        keys = keyed(docs, id_col, text_col, extra)
        base = self._write(f"texts-{seq}-{nb}", keys)
        copies, digests = self._copies(base, seq, nb)
        fresh = base.join(copies, "k", "left_anti")
        rows = fingerprints(fresh, self.window, self.gram, nb, self.hot_from)
        rows = rows.select(dealt("fp", "salt").alias("part"), F.when(F.col("salt") >= 0, F.col("fp")).alias("hot"), F.lit(seq).alias("seq"), "k", "n")
        own = self._write(f"run-{seq}-{seq}-{nb}", rows)
        hot = own.filter("hot IS NOT NULL").select("hot").distinct()
        hot.write.mode("overwrite").parquet(f"{self.path}/hot-{seq}-{seq}")
        shared = self._shared(own, seq, old)
        lists = own.filter("hot IS NULL").join(shared, "part", "left_semi").select("k", F.col("part").alias("fp")).unionByName(own.filter("hot IS NOT NULL").select("k", F.col("hot").alias("fp")))
        lists = lists.groupBy("k").agg(F.collect_list("fp").alias("fps"))  # bounded by the document
        meta = materialize(lists.join(copies.withColumn("copy", F.lit(True)), "k", "full_outer"), "nominees")
        release(self.spark)
        places = Places(base)
        windows = window_hashes(base.join(meta.filter("copy IS NULL"), "k"), self.window, self.gram).withColumn("new", places.code("k", "at"))
        firsts = windows.groupBy("h1", "h2").agg(F.min("new").alias("new"))
        if old:
            history, held = self._history_windows(shared, old)
            scratch += held
            firsts = firsts.join(history, ["h1", "h2"], "left_anti")
        firsts = firsts.select(places.k("new").alias("k"), places.at("new").alias("at")).groupBy("k").agg(F.collect_list("at").alias("firsts"))
        rows = base.join(meta, "k", "left").join(firsts, "k", "left").select(id_of(base).alias("id"), "text", "fps", "copy", "firsts", *([extra] if extra else []))
        self._remove(rows, id_col, with_text, extra).write.mode("overwrite").parquet(f"{self.path}/result-{seq}")
        self._commit(seq, batch)
        drop_scratch(meta, shared, copies, digests, *scratch)
        drop_scratch(keys)
        if compact:
            self.compact()
        release(self.spark)
        return self.spark.read.parquet(f"{self.path}/result-{seq}")

    def _copies(self, base: DataFrame, seq: int, nb: int) -> tuple[DataFrame, DataFrame]:
        """((k) of the texts that are there before, whole, in this batch or an earlier one; a scratch table)."""
        digests = materialize(base.select("k", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "digests")
        first = digests.groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("copies"))
        old = self.runs("digests")
        own = self._write(f"digests-{seq}-{seq}-{nb}", first.select("digest"))
        seen = [own.join(self._table(f"digests-{a}-{b}-{c}"), "digest", "left_semi").select("digest", F.lit(None).cast("long").alias("first")) for a, b, c in old]
        # written out, so that the join reads both sides plainly and AQE can split a digest of very many copies
        again = materialize(_union([first.filter("copies > 1").select("digest", "first"), *seen]), "again")
        copies = digests.join(again, "digest").filter("first IS NULL OR first < k").select("k").distinct()
        out = materialize(copies, "copies")
        drop_scratch(again)
        return out, digests

    def _shared(self, own: DataFrame, seq: int, old: list[tuple[int, int, int]]) -> DataFrame:
        """(part) fingerprints of this batch found twice in it, or once beside history; bucketed."""
        counts = own.groupBy("part").agg(F.sum("n").alias("n"), F.max("hot").alias("hot"))
        once = counts.filter("n = 1 AND hot IS NULL").select("part")
        found = [counts.filter("n > 1 AND hot IS NULL").select("part"), self._hot(seq, seq)]
        for r in old:
            found.append(self._beside(once, r))
            found.append(once.join(self._hot(r[0], r[1]), "part", "left_semi"))
        return bucketed(_union(found), "part", "shared")

    def _beside(self, parts: DataFrame, run: tuple[int, int, int]) -> DataFrame:
        """Those of ``parts`` (bucketed) that an earlier run holds: a merge join of buckets."""
        return parts.join(self._table("run-{}-{}-{}".format(*run)).select("part").hint("merge"), "part", "left_semi")

    def _hot(self, lo: int, hi: int) -> DataFrame:
        """(part): the hot fingerprints of a run; few, as each occurs very often."""
        where = [f"{self.path}/{m[0]}" for m in self._names(r"hot-(\d+)-(\d+)") if lo <= int(m[1]) and int(m[2]) <= hi]
        return self.spark.read.schema("hot long").parquet(*where).select(F.col("hot").alias("part")).distinct()

    def _history_windows(self, shared: DataFrame, runs: list[tuple[int, int, int]]) -> tuple[DataFrame, list[DataFrame]]:
        """(h1, h2) of the windows that earlier batches' documents hold around this batch's shared fingerprints."""
        held, rows = [], []
        texts = {int(m[1]): m[0] for m in self._names(r"texts-(\d+)-\d+")}
        for lo, hi, nb in runs:
            run = self._table(f"run-{lo}-{hi}-{nb}")
            plain = run.filter("hot IS NULL").join(shared, "part", "left_semi").select("seq", "k", F.col("part").alias("fp"))
            salted = self._hot(lo, hi).join(shared, "part", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("salt"), F.col("part").alias("fp"))
            salted = run.filter("hot IS NOT NULL").join(salted.select(dealt("fp", "salt").alias("part")), "part", "left_semi").select("seq", "k", F.col("hot").alias("fp"))
            lists = materialize(plain.unionByName(salted).groupBy("seq", "k").agg(F.collect_list("fp").alias("fps")), "history")
            held.append(lists)
            for seq in range(lo, hi + 1):
                old = self._table(texts[seq]).select("k", "text").join(lists.filter(F.col("seq") == seq), "k")
                rows.append(window_hashes(old, self.window, self.gram).select("h1", "h2"))
        return _union(rows).distinct(), held

    def compact(self) -> None:
        """Merge the newest runs once ``fanout`` of them span alike numbers of batches."""
        while len(runs := self.runs()) >= self.fanout:
            tail = runs[-self.fanout :]
            if tail[0][1] - tail[0][0] > tail[-1][1] - tail[-1][0]:
                return
            for kind in ("digests", "run"):
                self._write(f"{kind}-{tail[0][0]}-{tail[-1][1]}-{tail[0][2]}", _union([self._table("{}-{}-{}-{}".format(kind, *r)) for r in tail]))
            for r in tail:  # covered by the new runs from here on
                for kind in ("digests", "run"):
                    self._delete("{}-{}-{}-{}".format(kind, *r))

    def _remove(self, rows: DataFrame, id_col: str, with_text: bool, extra: str | None = None) -> DataFrame:
        window, gram = self.window, self.gram

        def run(it):
            for batch in it:
                ids, fps, firsts = batch.column(0), batch.column(2), batch.column(4)
                copy = batch.column(3).fill_null(False).to_numpy(zero_copy_only=False)
                fps = _numpy_lists(fps.fill_null([])) if batch.num_rows else []
                firsts = _numpy_lists(firsts.fill_null([])) if batch.num_rows else []
                for lo, hi, texts in batches(batch, "text"):
                    done = _removed_rows(texts, ids.slice(lo, hi - lo), fps[lo:hi], copy[lo:hi], firsts[lo:hi], window, gram, with_text)
                    if extra:
                        done = done.append_column("_extra", batch.column(5).slice(lo, hi - lo))
                    yield done

        schema = T.StructType().add("id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
        if with_text:
            schema.add("text", "string")
        if extra:
            schema.add("_extra", rows.schema[extra].dataType)
        out = rows.mapInArrow(run, schema)
        return out.withColumnsRenamed({"id": id_col} | ({"_extra": extra} if extra else {}))


def _removed_rows(texts, ids, fps, copy, firsts, window: int, gram: int, with_text: bool) -> pa.RecordBatch:
    s = Selected(texts, window, gram)
    w, n_texts = s.words, len(texts)
    repeated = _nominated(s, fps)
    first_at = np.concatenate([f.astype(np.int64) + w.first[i] for i, f in enumerate(firsts)] or [np.empty(0, np.int64)])
    repeated &= ~np.isin(s.at, first_at)
    repeated |= copy[s.owner]
    edge = np.zeros(len(w.hash) + 1, dtype=np.int32)
    np.add.at(edge, s.at[repeated], 1)
    np.add.at(edge, s.at[repeated] + window, -1)
    gone = np.cumsum(edge)[:-1] > 0
    total = np.concatenate(([0], np.cumsum(gone)))
    counts, removed = w.counts(), total[w.first[1:]] - total[w.first[:-1]]
    digests, kept = [], []
    for i, t in enumerate(texts):
        a, b = w.first[i], w.first[i + 1]
        if not removed[i]:
            digests.append(hashlib.sha256(b" ".join(t.split())).hexdigest())
            kept.append(t)
            continue
        # pieces of the text between removed spans, each with the space that follows its words
        flag = np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)
        ups, downs = np.flatnonzero(flag == 1), np.flatnonzero(flag == -1)
        cut, pieces = 0, []
        for u, d in zip(ups.tolist(), downs.tolist(), strict=True):
            pieces.append(t[cut : w.start[a + u] - w.text_start[i]])
            cut = w.start[a + d] - w.text_start[i] if a + d < b else len(t)
        rest = b"".join([*pieces, t[cut:]])
        kept.append(rest)
        digests.append(hashlib.sha256(b" ".join(rest.split())).hexdigest())
    columns = [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
    names = ["id", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
        names.append("text")
    return pa.RecordBatch.from_arrays(columns, names=names)


def deduplicate(
    docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, extra: str | None = None, parts: int = 3,
) -> DataFrame:
    """All of ``docs`` through a new index, in ``parts`` batches of consecutive ids (ranges from quantiles, NULL first)."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}", window=window, gram=gram, fanout=2)
    key = F.col(id_col).cast("long")
    bounds = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)])).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    out = []
    for i in range(len(bounds) + 1):
        inside = F.lit(True)
        if i:
            inside &= key >= bounds[i - 1]
        if i < len(bounds):
            inside &= key < bounds[i] if i else (key < bounds[i]) | key.isNull()
        part = docs.filter(inside) if bounds else docs
        out.append(index.add(part, batch=str(i), id_col=id_col, text_col=text_col, with_text=with_text, extra=extra, compact=i + 1 < len(bounds)))
    index.discard()
    return _union(out)


def cut_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts; a row whose words all go is dropped.

    The columns stay those of ``docs``; ``size_col``, where present, becomes
    the length of the new text.  Rows with equal ids are separate documents:
    the first of equal (id, text) rows keeps the text.
    """
    schema = docs.schema
    others = [f.name for f in schema if f.name not in (id_col, text_col, size_col)]
    held = docs.withColumn("_rest", F.struct(*[F.col(c) for c in others]) if others else F.lit(None).cast("string"))
    # the rest of a row travels beside its text through the index
    cut = deduplicate(held, window=window, gram=gram, id_col=id_col, text_col=text_col, extra="_rest")
    cut = cut.filter("n_words = 0 OR n_removed < n_words")
    out = []
    for f in schema:
        if f.name == id_col:
            c = F.col(id_col)
        elif f.name == text_col:
            c = F.col("text")
        elif f.name == size_col:
            c = F.length("text")
        else:
            c = F.col("_rest")[f.name]
        out.append(c.cast(f.dataType).alias(f.name))
    return cut.select(*out)
