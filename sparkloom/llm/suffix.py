"""Substring deduplication with suffix arrays and longest-previous-factor arrays.

Texts are UTF-8 bytes; a string of ``depth`` bytes that starts in more than
one place is a repetition.  Whole-corpus suffix sorting is cut into parts that
cannot miss a match: every ``depth``-byte string selects an anchor, the
smallest hash among its ``gram``-byte pieces, so equal strings select equal
anchors at equal offsets.  Consecutive strings with one anchor form a segment;
only segments whose anchor occurs elsewhere travel, equal segments collapse
into one row before the shuffle, and the distinct segments of some anchors
together are one small text whose suffix array (prefix doubling up to
``depth``) and longest-previous-factor array are built in one task.

Previous and next smaller positions in suffix order give each suffix its
longest earlier match.  ``keep="first"`` removes later copies and keeps the
first; ``keep="none"`` also removes the place that the earlier match points to.

An anchor with more than ``max_group`` distinct segments (a passage's edge in
very many documents) is split by more context before its arrays are built: its
strings are dealt by the anchor's offset within them, in ranges of ``SPLITS``
offsets, and by all bytes that the strings of a range have in common, so equal
strings stay together and equal pieces collapse.  With ranges of one offset a
group is one string, so every group comes to fit.  A group of a single segment
needs no array: strings of one segment have their anchor at different offsets.
Exact copies of a whole text are found by digest first.  Anchors that a task
meets very often are dealt over all buckets by a salt.

A document receives the ranges of its candidate strings that stay; all other
candidates are repetitions.  So no pairs are formed and no group is collected.

Defined cases: NULL and empty texts have no bytes; texts shorter than
``depth`` lose nothing; matches never cross documents; rows with equal or NULL
ids are separate documents ordered by (id, text), NULL first; overlapping
matches within one document count; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Places, bounded_broadcast, bucketed, buckets, dealt, drop_scratch, exact_copies, id_of, keyed, materialize
from sparkloom.llm.textops import CODES, Often, anchors, batches, grams, signed

DEPTH, GRAM = 200, 40
SPLITS = (32, 6, 1)  # anchor offsets that the strings of a split group share
CHUNK = 1 << 20  # bytes of text hashed at once


# -- suffix arrays ---------------------------------------------------------


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), dtype=np.uint32)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))).astype(np.uint32)
    return rank


def prefix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """[(length, rank of every position by its next ``length`` bytes)], lengths doubling up to ``depth``.

    The text is followed by zero bytes; depth is at least 8.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 8, dtype=np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    out = [(8, _dense(key))]
    while out[-1][0] < depth:
        length, rank = out[-1]
        step = min(length, depth - length)  # the last round overlaps to end at depth exactly
        right = np.zeros(n, dtype=np.uint64)
        right[: max(0, n - step)] = rank[step:].astype(np.uint64) + np.uint64(1)
        out.append((length + step, _dense((rank.astype(np.uint64) << np.uint64(32)) | right)))
    return out


def _smaller(position: np.ndarray, way: int) -> np.ndarray:
    """Index of the previous (way -1) or next (+1) entry with a smaller value, -1 or n without one.

    Pointer jumping: everything strictly between an entry and its pointer is larger.
    """
    n = len(position)
    pointer = np.arange(n) + way
    todo = np.arange(n)
    while len(todo):
        p = pointer[todo]
        todo = todo[(p >= 0) & (p < n)]
        todo = todo[position[pointer[todo]] > position[todo]]
        pointer[todo] = pointer[pointer[todo]]
    return pointer


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (ascending) the length, up to ``depth``, of the longest match with
    an earlier start, and the index of that earlier start (-1 for none)."""
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    levels = prefix_ranks(data, depth)
    full = levels[-1][1]
    order = np.lexsort((starts, full[starts]))  # suffix order of the starts by their first depth bytes
    n = len(order)
    lpf, source = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for way in (-1, 1):
        near = _smaller(order, way)
        has = np.flatnonzero((near >= 0) & (near < n))
        mine, other = order[has], order[near[has]]
        length = _common(data, levels, starts[mine], starts[other], depth)
        better = length > lpf[mine]
        lpf[mine[better]], source[mine[better]] = length[better], other[better]
    return lpf, source


def _common(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``depth``."""
    full = levels[-1][1]
    out = np.where(full[a] == full[b], depth, 0)
    rest = np.flatnonzero(out == 0)
    a, b, got = a[rest].copy(), b[rest].copy(), np.zeros(len(rest), dtype=np.int64)
    n = len(data)
    for length, rank in levels[-2::-1]:
        ok = (a + got < n) & (b + got < n)
        at = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        got += np.where(ok & (rank[at[0]] == rank[at[1]]), length, 0)
    for _ in range(8):
        ok = (a + got < n) & (b + got < n)
        at = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        going = ok & (data[at[0]] == data[at[1]])
        if not going.any():
            break
        got += going
        a, b = np.where(going, a, n), b  # a stopped one stays stopped
    out[rest] = np.minimum(got, depth)
    return out


# -- segments --------------------------------------------------------------


class Strings:
    """The depth-byte strings of a run of texts and the anchor that each selects."""

    def __init__(self, texts: list[bytes], depth: int, gram: int):
        self.raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.start = np.concatenate(([0], np.cumsum(sizes + 1)))
        end_of = np.repeat(self.start[1:] - 1, sizes + 1)
        self.gram = grams(CODES[self.data], gram)
        inside = np.arange(len(self.gram)) + gram <= end_of[: len(self.gram)]
        chosen = anchors(self.gram, inside, depth - gram + 1)
        at = np.arange(len(chosen))
        ok = at + depth <= end_of[: len(chosen)]
        self.at, self.anchor = at[ok], chosen[ok]
        # segments: runs of strings with one anchor
        self.cut = np.flatnonzero(np.diff(self.anchor, prepend=-1)) if len(self.anchor) else np.empty(0, dtype=np.int64)
        self.seg_at, self.seg_anchor = self.at[self.cut], self.anchor[self.cut]
        self.seg_n = np.diff(np.append(self.cut, len(self.at)))
        self.seg_owner = np.searchsorted(self.start, self.seg_at, side="right") - 1
        self.seg_hash = signed(self.gram[self.seg_anchor])

    def shared(self, lists: list) -> np.ndarray:
        """Indexes of the segments whose anchor these documents share with other places."""
        known = np.unique(np.concatenate([x for x in lists if len(x)] or [np.empty(0, np.int64)]))
        return np.flatnonzero(np.isin(self.seg_hash, known))


def _lists(column: pa.Array) -> list:
    column = column.fill_null([])
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _anchor_rows(base: DataFrame, depth: int, gram: int, salts: int, hot_from: int) -> DataFrame:
    """(h, k, n, salt): the anchors of every document, how many places select each, and a salt for hot ones."""

    def run(it):
        often = Often(salts, hot_from)
        for batch in it:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, texts in batches(batch, "text", CHUNK):
                s = Strings(texts, depth, gram)
                order = np.lexsort((s.seg_hash, s.seg_owner))
                h, owner = s.seg_hash[order], s.seg_owner[order]
                cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))) if len(h) else order
                n = np.diff(np.append(cut, len(h)))
                h, key = h[cut], k[lo + owner[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), pa.array(n.astype(np.int32)), pa.array(often.salt(h, key))], names=["h", "k", "n", "salt"])

    return base.select("k", "text").mapInArrow(run, "h long, k long, n int, salt int")


def _nominees(base: DataFrame, depth: int, gram: int, hot_from: int) -> tuple[DataFrame, DataFrame]:
    """((k, hs): the anchors that each document shares with other places; the scratch table it reads)."""
    rows = _anchor_rows(base, depth, gram, buckets(base.sparkSession), hot_from)
    rows = bucketed(rows.select(dealt("h", "salt").alias("part"), F.when(F.col("salt") >= 0, F.col("h")).alias("hot"), "k", "n"), "part", "anchors")
    plain = rows.filter("hot IS NULL")
    counts = plain.groupBy("part").agg(F.sum("n").alias("n"))
    hot = rows.filter("hot IS NOT NULL").select(F.col("hot").alias("part")).distinct()  # few, as each occurs very often
    found = plain.join(counts.filter("n > 1"), "part", "left_semi").unionByName(plain.join(counts.filter("n = 1").join(hot, "part", "left_semi"), "part", "left_semi"))
    found = found.select("k", F.col("part").alias("h")).unionByName(rows.filter("hot IS NOT NULL").select("k", F.col("hot").alias("h")))
    return found.groupBy("k").agg(F.collect_list("h").alias("hs")), rows


def _segments(nominated: DataFrame, depth: int, gram: int) -> DataFrame:
    """(h, off, seg, k, at): the segments around shared anchors; off: the anchor's place in seg."""

    def run(it):
        for batch in it:
            k, lists = batch.column(0).to_numpy(zero_copy_only=False), _lists(batch.column(2))
            for lo, hi, texts in batches(batch, "text", CHUNK):
                s = Strings(texts, depth, gram)
                pick = s.shared(lists[lo:hi])
                at, n, owner = s.seg_at[pick], s.seg_n[pick], s.seg_owner[pick]
                segs = [s.raw[a : a + m + depth - 1] for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.seg_hash[pick]), pa.array((s.seg_anchor[pick] - at).astype(np.int32)), pa.array(segs, pa.binary()),
                        pa.array(k[lo + owner]), pa.array((at - s.start[owner]).astype(np.int32)),
                    ],
                    names=["h", "off", "seg", "k", "at"],
                )

    return nominated.select("k", "text", "hs").mapInArrow(run, "h long, off int, seg binary, k long, at int")


def _stay(segs: list[bytes], many: np.ndarray, depth: int, keep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of strings that stay: (segment, first, end) with string numbers within the segment.

    Segments come in the order of their earliest places; ``many``: whether a
    segment occurs in several places.
    """
    data = np.frombuffer(b"".join(segs), dtype=np.uint8)
    size = np.fromiter(map(len, segs), dtype=np.int64, count=len(segs))
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    n = size - depth + 1
    owner = np.repeat(np.arange(len(segs)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    lpf, source = longest_previous_factor(data, first[owner] + inner, depth)
    gone = lpf >= depth
    if keep == "none":
        gone[source[gone]] = True
        gone |= many[owner]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (~gone).astype(np.int8), [0]))) != 0)
    # split runs of staying strings at segment borders
    border = np.cumsum(n)[:-1]
    inside = border[(~gone[np.maximum(border - 1, 0)]) & (~gone[np.minimum(border, len(gone) - 1)])] if len(border) else border
    ups, downs = np.sort(np.concatenate([edge[::2], inside])), np.sort(np.concatenate([edge[1::2], inside]))
    return owner[ups], inner[ups], inner[downs - 1] + 1 if len(downs) else downs


def _suffix_sorted(grouped: DataFrame, places: Places, depth: int, keep: str, part_bytes: int) -> DataFrame:
    """(k, lo, hi): strings that stay, from suffix arrays over batches of whole anchor groups."""

    def run(it):
        rows: list[tuple] = []
        size = 0

        def flush():
            rows.sort(key=lambda r: (r[3], r[4]))
            seg, lo, hi = _stay([r[1] for r in rows], np.array([r[2] > 1 for r in rows]), depth, keep)
            k, at = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array(k[seg], pa.int64()), pa.array((at[seg] + lo).astype(np.int32)), pa.array((at[seg] + hi).astype(np.int32))], names=["k", "lo", "hi"]
            )

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= part_bytes and row[0] != rows[-1][0]:
                    yield flush()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
        if rows:
            yield flush()

    cols = grouped.select("h", "seg", "n", places.k("new").alias("k"), places.at("new").alias("at"))
    return cols.repartition("h").sortWithinPartitions("h").mapInArrow(run, "k long, lo int, hi int")


def _split(hot: DataFrame, places: Places, depth: int, width: int) -> DataFrame:
    """Pieces of segments, grouped by ``width`` offsets of the anchor and the bytes that all strings of the piece share."""
    last = F.length("seg") - depth  # number of the last string; string i has its anchor at off - i
    ranges = F.sequence(F.floor((F.col("off") - last) / width).cast("int"), F.floor(F.col("off") / width).cast("int"))
    p = hot.select("h", "off", "seg", "n", places.k("new").alias("k"), places.at("new").alias("at"), last.alias("last"), F.explode(ranges).alias("r"))
    p = p.withColumn("lo", F.greatest(F.lit(0), F.col("off") - ((F.col("r") + 1) * width - 1))).withColumn("hi", F.least("last", F.col("off") - F.col("r") * width))
    common = F.expr(f"substring(seg, off - r * {width} + 1, {depth - width + 1})")
    p = p.select(
        F.xxhash64("h", "r", common).alias("h"), (F.col("off") - F.col("lo")).alias("off"), F.expr(f"substring(seg, lo + 1, hi - lo + {depth})").alias("seg"), "n", "k", (F.col("at") + F.col("lo")).alias("at")
    )
    return p.withColumn("new", places.code("k", "at")).groupBy("h", "off", "seg").agg(F.sum("n").alias("n"), F.min("new").alias("new"))


def _staying(segs: DataFrame, places: Places, depth: int, keep: str, max_group: int, part_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """((k, lo, hi): ranges of strings that stay; scratch tables) of distinct segments (h, off, seg, n, new)."""
    out, held = None, []
    for width in (*(w for w in SPLITS if w < depth), None):
        groups = materialize(segs.groupBy("h").agg(F.count(F.lit(1)).alias("distinct")).filter("distinct > 1"), "groups")
        large = materialize(groups.filter(F.col("distinct") > max_group).select("h"), "large")
        held += [groups, large]
        any_large = width is not None and bool(large.limit(1).count())
        rest = segs.join(bounded_broadcast(large), "h", "left_anti") if any_large else segs
        alone = rest.join(groups, "h", "left_anti").filter(F.lit(True) if keep == "first" else F.col("n") == 1)
        stay = alone.select(places.k("new").alias("k"), places.at("new").alias("lo"), (places.at("new") + F.length("seg") - (depth - 1)).alias("hi"))
        stay = stay.unionByName(_suffix_sorted(rest.join(groups, "h", "left_semi"), places, depth, keep, part_bytes))
        out = stay if out is None else out.unionByName(stay)
        if not any_large:
            return out, held
        segs = materialize(_split(segs.join(bounded_broadcast(large), "h", "left_semi"), places, depth, width), "pieces", compression="zstd")
        held.append(segs)
    raise AssertionError("not reached")


def deduplicate(
    docs: DataFrame, *, depth: int = DEPTH, gram: int = GRAM, keep: str = "first", id_col: str = "doc_id", text_col: str = "text",
    max_group: int = 8192, part_bytes: int = 1 << 20, with_text: bool = True, hot_from: int = 64,
) -> DataFrame:
    """Removals: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the
    removed byte spans (end excluded) and the remaining bytes as text."""
    if keep not in ("first", "none") or depth < max(16, gram):
        raise ValueError("keep is 'first' or 'none'; depth is at least 16 and the gram")
    base = keyed(docs, id_col, text_col)
    lists, anchor_rows = _nominees(base, depth, gram, hot_from)
    copies = exact_copies(base)
    meta = materialize(lists.join(copies.select("k", (F.col("first") < F.col("k")).alias("later")), "k", "full_outer"), "nominees")
    drop_scratch(anchor_rows, copies)
    places = Places(base)
    nominated = base.join(meta, "k").filter("hs IS NOT NULL AND NOT coalesce(later, false)")
    segs = _segments(nominated, depth, gram).withColumn("new", places.code("k", "at"))
    segs = segs.groupBy("h", "off", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("new").alias("new"))
    segs = materialize(segs, "segments", compression="zstd")
    stay, held = _staying(segs, places, depth, keep, max_group, part_bytes)
    stay = stay.groupBy("k").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    whole = F.col("later").isNotNull() if keep == "none" else F.coalesce("later", F.lit(False))
    rows = base.join(meta, "k", "left").join(stay, "k", "left").select(id_of(base).alias("id"), "text", "hs", whole.alias("whole"), "lo", "hi")

    def run(it):
        for batch in it:
            hs, los, his = _lists(batch.column(2)), _lists(batch.column(4)), _lists(batch.column(5))
            whole = batch.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, texts in batches(batch, "text", CHUNK):
                yield _removed(texts, batch.column(0).slice(lo, hi - lo), hs[lo:hi], whole[lo:hi], los[lo:hi], his[lo:hi], depth, gram, with_text)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<struct<start: int, end: int>>, text string" * with_text
    out = materialize(rows.mapInArrow(run, schema), "removals")
    drop_scratch(meta, segs, *held, base)
    return out.withColumnRenamed("id", id_col)


def _removed(texts, ids, hs, whole, los, his, depth: int, gram: int, with_text: bool) -> pa.RecordBatch:
    s = Strings(texts, depth, gram)
    edge = np.zeros(len(s.data) + 1, dtype=np.int32)
    pick = s.shared(hs)
    owner_whole = np.asarray(whole, dtype=bool)[s.seg_owner[pick]]
    pick = pick[~owner_whole]
    np.add.at(edge, s.seg_at[pick], 1)
    np.add.at(edge, s.seg_at[pick] + s.seg_n[pick], -1)
    drop = [(int(s.start[i]), a, b) for i, (a, b) in enumerate(zip(los, his, strict=True)) if len(a) and not whole[i]]
    if drop:
        a, b = np.concatenate([o + x for o, x, _ in drop]), np.concatenate([o + y for o, _, y in drop])
        np.add.at(edge, a, -1)
        np.add.at(edge, b, 1)
    gone = np.cumsum(edge)[:-1] > 0  # strings that are repetitions
    for i in np.flatnonzero(whole):
        gone[s.start[i] : max(s.start[i], s.start[i + 1] - depth)] = True
    edge = np.zeros(len(s.data) + depth + 1, dtype=np.int32)
    at = np.flatnonzero(gone)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + depth, -1)
    covered = np.cumsum(edge)[: len(s.data)] > 0
    step = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    ups, downs = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.searchsorted(ups, s.start)
    digests, kept, spans, n_removed = [], [], [], []
    for i, t in enumerate(texts):
        o = int(s.start[i])
        own = [(int(u) - o, int(d) - o) for u, d in zip(ups[first[i] : first[i + 1]], downs[first[i] : first[i + 1]], strict=True)]
        cut, pieces = 0, []
        for u, d in own:
            pieces.append(t[cut:u])
            cut = d
        rest = b"".join([*pieces, t[cut:]]) if own else t
        digests.append(hashlib.sha256(rest).hexdigest())
        n_removed.append(len(t) - len(rest))
        if with_text:
            kept.append(rest.decode("utf-8", "replace"))
            spans.append([{"start": u, "end": d} for u, d in own])
    columns = [
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(digests, pa.string()),
    ]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        columns += [pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())]
        names += ["spans", "text"]
    return pa.RecordBatch.from_arrays(columns, names=names)
