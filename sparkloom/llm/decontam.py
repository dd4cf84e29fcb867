"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are normalised word windows of benchmark items, written as bytes with
one space before, between and after words.  A block of bytes at the end of the
search position indexes a shift table: a block that ends no pattern prefix
skips ahead; a zero shift selects a bucket of patterns by that suffix block,
narrowed by the pattern's first bytes, and direct comparison confirms.  Many
cursors advance through a batch in lockstep, so the loop runs in numpy.

The benchmark is handled in blocks of bounded bytes (``block_bytes``).  One
block at a time is sent out, and every task builds its matcher once and passes
its documents by it; with several blocks the documents are written out between
passes together with what was found so far.  So neither the driver's nor the
executors' memory grows with the benchmark, and no shuffle is needed.

Defined cases: NULL and empty texts have no words and are clean; NULL items
have no windows; repeated items and repeated rows each count on their own
(equal item_ids are listed once); NULL item_ids are listed as the empty
string; an empty benchmark leaves everything clean.  Only the named id and
text columns are read, and further columns of ``docs`` pass through
``drop_contaminated`` unchanged.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import drop_scratch, materialize
from sparkloom.llm.textops import batches

#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, a-z and all beyond ASCII.
NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Pattern lengths are grouped at these floors so that one short item does not spoil the shifts of all.
LENGTH_CLASSES = (32, 16, 8, 3)
TABLE_BITS = 18
CURSORS = 4096


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(text: bytes, n: int) -> list[bytes]:
    """Normalised windows of n words; fewer words, but not none, are one window."""
    w = words_of(text)
    if not w:
        return []
    return [b" " + b" ".join(w[i : i + n]) + b" " for i in range(max(1, len(w) - n + 1))]


class WuManber:
    """Positions of byte patterns, all of at least ``m`` bytes, in a buffer."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        size = 1 << TABLE_BITS
        self.shift = np.full(size, self.m - self.block + 1, dtype=np.int64)
        self.buckets: dict[int, dict[bytes, list[bytes]]] = defaultdict(lambda: defaultdict(list))
        self.head = min(8, self.m)
        ends = np.arange(self.block, self.m + 1)
        for p in patterns:
            codes = self._codes(np.frombuffer(p, dtype=np.uint8)[: self.m], ends)
            np.minimum.at(self.shift, codes, self.m - ends)
            self.buckets[int(codes[-1])][p[: self.head]].append(p)

    def _codes(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table index of the block that ends before each position."""
        v = np.zeros(len(ends), dtype=np.uint64)
        for j in range(self.block):
            v = (v << np.uint64(8)) | data[ends - self.block + j]
        return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, raw: bytes) -> list[tuple[int, bytes]]:
        """(start, pattern) of every occurrence, in no fixed order."""
        n = len(raw)
        if n < self.m:
            return []
        data = np.frombuffer(raw, dtype=np.uint8)
        # cursor i looks at window ends in [first[i], last[i])
        edges = np.linspace(self.m, n + 1, min(CURSORS, n - self.m + 1) + 1).astype(np.int64)
        at, last = edges[:-1].copy(), edges[1:]
        found = []
        while len(at):
            codes = self._codes(data, at)
            step = self.shift[codes]
            zero = np.flatnonzero(step == 0)
            for i in zero:
                start = int(at[i]) - self.m
                for p in self.buckets[int(codes[i])].get(raw[start : start + self.head], ()):
                    if raw.startswith(p, start):
                        found.append((start, p))
            at += np.maximum(step, 1)
            live = at < last
            if not live.all():
                at, last = at[live], last[live]
        return found


class Matcher:
    """One block of items: searches all its length classes."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.owners: dict[bytes, set[str]] = defaultdict(set)
        for item_id, text in items:
            for p in windows_of(text, n):
                self.owners[p].add(item_id)
        classes: dict[int, list[bytes]] = defaultdict(list)
        for p in self.owners:
            classes[next(f for f in LENGTH_CLASSES if len(p) >= f)].append(p)
        self.searchers = [WuManber(ps) for ps in classes.values()]

    def search(self, raw: bytes) -> list[tuple[int, bytes]]:
        return [x for s in self.searchers for x in s.search(raw)]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in runs of bounded bytes, streamed a partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.filter("t IS NOT NULL").toLocalIterator():
        raw = r.t.encode()
        block.append((r.i, raw))
        size += len(raw) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _sent(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """(a block, packed small, on all executors; whether it is the last); at least one, each gone when the next comes."""
    sc, blocks = benchmark.sparkSession.sparkContext, item_blocks(benchmark, item_col, text_col, block_bytes)
    block = next(blocks, [])
    while block is not None:
        after = next(blocks, None)
        sent = sc.broadcast(zlib.compress(pickle.dumps(block), 1))
        yield sent, after is None
        if after is not None:
            sent.unpersist()
        block = after


def _matcher(block: Broadcast, window: int) -> Matcher:
    return Matcher(pickle.loads(zlib.decompress(block.value)), window)


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = 4 << 20) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, item_ids (sorted) and the
    word spans hit (merged, end excluded)."""
    rows = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    found = T.StructType().add("item_ids", T.ArrayType(T.StringType())).add("spans", SPANS)
    kind = rows.schema["row_key"].dataType
    held = None
    for block, last in _sent(benchmark, item_col, "text", block_bytes):
        schema = T.StructType().add("row_key", kind)
        if last:
            for c in ("n_words", "n_hit", "n_items"):
                schema.add(c, "long")
        else:
            schema.add("text", "string")
        out = rows.mapInArrow(_pass(block, window, last), T.StructType([*schema, *found]))
        if last:
            return out.withColumnRenamed("row_key", id_col)
        before, held = held, materialize(out, "scanned")
        if before is not None:
            drop_scratch(before)
        rows = held
    raise AssertionError("not reached")


def _pass(block: Broadcast, window: int, last: bool):
    """Adds what one block's items find to rows (row_key, text, and of earlier passes item_ids, spans)."""

    def run(it):
        m = _matcher(block, window)
        for batch in it:
            earlier = [batch.column(i) for i in (2, 3)] if batch.num_columns > 2 else None
            for lo, hi, texts in batches(batch, "text", 1 << 22):
                split = [words_of(t) for t in texts]
                hits: dict[int, tuple[list, set]] = {}
                if earlier:
                    for d, (items, spans) in enumerate(zip(earlier[0].slice(lo, hi - lo).to_pylist(), earlier[1].slice(lo, hi - lo).to_pylist(), strict=True)):
                        if items:
                            hits[d] = ([(x["start"], x["end"], True) for x in spans], set(items))
                _collect(m, [b" " + b" ".join(w) + b" " if w else b"" for w in split], hits)
                done = _rows(batch.column(0).slice(lo, hi - lo), np.array([len(w) for w in split], dtype=np.int64), hits)
                if not last:
                    done = pa.RecordBatch.from_arrays([done.column(0), batch.column(1).slice(lo, hi - lo), done.column(4), done.column(5)], names=["row_key", "text", "item_ids", "spans"])
                yield done

    return run


def _collect(m: Matcher, norm: list[bytes], hits: dict[int, tuple[list, set]]) -> None:
    raw = b"\0".join(norm)
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in norm])))
    found = m.search(raw)
    if not found:
        return
    at = np.array([s for s, _ in found], dtype=np.int64)
    owner = np.searchsorted(starts, at, side="right") - 1
    for (s, p), d in zip(found, owner.tolist(), strict=True):
        spans, items = hits.setdefault(d, ([], set()))
        spans.append((s - int(starts[d]), p.count(b" ") - 1))
        items.update(m.owners[p])
    for d in set(owner.tolist()):  # byte offsets to word indexes, once a document
        spans, _ = hits[d]
        spaces = np.flatnonzero(np.frombuffer(norm[d], dtype=np.uint8) == 32)
        todo = [(j, x) for j, x in enumerate(spans) if len(x) == 2]
        first = np.searchsorted(spaces, [x[0] for _, x in todo])
        for (j, (_, k)), w in zip(todo, first.tolist(), strict=True):
            spans[j] = (w, w + k, True)


def _rows(ids: pa.Array, counts: np.ndarray, hits: dict[int, tuple[list, set]]) -> pa.RecordBatch:
    n = len(counts)
    n_hit, items, spans = np.zeros(n, dtype=np.int64), [[]] * n, [[]] * n
    for d, (found, names) in hits.items():
        merged: list[list[int]] = []
        for a, b, _ in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        n_hit[d] = sum(b - a for a, b in merged)
        items[d] = sorted(names)
        spans[d] = [{"start": a, "end": b} for a, b in merged]
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
            pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ],
        names=["row_key", "n_words", "n_hit", "n_items", "item_ids", "spans"],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without the rows whose text holds any benchmark window."""
    at, schema, held = docs.columns.index(text_col), docs.schema, None

    def clean(block):
        def run(it):
            m = _matcher(block, window)
            for batch in it:
                keep = np.ones(batch.num_rows, dtype=bool)
                named = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
                for lo, _, values in batches(named, "text", 1 << 22):
                    norm = [b" " + b" ".join(w) + b" " if (w := words_of(t)) else b"" for t in values]
                    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in norm])))
                    if found := m.search(b"\0".join(norm)):
                        keep[lo + np.searchsorted(starts, [s for s, _ in found], side="right") - 1] = False
                yield batch.filter(pa.array(keep))

        return run

    for block, last in _sent(benchmark, "item_id", "text", block_bytes):
        docs = docs.mapInArrow(clean(block), schema)
        if not last:
            before, held = held, materialize(docs, "clean")
            docs = held
            if before is not None:
                drop_scratch(before)
    return docs
