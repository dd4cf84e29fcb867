"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens; pieces are
packed whole into sequences of that capacity.  Per bin, a bitset subset-sum
dynamic programme over the lengths still available finds the fullest feasible
combination, which is then removed.  The programme sees only a histogram of
lengths (at most ``capacity`` counts, whatever the corpus), and a combination
is removed as many times at once as the histogram allows, so planning cost
does not depend on the number of documents.

Data flow: one Arrow pass tokenizes and writes a scratch table in which every
first piece has a running index among those of its length in its partition;
counts by (partition, length) give each piece a rank among all pieces of its
length; the plan maps ranks to slots.  Only (partition, length) counts are
shuffled, never tokens, and a length that a third of all documents share is
ranked a partition at a time.

Defined cases: NULL and empty texts are one piece (the end token alone);
repeated rows and NULL ids are packed a row at a time; ids of any type pass
through; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import materialize
from sparkloom.llm.textops import batches

#: Texts of only these characters are cut into words alike by both tokenizer libraries.
_PLAIN = re.compile(r"[\t\n\x20-\x7e¡-¬®-ſ]*")


def bpe_encoder(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """ids as ``tokenizers`` gives them for ``json_path``.

    With ``ranks_path`` (the same vocabulary as ranks) texts of plain Latin
    characters without a special token's marks take the faster ``tiktoken``;
    all others take ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    fast = None
    if ranks_path:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if fast is not None and "<|" not in t and _PLAIN.fullmatch(t):
                out[i] = np.array(fast.encode_ordinary(t), dtype=np.uint32)
            else:
                rest.append(i)
        for i in rest:
            out[i] = np.array(slow.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out

    return encode


def _fullest(left: dict[int, int], room: int, taken: int) -> list[tuple[int, int]]:
    """Lengths and copies with the largest sum of at most ``room``; ``taken`` has one copy less.

    reach[i] has bit s set if the first i lengths can sum to s.  Among equally
    full combinations the one with the longest lengths is taken.
    """
    have = {n: c - (n == taken) for n, c in left.items()}
    lengths = sorted(n for n, c in have.items() if c and n <= room)
    mask, seen, reach = (1 << (room + 1)) - 1, 1, [1]
    for n in lengths:
        c, k = min(have[n], room // n), 1
        while c > 0:  # copies in powers of two
            take = min(k, c)
            seen |= (seen << (n * take)) & mask
            c, k = c - take, k * 2
        reach.append(seen)
    target, combo = seen.bit_length() - 1, []
    for i in range(len(lengths) - 1, -1, -1):
        n = lengths[i]
        t = next(t for t in range(min(have[n], target // n), -1, -1) if (reach[i] >> (target - t * n)) & 1)
        if t:
            combo.append((n, t))
            target -= t * n
    return combo


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum-bin-slack plan: (times, [(length, copies)]) a combination.

    counts[L] is the number of pieces of length L, 0 < L <= capacity.  The
    longest piece left opens a bin; the fullest feasible combination with it
    is removed, as often as the counts allow.
    """
    left = {int(n): int(counts[n]) for n in np.flatnonzero(counts) if n > 0}
    plan = []
    while left:
        longest = max(left)
        combo = {longest: 1}
        for n, t in _fullest(left, capacity - longest, longest):
            combo[n] = combo.get(n, 0) + t
        times = min(left[n] // t for n, t in combo.items())
        for n, t in combo.items():
            left[n] -= times * t
            if not left[n]:
                del left[n]
        plan.append((times, sorted(combo.items(), reverse=True)))
    return plan


class Slots:
    """Where the r-th piece of a length goes: arrays sorted by (length, first rank)."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = {}
        rows, bin_id = [], 0
        for times, combo in plan:
            offset = 0
            for n, t in combo:
                first = used.get(n, 0)
                rows.append((n, first, bin_id, t, offset))
                used[n] = first + times * t
                offset += n * t
            bin_id += times
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.length, self.first, self.bin, self.copies, self.offset = table.T
        self.n_bins = bin_id

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) for pieces of these lengths and ranks."""
        where = np.empty(len(rank), dtype=np.int64)
        for n in np.unique(length):
            own = length == n
            lo, hi = np.searchsorted(self.length, [n, n + 1])
            where[own] = lo + np.searchsorted(self.first[lo:hi], rank[own], side="right") - 1
        inside = rank - self.first[where]
        return self.bin[where] + inside // self.copies[where], self.offset[where] + inside % self.copies[where] * length


def tokenize(docs: DataFrame, encoder: Callable, *, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scratch table of token ids with running indexes.

    part: input partition; head: length of the first piece; nth: its index
    among this partition's pieces of that length; nth_full: index of the
    second piece among this partition's pieces of full length; ids:
    little-endian uint32.
    """
    from pyspark import TaskContext

    def run(it):
        encode = encoder()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in it:
            for lo, hi, texts in batches(batch, "text"):
                piece = batch.slice(lo, hi - lo)
                ids = [np.append(x, np.uint32(end_id)) for x in encode([t.decode() for t in texts])]
                n = [len(x) for x in ids]
                head = [(x - 1) % capacity + 1 for x in n]
                nth, nth_full = [], []
                for x, h in zip(n, head, strict=True):
                    nth.append(seen[h])
                    seen[h] += 1
                    nth_full.append(seen[capacity])
                    seen[capacity] += (x - h) // capacity
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(n), pa.int32()), piece.column(0), pa.array(n, pa.int64()), pa.array(head, pa.int32()),
                        pa.array(nth, pa.int64()), pa.array(nth_full, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    ],
                    names=["part", "id", "n", "head", "nth", "nth_full", "ids"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType().add("part", "integer").add("id", rows.schema["id"].dataType).add("n", "long").add("head", "integer").add("nth", "long").add("nth_full", "long").add("ids", "binary")
    out = rows.mapInArrow(run, schema)
    return materialize(out, "tokens", compression="zstd")


def _pieces(tokens: DataFrame, capacity: int) -> DataFrame:
    """One row a piece; its index among the pieces of its length in its partition is ``local``."""
    last = ((F.col("n") - F.col("head")) / capacity).cast("int")
    p = tokens.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece") == 0
    return p.withColumns(
        {
            "start": F.when(first, F.lit(0).cast("long")).otherwise(F.col("head") + (F.col("piece") - 1).cast("long") * capacity),
            "length": F.when(first, F.col("head")).otherwise(F.lit(capacity)),
            "local": F.when(first, F.col("nth")).otherwise(F.col("nth_full") + F.col("piece") - 1),
        }
    )


def pack(
    docs: DataFrame, encoder: Callable, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """Pieces with their places: id, piece, start, length, ids_crc32,
    sequence_id, offset, and ids (little-endian uint32) if asked for.

    Documents of more than ``capacity`` tokens are cut; the first piece takes
    the remainder, the others are full and each is a sequence of its own.
    ``encoder`` is a function without arguments that returns an encoder; it is
    called once a task.
    """
    tokens = tokenize(docs, encoder, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    here = _pieces(tokens.drop("ids"), capacity).groupBy("part", "length").agg(F.count(F.lit(1)).alias("n_here"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in here.groupBy("length").agg(F.sum("n_here").alias("c")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["c"]
    slots = docs.sparkSession.sparkContext.broadcast(Slots(plan_bins(counts, capacity)))  # some integers a combination
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = here.select("part", "length", F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("base"))

    def place(it):
        for batch in it:
            at = batch.schema.get_field_index
            length = batch.column(at("length")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            seq, off = slots.value.find(length, batch.column(at("rank")).to_numpy(zero_copy_only=False))
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in keep), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*keep, "sequence_id", "offset"])

    ids = F.expr("substring(ids, int(start * 4) + 1, length * 4)")
    light = _pieces(tokens, capacity).select("part", "id", "piece", "start", "length", "local", ids.alias("ids"), F.crc32(ids).alias("ids_crc32"))
    placed = light.join(base, ["part", "length"]).select(
        "id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *(["ids"] if with_ids else []), (F.col("base") + F.col("local")).alias("rank")
    )
    schema = T.StructType([f for f in placed.schema if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    return placed.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (little-endian uint32)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(  # at most `capacity` pieces a sequence
        "sequence_id", F.expr("aggregate(p.length, 0L, (a, x) -> a + x)").alias("n_tokens"), F.expr("aggregate(p.ids, X'', (a, x) -> concat(a, x))").alias("ids")
    )
