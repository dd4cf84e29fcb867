"""Language-model scores from Brown class-based bigrams.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)), over lower-cased words
with an end token after each text (which also stands before its first word).

1. Word counts of all training texts, aggregated by word: a table that grows
   with the corpus and is stored in buckets by word.
2. All texts are coded once, in chunks of some MB: a word is a rank in a cache
   of the most frequent words (at most ``cache_words``, held in memory), else an
   index into the chunk's own list of other words.  What belongs to those words
   (count, class) is joined by word and reaches the chunk as one list.  The
   cache spares the join most tokens and decides nothing: the model is the same
   for any size of it.
3. Exchange clustering one word at a time on the bigrams of the ``seeds`` most
   frequent words, a matrix of fixed size, gives the first classes.
4. Exchange rounds over every word that occurs twice or more, whatever the
   vocabulary: from counts of the classes of all its neighbours in all training
   texts each word moves to the class that raises the likelihood most while the
   others stay, all at once.  Words not classed yet and words seen once count as
   one class, so no word is without evidence.
5. Class-transition counts over all training texts, smoothed towards class
   frequencies; emissions are relative frequencies.  The rare class holds the
   words seen once; in it one unknown word has the share that leaving each
   training token out in turn gives it.  So the model is a proper distribution
   over the vocabulary and one unknown, like the base score's.

Defined cases: NULL and empty texts are the end token alone; rows with equal
or NULL ids are scored a row at a time (a NULL id's fold is that of the empty
text); an empty training set gives every word the unknown word's share; an
empty table gives no rows; further columns are not read.  Words are identified
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bucketed, buckets, drop_scratch, id_of, keyed, materialize, release
from sparkloom.llm.textops import Words, batches, signed

END = np.uint64(0x5DEECE66D1234567)
RUN = 1 << 20  # bytes of text hashed at once
CHUNK = 1 << 22  # bytes of text in a coded chunk
DENSE = 1 << 14  # ranks whose neighbours are counted in one array
LIMIT = 1 << 19  # distinct codes that a task gathers before it emits them


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each text, and each text's first index (one more for the end)."""
    w = Words(texts, lower=True)
    first = w.first + np.arange(len(w.first))
    return np.insert(w.hash, w.first[1:], END), first


class Lookup:
    """Word hash -> rank by count (0 the most frequent), -1 for words not in the cache.

    Two direct-address tables on different hash bits hold nearly all words;
    what collides in both is found by binary search.
    """

    BITS = 21

    def __init__(self, words: np.ndarray):
        self.words = words  # uint64, most frequent first
        self.tables, rest = [], np.arange(len(words))
        for shift in (0, self.BITS):
            table = np.full(1 << self.BITS, -1, dtype=np.int32)
            slot = self._slot(words[rest], shift)
            table[slot[::-1]] = rest[::-1]  # the more frequent word keeps a slot
            self.tables.append((shift, table))
            rest = rest[table[slot] != rest]
        order = np.argsort(words[rest])
        self.rest, self.rest_words = rest[order], words[rest][order]

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), -1, dtype=np.int32)
        out = np.full(len(h), -1, dtype=np.int32)
        todo = np.arange(len(h))
        for shift, table in self.tables:
            got = table[self._slot(h[todo], shift)]
            ok = (got >= 0) & (self.words[got] == h[todo])
            out[todo[ok]] = got[ok]
            todo = todo[~ok]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest_words, h[todo]), len(self.rest) - 1)
            ok = self.rest_words[at] == h[todo]
            out[todo[ok]] = self.rest[at[ok]]
        return out


class Tally:
    """Counts of int64 codes, equal ones summed whenever many have gathered."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self.codes, self.counts, self.held = limit, [], [], 0

    def _merge(self) -> None:
        u, inverse = np.unique(np.concatenate(self.codes), return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate(self.counts), minlength=len(u)).astype(np.int64)
        self.codes, self.counts, self.held = [u], [c], len(u)

    def add(self, codes: np.ndarray) -> bool:
        """Whether it is time to empty it."""
        u, c = np.unique(codes, return_counts=True)
        self.codes.append(u)
        self.counts.append(c)
        self.held += len(u)
        if self.held > 2 * self.limit:
            self._merge()
        return self.held > self.limit and len(self.codes) == 1

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, counts), codes ascending; nothing is left."""
        if not self.codes:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self._merge()
        out = self.codes[0], self.counts[0]
        self.codes, self.counts, self.held = [], [], 0
        return out


def count_words(train: DataFrame) -> DataFrame:
    """(w, c): occurrences of every word, and of END, in ``train`` (text)."""

    def run(it):
        tally = Tally()
        for batch in it:
            for _, _, texts in batches(batch, "text", RUN):
                if tally.add(signed(tokens_of(texts)[0])):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in tally.empty()], names=["w", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in tally.empty()], names=["w", "c"])

    return train.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


# -- coded texts -----------------------------------------------------------

CODED = "chunk long, k array<long>, id array<long>, learn array<boolean>, n binary, codes binary, open array<long>"


def code_texts(base: DataFrame, lookup) -> DataFrame:
    """Chunks of ``base`` (k, id, learn, text) as word codes.

    n: tokens of each text; codes: -1 the end token, a rank in the cache, or
    -2 - j for the j-th word in ``open``, the chunk's sorted list of others.
    """

    def run(it):
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def chunk():
            nonlocal seq
            tokens, n = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            codes = lookup.value.ranks(tokens)
            codes[tokens == END] = -1
            other = np.flatnonzero((codes < 0) & (tokens != END))
            words, j = np.unique(tokens[other], return_inverse=True)
            codes[other] = -2 - j
            rows = pa.concat_arrays([x[0] for x in held])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), rows.field(c)) for c in ("k", "id", "learn")]
            out = [pa.array([(part << 32) + seq], pa.int64()), *lists, pa.array([n.astype("<i4").tobytes()], pa.binary()), pa.array([codes.astype("<i4").tobytes()], pa.binary())]
            out.append(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(signed(words))))
            seq += 1
            return pa.RecordBatch.from_arrays(out, names=["chunk", "k", "id", "learn", "n", "codes", "open"])

        for batch in it:
            keys = pa.StructArray.from_arrays([batch.column(i) for i in range(3)], names=["k", "id", "learn"])
            for lo, hi, texts in batches(batch, "text", RUN):
                tokens, first = tokens_of(texts)
                held.append((keys.slice(lo, hi - lo), tokens, np.diff(first)))
                size += sum(map(len, texts))
                if size >= CHUNK:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    return base.select("k", "id", "learn", "text").mapInArrow(run, CODED)


def _with_lists(coded: DataFrame, rows: DataFrame) -> DataFrame:
    """``coded`` with ``known``: what ``rows`` (chunk, code) holds of each chunk's other words."""
    return coded.join(rows.groupBy("chunk").agg(F.collect_list("code").alias("known")), "chunk", "left")


def _packed(c: Column | str) -> Column:
    """Count, index and class of another word in one long."""
    return F.shiftleft(F.col(c) if isinstance(c, str) else c, 32).bitwiseOR(F.shiftleft(F.col("j").cast("long"), 8)).bitwiseOR(F.col("cls")).alias("code")


@dataclass
class Chunk:
    """A row of coded texts: codes and classes of all its tokens, and what is known of its other words."""

    rows: pa.RecordBatch
    n: np.ndarray
    codes: np.ndarray
    cls: np.ndarray
    open_words: np.ndarray
    open_counts: np.ndarray  # 0: not in the training texts, or not asked for


def _chunks(it, classes: np.ndarray, end: int, rare: int, training: bool) -> Iterator[Chunk]:
    """The chunks of coded rows with ``known``; only the training texts if asked for."""
    for batch in it:
        at = batch.schema.get_field_index
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            n = np.frombuffer(row.column(at("n"))[0].as_py(), "<i4").astype(np.int64)
            codes = np.frombuffer(row.column(at("codes"))[0].as_py(), "<i4")
            if training:
                learn = row.column(at("learn"))[0].values.to_numpy(zero_copy_only=False).astype(bool)
                codes = codes[np.repeat(learn, n)]
            words = row.column(at("open"))[0].values.to_numpy(zero_copy_only=False)
            known = row.column(at("known")).fill_null([])[0].values.to_numpy(zero_copy_only=False)
            counts, own = np.zeros(len(words), dtype=np.int64), np.full(len(words), rare)
            j = (known >> 8) & 0xFFFFFF
            counts[j], own[j] = known >> 32, known & 0xFF
            cls = classes[np.maximum(codes, 0)].astype(np.int64) if len(classes) else np.full(len(codes), rare)
            cls[codes == -1] = end
            other = codes < -1
            cls[other] = own[-2 - codes[other]]
            yield Chunk(row, n, codes, cls, words, counts)


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table of bounded size as arrays, read in Arrow batches."""
    table = df.select(*names).toArrow()
    return [table.column(x).to_numpy() for x in names]


def _previous(x: np.ndarray, first: int) -> np.ndarray:
    return np.concatenate(([first], x[:-1])).astype(x.dtype)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: np.ndarray, movable: np.ndarray, n_classes: int, *, free: int, rounds: int = 8) -> np.ndarray:
    """Exchange clustering: move words one at a time among the first ``free`` classes.

    bigrams[v, w]: count of w after v.  The class of a word that is not
    movable stays.  Stops when a round moves fewer than one word in a hundred.
    """
    cls = classes.copy()
    member = np.zeros((len(cls), n_classes))
    member[np.arange(len(cls)), cls] = 1
    g = member.T @ bigrams @ member
    after, before = bigrams @ member, bigrams.T @ member  # counts of classes after / before each word
    frequency = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    for _ in range(rounds):
        moves = 0
        for w in np.argsort(-frequency, kind="stable"):
            if not movable[w] or not frequency[w]:
                continue
            a, self_pairs = cls[w], bigrams[w, w]
            s, p = after[w].copy(), before[w].copy()
            g[a] -= s
            g[:, a] -= p
            g[a, a] += self_pairs
            s[a] -= self_pairs
            p[a] -= self_pairs
            row, col = g.sum(axis=1) + p, g.sum(axis=0) + s  # the word's neighbours count wherever it goes
            by_row = _xlogx(g + s) - _xlogx(g)
            by_col = _xlogx(g + p[:, None]) - _xlogx(g)
            d = np.diagonal(g)
            gain = by_row.sum(axis=1) - np.diagonal(by_row) + by_col.sum(axis=0) - np.diagonal(by_col)
            gain += _xlogx(d + s + p + self_pairs) - _xlogx(d)
            gain -= _xlogx(row + s.sum() + self_pairs) - _xlogx(row) + _xlogx(col + p.sum() + self_pairs) - _xlogx(col)
            b = int(np.argmax(gain[:free]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b] += s
            g[:, b] += p
            g[b, b] += self_pairs
            if b != a:
                moves += 1
                cls[w] = b
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
                before[:, a] -= bigrams[w]
                before[:, b] += bigrams[w]
        if moves * 100 < movable.sum():
            break
    return cls


class Gains:
    """What moving a word to each of the first ``free`` classes adds to the likelihood of class bigrams ``g``."""

    SMALL = 8

    def __init__(self, g: np.ndarray, free: int):
        self.g, self.free = (g[:, :free], g.T[:, :free]), free  # by the side of the neighbour: before, after
        self.totals = g.sum(axis=0)[:free], g.sum(axis=1)[:free]
        n = np.arange(self.SMALL + 1)[:, None, None]
        self.table = np.stack([_xlogx(m + n) - _xlogx(m) for m in (x[None] for x in self.g)])  # side, n, neighbour, class

    def best(self, owner: np.ndarray, side: np.ndarray, near: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The best class for each of len(own) words on its own.

        A word's neighbours: ``c`` of class ``near`` before (side 0) or after it
        (side 1), rows sorted by ``owner``.  g holds the word in its class
        ``own``.  Pairs of a word with itself count as pairs with its class.
        Gains are compared to a millionth, so the order of sums decides nothing.
        """
        free = self.free
        gain = np.zeros((len(own), free))
        for lo in range(0, len(owner), 1 << 12):
            o, s, j, n = (x[lo : lo + (1 << 12)] for x in (owner, side, near, c))
            value = self.table[s, np.minimum(n, self.SMALL), j]
            big = np.flatnonzero(n > self.SMALL)
            m = np.where(s[big, None] == 0, self.g[0][j[big]], self.g[1][j[big]])
            value[big] = _xlogx(m + n[big, None]) - _xlogx(m)
            inside = np.flatnonzero(own[o] < free)  # in its own class the word's pairs are already counted
            mine = own[o[inside]]
            m = np.where(s[inside] == 0, self.g[0][j[inside], mine], self.g[1][j[inside], mine])
            without = np.maximum(m - n[inside], 0)
            value[inside, mine] = _xlogx(without + n[inside]) - _xlogx(without)
            at = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            gain[o[at]] += np.add.reduceat(value, at, axis=0)
        rows = np.arange(len(own))
        stay = np.minimum(own, free - 1)
        for x, total in enumerate(self.totals):
            n = np.bincount(owner, np.where(side == x, c, 0), len(own))[:, None]
            m = np.maximum(total - n * (own[:, None] == np.arange(free)), 0)
            gain -= _xlogx(m + n) - _xlogx(m)
        gain = np.round(gain, 6)
        best = gain.argmax(axis=1) if len(own) else own
        return np.where((own < free) & (gain[rows, best] <= gain[rows, stay]), own, best)


@dataclass
class Model:
    """Classes 0 .. C-1 are learned; C is the end token's, C + 1 that of unknown words and those seen once."""

    words: np.ndarray  # hashes of the cached words, most frequent first
    counts: np.ndarray
    classes: np.ndarray
    n_classes: int
    cut: int  # count from which words are in the cache
    n_train: int
    n_vocabulary: int
    n_ends: int
    transition: np.ndarray | None = None  # log10
    total: np.ndarray | None = None  # training tokens of each class's words seen twice or more
    rare_share: float = 0.0  # log10 share of a word seen once in the rare class
    unknown_share: float = 0.0  # log10 share of the unknown word in the rare class

    @property
    def rare(self) -> int:
        return self.n_classes + 1

    def emission(self, counts: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 share of words of these counts in their classes."""
        share = np.log10(np.maximum(counts, 1)) - np.log10(np.maximum(self.total[cls], 1))
        return np.where(counts > 1, share, np.where(counts == 1, self.rare_share, self.unknown_share))


def _smooth(pairs: np.ndarray, alpha: float) -> np.ndarray:
    """P(next | previous): counts with ``alpha`` more, dealt by the classes' own (add-one) frequencies."""
    one = pairs.sum(axis=0) + 1.0
    one /= one.sum()
    return (pairs + alpha * one) / (pairs.sum(axis=1, keepdims=True) + alpha)


def _cache(words: DataFrame, cache_words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, counts, least count) of the words seen twice or more down to a count that keeps to ``cache_words``."""
    level = F.floor(F.log2("c") * 16)  # some hundred levels of counts
    sizes = words.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("l")).collect()
    cut, n = 1 << 62, 0
    for r in sizes:
        n += r["n"]
        if n > cache_words or r["least"] < 2:
            break
        cut = r["least"]
    hashes, counts = (x.astype(np.int64) for x in _columns(words.filter(F.col("c") >= cut), "w", "c"))  # at most cache_words rows
    order = np.lexsort((hashes, -counts))
    return hashes[order].view(np.uint64), counts[order], cut


def _seed_classes(words: DataFrame, coded: DataFrame, model: Model, seeds: int) -> DataFrame:
    """(w, cls) of the ``seeds`` most frequent words, by exchange on their bigrams."""
    spark, width, end, rare = coded.sparkSession, model.n_classes + 2, model.n_classes, model.rare
    top = words.filter("c > 1").orderBy(F.desc("c"), "w").limit(seeds).collect()
    k = len(top)
    number = {int(r["w"]): i for i, r in enumerate(top)}
    cached = np.array([number.get(int(x), k) for x in signed(model.words[: 4 * seeds])] or [k])  # rank -> place among the seeds
    shared = spark.sparkContext.broadcast((number, cached))

    def run(it):
        number, cached = shared.value
        total = np.zeros((k + 2) * (k + 2), dtype=np.int64)
        for x in _chunks(it, np.empty(0), 0, 0, True):
            other = np.array([number.get(int(w), k) for w in x.open_words] if len(number) and len(cached) < 4 * seeds else [k] * len(x.open_words), dtype=np.int64)
            r = cached[np.clip(x.codes, 0, len(cached) - 1)]
            r[x.codes >= len(cached)] = k
            r[x.codes == -1] = k + 1
            at = x.codes < -1
            r[at] = other[-2 - x.codes[at]] if len(other) else k
            total += np.bincount(_previous(r, k + 1) * (k + 2) + r, minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "c"])

    rows = coded.withColumn("known", F.array().cast("array<long>")).mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    code, c = _columns(rows, "code", "c")  # at most (seeds + 2) squared
    shared.unpersist()
    bigrams = np.zeros((k + 2) * (k + 2))
    bigrams[code] = c
    start = np.append(np.arange(k) % max(1, model.n_classes), [rare, end])
    cls = exchange(bigrams.reshape(k + 2, k + 2), start, np.arange(k + 2) < k, width, free=model.n_classes)
    return spark.createDataFrame([(int(r["w"]), int(x)) for r, x in zip(top, cls[:k], strict=True)], "w long, cls long")


NEAR = "kind byte, w long, own byte, c long, around binary"


def _near(coded: DataFrame, model: Model, shared) -> DataFrame:
    """Rows (kind, w, own, c, around) of the training texts under the current classes.

    kind 0: ``c`` class bigrams of code ``w``.  kind 1 (cached) and 2: classes around
    the word ``w``, now of class ``own``: longs of (side * width + class) << 40 | count.
    """
    end, rare, width = model.n_classes, model.rare, model.n_classes + 2
    span = 2 * width

    def run(it):
        words, classes = shared.value
        dense = np.zeros(min(DENSE, len(words)) * span, dtype=np.int64)
        top = len(dense) // span
        pairs, tally = np.zeros(width * width, dtype=np.int64), Tally()

        def rows(kind, code, c, names, own):
            """One row a word from ascending codes."""
            word = code // span
            cut = np.flatnonzero(np.diff(word, prepend=-1))
            data = (((code % span) << 40) | c).astype("<i8")
            offsets = (np.append(cut, len(word)) * 8).astype("<i4")
            around = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            which = word[cut]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cut), kind, np.int8)), pa.array(names[which], pa.int64()), pa.array(own[which].astype(np.int8)), pa.array(np.zeros(len(cut), np.int64)), around],
                names=["kind", "w", "own", "c", "around"],
            )

        for x in _chunks(it, classes, end, rare, True):
            before, after = _previous(x.cls, end), np.append(x.cls[1:], end)
            pairs += np.bincount(before * width + x.cls, minlength=len(pairs))
            at = np.flatnonzero((x.codes >= 0) & (x.codes < top))
            r = x.codes[at].astype(np.int64) * span
            dense += np.bincount(np.concatenate([r + before[at], r + width + after[at]]), minlength=len(dense))
            at = np.flatnonzero(x.codes >= top)
            r = x.codes[at].astype(np.int64) * span
            if tally.add(np.concatenate([r + before[at], r + width + after[at]])):
                yield rows(1, *tally.empty(), signed(words), classes)
            j = -2 - x.codes.astype(np.int64)
            at = np.flatnonzero(j >= 0)
            at = at[x.open_counts[j[at]] > 1]
            if len(at):
                r = j[at] * span
                code, c = np.unique(np.concatenate([r + before[at], r + width + after[at]]), return_counts=True)
                own = np.full(len(x.open_words), rare)
                own[j[at]] = x.cls[at]
                yield rows(2, code, c, x.open_words, own)
        yield rows(1, *tally.empty(), signed(words), classes)
        code = np.flatnonzero(dense)
        yield rows(1, code, dense[code], signed(words), classes)
        code = np.flatnonzero(pairs)
        empty = pa.array([b""] * len(code), pa.binary())
        zeros = pa.array(np.zeros(len(code), np.int8))
        yield pa.RecordBatch.from_arrays([zeros, pa.array(code), zeros, pa.array(pairs[code]), empty], names=["kind", "w", "own", "c", "around"])

    return coded.mapInArrow(run, NEAR)


def _class_pairs(near: DataFrame, width: int) -> np.ndarray:
    code, c = _columns(near.filter("kind = 0").groupBy("w").agg(F.sum("c").alias("c")), "w", "c")  # at most width squared
    pairs = np.zeros(width * width)
    pairs[code] = c
    return pairs.reshape(width, width)


def _moves(near: DataFrame, pairs: np.ndarray, free: int) -> DataFrame:
    """(w, cls, cached): the next class of every word with neighbours."""
    span = 2 * len(pairs)

    def run(it):
        gains, held = Gains(pairs, free), None

        def moved(w, own, kind, owner, code, c):
            key, inverse = np.unique(owner * span + code, return_inverse=True)
            n = np.bincount(inverse, weights=c, minlength=len(key)).astype(np.int64)
            return key // span, key % span, n

        for batch in it:
            w, kind, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            if not len(w):
                continue
            col = batch.column(3)
            cut = np.frombuffer(col.buffers()[1], "<i4", col.offset + len(col) + 1)[col.offset :].astype(np.int64) // 8
            data = np.frombuffer(col.buffers()[2], "<i8", cut[-1])[cut[0] :]
            sizes = np.diff(cut)
            code, c = data >> 40, data & ((1 << 40) - 1)
            if held is not None:
                w, own, kind = (np.concatenate(([a], b)) for a, b in zip(held[:3], (w, own, kind), strict=True))
                sizes, code, c = np.concatenate(([len(held[3])], sizes)), np.concatenate([held[3], code]), np.concatenate([held[4], c])
            new = np.concatenate(([True], w[1:] != w[:-1]))
            first, number = np.flatnonzero(new), np.cumsum(new) - 1
            owner, code, c = moved(w, own, kind, np.repeat(number, sizes), code, c)
            last = owner == len(first) - 1  # its rows may go on in the next batch
            held = (w[first[-1]], own[first[-1]], kind[first[-1]], code[last], c[last])
            done = first[:-1]
            if len(done):
                keep = ~last
                best = gains.best(owner[keep], code[keep] // len(pairs), code[keep] % len(pairs), c[keep], own[done].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(w[done]), pa.array(best, pa.int64()), pa.array(kind[done] == 1)], names=["w", "cls", "cached"])
        if held is not None:
            best = gains.best(np.zeros(len(held[3]), np.int64), held[3] // len(pairs), held[3] % len(pairs), held[4], np.array([held[1]], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array(best, pa.int64()), pa.array([bool(held[2] == 1)])], names=["w", "cls", "cached"])

    n = buckets(near.sparkSession)
    rows = near.filter("kind > 0").select("w", "kind", "own", "around").repartition(n, "w").sortWithinPartitions("w")
    return rows.mapInArrow(run, "w long, cls long, cached boolean")


def fit(
    base: DataFrame, *, cache_words: int = 1 << 20, seeds: int = 1024, n_classes: int = 48, alpha: float = 20.0, rounds: int = 3
) -> tuple[Model, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Learn from the rows of ``base`` (k, id, learn, text) with ``learn``.

    Gives the model, the coded texts, the rows (w, chunk, j, c) of words outside
    the cache, the classes (w, cls) of all words seen twice or more, and the
    scratch tables that hold these.
    """
    if rounds < 1 or not 0 < n_classes < 126:
        raise ValueError("rounds is at least 1, n_classes less than 126")
    spark = base.sparkSession
    sc = spark.sparkContext
    counted = bucketed(count_words(base.filter("learn")), "w", "words")
    ends = F.col("w") == F.lit(int(END.astype(np.int64)))
    words = counted.filter(~ends)
    c = F.col("c")
    facts = counted.agg(
        *(F.coalesce(x, F.lit(0)) for x in (F.sum("c"), F.count(F.lit(1)), F.sum(F.when(ends, c)), F.sum(F.when(~ends & (c <= 2), c)), F.sum(F.when(~ends & (c == 1), 1))))
    ).first()
    hashes, counts, cut = _cache(words, cache_words)
    end, rare, width = n_classes, n_classes + 1, n_classes + 2
    model = Model(hashes, counts, np.full(len(hashes), rare, dtype=np.uint8), n_classes, cut, facts[0], facts[1], facts[2])
    lookup = sc.broadcast(Lookup(hashes))
    coded = bucketed(code_texts(base, lookup), "chunk", "coded", compression="zstd")
    lookup.unpersist()
    release(spark)
    opened = coded.select("chunk", F.posexplode("open").alias("j", "w"))
    other = bucketed(opened.join(words.filter(c < cut), "w").select("w", "chunk", "j", "c"), "w", "other")
    of_seeds = _seed_classes(words, coded, model, seeds)
    classes = bucketed(of_seeds, "w", "classes")
    rank = np.argsort(hashes.view(np.int64), kind="stable")
    shown = hashes.view(np.int64)[rank]
    scratch = [counted, coded, other]
    for _ in range(rounds + 1):
        found = classes if "cached" in classes.columns else classes.withColumn("cached", F.lit(True))
        w, cls = _columns(found.filter("cached"), "w", "cls")  # at most cache_words rows and the seeds
        at = np.minimum(np.searchsorted(shown, w), max(0, len(shown) - 1))
        ok = shown[at] == w if len(shown) else np.zeros(len(w), dtype=bool)
        model.classes = model.classes.copy()
        model.classes[rank[at[ok]]] = cls[ok]
        if _ == rounds:
            break
        shared = sc.broadcast((hashes, model.classes))
        lists = other.filter("c > 1").join(classes.select("w", "cls"), "w", "left").withColumn("cls", F.coalesce("cls", F.lit(rare).cast("long")))
        near = materialize(_near(_with_lists(coded, lists.select("chunk", _packed("c"))), model, shared), "near")
        pairs = _class_pairs(near, width)
        moved = bucketed(_moves(near, pairs, n_classes), "w", "classes", dealt=True)
        shared.unpersist()
        drop_scratch(near, classes)
        classes = moved
        release(spark)
    model.total = np.zeros(width)
    cls, n = _columns(classes.join(words, "w").groupBy("cls").agg(F.sum("c").alias("c")), "cls", "c")
    model.total[cls] = n
    model.total[end] = model.n_ends
    # left out, a word seen once is unknown, and one of two occurrences is rare
    low, once = facts[3], facts[4]
    unknown = (once + 1) / (low + 2) if low else 1.0
    model.unknown_share = float(np.log10(unknown)) if once else 0.0
    model.rare_share = float(np.log10((1 - unknown) / once)) if once else 0.0
    lists = other.join(classes.select("w", "cls"), "w", "left").withColumn("cls", F.coalesce("cls", F.lit(rare).cast("long")))
    known = materialize(lists.select("chunk", _packed("c")), "known")
    final = _with_lists(coded, known)
    shared = sc.broadcast((hashes, model.classes))
    model.transition = np.log10(_smooth(_transitions(final, model, shared), alpha))
    shared.unpersist()
    return model, final, classes, words, [*scratch, classes, known]


def _transitions(coded: DataFrame, model: Model, shared) -> np.ndarray:
    """Class bigrams of the training texts."""
    end, rare, width = model.n_classes, model.rare, model.n_classes + 2

    def run(it):
        pairs = np.zeros(width * width, dtype=np.int64)
        for x in _chunks(it, shared.value[1], end, rare, True):
            pairs += np.bincount(_previous(x.cls, end) * width + x.cls, minlength=len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs), np.int8)), pa.array(np.arange(len(pairs))), pa.array(pairs)], names=["kind", "w", "c"])

    return _class_pairs(coded.mapInArrow(run, "kind byte, w long, c long"), width)


def score(docs: DataFrame, train: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``train``: a condition on the id column for the texts to learn from (all
    by default).  base_score: add-one unigrams.  Both scores are log10
    probabilities of the whole text.
    """
    base = keyed(docs, id_col, text_col)
    learn = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    rows = base.withColumn(id_col, id_of(base)).select("k", F.col(id_col).alias("id"), learn.alias("learn"), "text")
    model, coded, _, _, scratch = fit(rows, **options)
    shared = base.sparkSession.sparkContext.broadcast(model)
    denominator = float(np.log10(model.n_train + model.n_vocabulary + 1))

    def run(it):
        m = shared.value
        end, rare = m.n_classes, m.rare
        for x in _chunks(it, m.classes, end, rare, False):
            counts = m.counts[np.maximum(x.codes, 0)] if len(m.counts) else np.zeros(len(x.codes), dtype=np.int64)
            other = x.codes < -1
            counts = np.where(other, 0, counts)
            counts[other] = x.open_counts[-2 - x.codes[other]]
            last = x.codes == -1
            counts[last] = m.n_ends
            value = m.transition[_previous(x.cls, end), x.cls] + np.where(last, 0.0, m.emission(counts, x.cls))
            owner = np.repeat(np.arange(len(x.n)), x.n)
            sums = [np.bincount(owner, y, len(x.n)) for y in (counts > 0, np.log10(counts + 1.0) - denominator, value)]
            at = x.rows.schema.get_field_index
            lists = [x.rows.column(at(c))[0].values for c in ("k", "id")]
            yield pa.RecordBatch.from_arrays(
                [lists[1], pa.array(x.n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(x.n), m.n_train)), pa.array(sums[1]), pa.array(sums[2])],
                names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    out = materialize(coded.mapInArrow(run, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scored")
    drop_scratch(*scratch)
    return out.withColumnRenamed("id", id_col)
