"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is a node with two states, good and bad.  Its
observation is its own shape (shares of symbols, capitals, marks, digits,
repeated words, ...) and that of the lines before and after it.  Exact
forward-backward gives every line's marginal of being good; the mean of the
marginals, weighted by line length, is the document's raw quality, and a
logistic curve fitted on the training sample turns it into a score.

Labels are of documents, so in training the lines' labels are hidden: given
them, a document is good with odds exp(AGREE * (2 * good share of length - 1)),
and the model maximises the probability of the documents' labels, summed over
all labellings of their lines.  As the share is a sum over lines, that takes one
forward-backward pass for either label, and lines of one document may disagree:
a junk line in a good document is bad.  The sample is at most ``max_rows``
labelled documents (smallest hash of the id); every document is scored whole,
in its input partition, without a shuffle.

Defined cases: NULL, empty and blank texts have no lines and score the
training share of good documents; unlabelled documents, NULL labels and NULL
ids are scored but not learned from; repeated rows score alike; without usable
labels of both kinds every document scores the share of good ones (0.5
without any); labels, ids and further columns are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import drop_scratch, fold, materialize
from sparkloom.llm.textops import BASES, CODES, Words, batches, prefix, spans

#: Byte classes whose share of a line's non-space bytes is a feature.
CLASSES = (b"#*$%&<>", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789", b".,;:")
_LUT = np.zeros((len(CLASSES), 256), dtype=np.uint8)
for _k, _c in enumerate(CLASSES):
    _LUT[_k, list(_c)] = 1
N_OWN = len(CLASSES) + 5
AGREE = 6.0


@dataclass
class Lines:
    """Lines with a word, of a run of texts: owner text, weight (non-space bytes), features."""

    owner: np.ndarray
    weight: np.ndarray
    own: np.ndarray
    n_texts: int

    def observations(self) -> np.ndarray:
        """Own features, those of the line before and after (0 beyond the text), and a bias."""
        n = len(self.owner)
        before, after = np.zeros_like(self.own), np.zeros_like(self.own)
        if n > 1:
            same = (self.owner[1:] == self.owner[:-1])[:, None]
            before[1:] = self.own[:-1] * same
            after[:-1] = self.own[1:] * same
        return np.concatenate([self.own, before, after, np.ones((n, 1))], axis=1)


def line_features(texts: list[bytes]) -> Lines:
    words = Words(texts, lower=False)
    data = words.data
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first = np.searchsorted(words.start, starts)  # words of a line: [first, last)
    last = np.searchsorted(words.start, ends)
    keep = last > first
    starts, ends, first, last = starts[keep], ends[keep], first[keep], last[keep]
    owner = np.searchsorted(words.text_start, starts, side="right") - 1
    n = len(starts)
    if not n:
        return Lines(owner, np.zeros(0), np.zeros((0, N_OWN)), len(texts))
    width = np.concatenate(([0], np.cumsum(words.end - words.start)))
    size = (width[last] - width[first]).astype(float)
    n_words = (last - first).astype(float)
    own = np.empty((n, N_OWN))
    for k in range(len(CLASSES)):
        total = np.concatenate(([0], np.cumsum(_LUT[k][data], dtype=np.int64)))
        own[:, k] = (total[ends] - total[starts]) / size
    j = len(CLASSES)
    own[:, j] = np.minimum(size / n_words, 30.0)
    own[:, j + 1] = np.log1p(n_words)
    again = np.zeros(len(words.hash) + 1)
    again[2:] = np.cumsum(words.hash[1:] == words.hash[:-1])
    own[:, j + 2] = np.where(n_words > 1, (again[last] - again[np.minimum(first + 1, last)]) / np.maximum(n_words - 1, 1), 0)
    pre = prefix(CODES[data], BASES[0])
    h = spans(pre, starts, ends, BASES[0])
    order = np.lexsort((np.arange(n), h, owner))
    repeat = np.zeros(n)
    repeat[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    own[:, j + 3] = repeat
    own[:, j + 4] = np.log1p(size)
    return Lines(owner, size, own, len(texts))


def _padded(lengths: np.ndarray) -> list[np.ndarray]:
    """Groups of sequences whose lengths share a power of two."""
    if not len(lengths):
        return []
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    return [np.flatnonzero(bucket == b) for b in np.unique(bucket)]


def forward_backward(unary: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, and of each sequence expected transition counts and log partition.

    unary: score of state 1 against state 0 for the nodes of all sequences one
    after another; trans: 2 x 2 log potentials.
    """
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    marginal, pairs, log_z = np.empty(len(unary)), np.zeros((len(lengths), 2, 2)), np.zeros(len(lengths))
    t = np.exp(trans)
    for group in _padded(lengths):
        size, m = lengths[group], int(lengths[group].max())
        at = np.minimum(first[group][:, None] + np.arange(m), len(unary) - 1)
        real = np.arange(m) < size[:, None]
        u = np.where(real, unary[at], 0.0)
        top = np.maximum(u, 0)
        emit = np.stack([np.exp(-top), np.exp(u - top)], axis=2)
        alpha, beta, scale = np.empty_like(emit), np.empty_like(emit), np.ones((len(group), m))
        a = emit[:, 0]
        for i in range(m):
            if i:
                a = np.where(real[:, i, None], (a @ t) * emit[:, i], a)
            c = a.sum(axis=1)
            a = a / c[:, None]
            scale[:, i], alpha[:, i] = np.where(real[:, i], c, 1.0), a
        b = np.ones((len(group), 2))
        for i in range(m - 1, -1, -1):
            beta[:, i] = b
            if i:
                nxt = (b * emit[:, i]) @ t.T / scale[:, i, None]
                b = np.where(real[:, i, None], nxt, b)
        p = alpha * beta
        marginal[at[real]] = (p[:, :, 1] / p.sum(axis=2))[real]
        if m > 1:
            both = real[:, 1:]
            right = (emit * beta)[:, 1:] / scale[:, 1:, None]
            pairs[group] = np.einsum("nij,nik,ni->njk", alpha[:, :-1], right, both.astype(float)) * t
        log_z[group] = np.log(scale).sum(axis=1) + (top * real).sum(axis=1)
    return marginal, pairs, log_z


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]
    prior: float

    def marginals(self, lines: Lines) -> np.ndarray:
        x = np.clip((lines.observations() - self.mean) / self.scale, -8, 8)
        lengths = np.bincount(lines.owner, minlength=lines.n_texts)
        return forward_backward(x @ self.weights, self.trans, lengths[lengths > 0])[0]

    def raw(self, lines: Lines, marginals: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal a text; NaN without lines."""
        total = np.bincount(lines.owner, lines.weight, minlength=lines.n_texts)
        good = np.bincount(lines.owner, lines.weight * marginals, minlength=lines.n_texts)
        return np.divide(good, total, out=np.full(lines.n_texts, np.nan), where=total > 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        lines = line_features(texts)
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        return np.nan_to_num(_curve(self.raw(lines, self.marginals(lines)), self.curve), nan=self.prior)


def _curve(raw: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    r = np.clip(raw, 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(curve[0] + curve[1] * np.log(r / (1 - r)))))


def train(lines: Lines, label: np.ndarray, *, max_lines: int = 200, steps: int = 120, rate: float = 0.1, l2: float = 1e-3, l2_near: float = 0.2) -> Model:
    """Maximum likelihood (Adam) of the texts' labels, those of their lines being hidden.

    A long text is learned from as several chains of at most ``max_lines`` lines.
    What a line's neighbours tell (their features, the transitions) is held back
    by ``l2_near``, a line's own shape by ``l2`` alone, so that a line which differs
    from its neighbours can be told apart.
    """
    prior = float(label.mean()) if len(label) else 0.5
    own = lines.observations()
    n_nodes = len(own)
    if not n_nodes or label.min() == label.max():
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((2, 2)), (0.0, 1.0), prior)
    mean, scale = own.mean(axis=0), own.std(axis=0)
    mean[-1], scale[-1] = 0.0, 1.0
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.clip((own - mean) / scale, -8, 8)
    place = np.arange(n_nodes) - np.searchsorted(lines.owner, lines.owner)
    chain = np.cumsum(place % max_lines == 0) - 1
    lengths = np.bincount(chain)
    y = label[lines.owner[np.concatenate(([0], np.cumsum(lengths)[:-1]))]].astype(float)  # of each chain
    pull = AGREE * 2 * lines.weight / np.bincount(chain, lines.weight)[chain]
    theta = np.zeros(x.shape[1] + 4)
    decay = np.full(len(theta), l2_near)
    decay[:N_OWN] = decay[x.shape[1] - 1] = l2  # own features and the bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        u, trans = x @ theta[:-4], theta[-4:].reshape(2, 2)
        good, good_pairs, good_z = forward_backward(u + pull / 2, trans, lengths)
        bad, bad_pairs, bad_z = forward_backward(u - pull / 2, trans, lengths)
        p = 1 / (1 + np.exp(np.clip(bad_z - good_z + AGREE, -500, 500)))  # of a good label
        off = p - y
        grad = np.concatenate([x.T @ ((good - bad) * off[chain]), np.einsum("n,nij->ij", off, good_pairs - bad_pairs).ravel()]) / len(lengths) + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(mean, scale, theta[:-4].copy(), theta[-4:].reshape(2, 2).copy(), (0.0, 1.0), prior)
    raw = model.raw(lines, model.marginals(lines))
    ok = ~np.isnan(raw)
    model.curve = _fit_curve(raw[ok], label[ok].astype(float))
    return model


def _fit_curve(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of the label on the raw quality's logit (Newton, ridged)."""
    r = np.clip(raw, 1e-4, 1 - 1e-4)
    x = np.stack([np.ones_like(r), np.log(r / (1 - r))], axis=1)
    w = np.array([0.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * (w - [0.0, 1.0])), -1, 1)
    return float(w[0]), max(float(w[1]), 0.05)  # higher raw quality never scores lower


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, max_rows: int = 4000, max_lines: int = 200) -> Model:
    """A model from all lines of at most ``max_rows`` labelled documents outside fold 0.

    If they have more than ``max_rows * max_lines`` lines together, the longest
    give a run of consecutive lines each, from where the hash of the id says, of
    the one length that keeps to that number.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
    chosen = chosen.select(id_col, F.col(label_col).cast("int").alias("_label")).orderBy(F.xxhash64(id_col), id_col, "_label").limit(max_rows)
    sample = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)  # at most max_rows

    def run(it):
        for batch in it:
            for lo, hi, texts in batches(batch, "text"):
                lines = line_features(texts)
                n = np.bincount(lines.owner, minlength=len(texts))
                cut = np.concatenate(([0], np.cumsum(n)))
                rows = [np.column_stack([lines.weight[a:b], lines.own[a:b]]).astype("<f8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], names=["id", "label", "n", "lines"])

    got = materialize(sample.select(F.col(id_col).cast("string"), "text", "_label").mapInArrow(run, "id string, label int, n long, lines binary"), "lines")
    most = longest_run(np.array([r["n"] for r in got.select("n").collect()], dtype=np.int64), max_rows * max_lines)
    size = (N_OWN + 1) * 8
    start = F.crc32(F.col("id").cast("binary")) % F.greatest(F.col("n") - most + 1, F.lit(1))
    rows = got.select("id", "label", F.substring("lines", (start * size + 1).cast("int"), F.lit(most * size)).alias("lines")).collect()
    drop_scratch(got)
    rows.sort(key=lambda r: (r["id"], r["label"], bytes(r["lines"])))
    tables = [np.frombuffer(bytes(r["lines"]), dtype="<f8").reshape(-1, N_OWN + 1) for r in rows]
    flat = np.concatenate(tables) if tables else np.zeros((0, N_OWN + 1))
    owner = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    return train(Lines(owner, flat[:, 0], flat[:, 1:], len(tables)), np.array([r["label"] for r in rows]), max_lines=max_lines)


def longest_run(sizes: np.ndarray, budget: int) -> int:
    """The largest m with ``sum(min(size, m)) <= budget``; at most the largest size."""
    lo, hi = 0, int(sizes.max(initial=0))
    while lo < hi:
        m = (lo + hi + 1) // 2
        lo, hi = (m, hi) if np.minimum(sizes, m).sum() <= budget else (lo, m - 1)
    return lo


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some dozens of numbers

    def run(it):
        for batch in it:
            for lo, hi, texts in batches(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(texts))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType().add("id", rows.schema["id"].dataType).add("score", "double")).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(it):
        for batch in it:
            named = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            keep = [shared.value.score(texts) >= threshold for _, _, texts in batches(named, "text")]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
