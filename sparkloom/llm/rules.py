"""Quality rules as learned decision lists.  [native]

Statistics of each text are SQL expressions; sequential covering on labelled
statistics grows threshold conjunctions by information gain, prunes them on
held-back rows, and emits the ordered rules as one Spark conditional
expression.  Scoring runs no Python.

The list is fitted on at most ``max_rows`` labelled rows (those with the
smallest hash of their id), which the driver reads as a table of numbers; all
documents are scored.

Defined cases: NULL and empty texts have no words and fail the base rules;
documents without a label, NULL labels and NULL ids are scored but not learned
from; repeated rows are judged alike; without usable labels the list is empty
and everything that passes the base rules is kept; further columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import fold

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _removed(chars: str) -> Column:
    """Characters of ``text`` among ``chars``."""
    return F.length("text") - F.length(F.translate("text", chars, ""))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Word, symbol and repetition counts of whole texts, all longs.

    n_repeat_words sorts (hash of a 3-word window, position) pairs packed in
    one long: the low bits hold the position, as many as the text's number of
    words needs, the rest the hash; windows of equal hash become neighbours.
    Those that have such a neighbour are then sorted by their three words
    themselves, so equal content decides and a hash only nominates.  The work
    is n log n in the words of a text and nothing is exploded.
    """
    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(SPACES))
    d = d.withColumn("w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    n = F.size("w")
    d = d.withColumns({"bits": F.ceil(F.log2(n + F.lit(2))).cast("int"), "n_words": n.cast("long")})
    window = "shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), bits) | i"
    d = d.withColumn("s", F.expr(f"CASE WHEN n_words < 3 THEN array() ELSE sort_array(transform(sequence(0, int(n_words) - 3), i -> {window})) END"))
    same = "(x >> bits) = (get(s, i + {0}) >> bits)"
    d = d.withColumn("s", F.expr(f"filter(s, (x, i) -> (i > 0 AND {same.format(-1)}) OR coalesce({same.format(1)}, false))"))
    spelt = "named_struct('x', concat_ws(' ', get(w, p), get(w, p + 1), get(w, p + 2)), 'p', p)"
    d = d.withColumn("s", F.expr(f"sort_array(transform(transform(s, x -> int(x & (shiftleft(1L, bits) - 1))), p -> {spelt}))"))
    d = d.withColumn("s", F.expr("filter(s, (x, i) -> (i > 0 AND x.x = get(s, i - 1).x) OR coalesce(x.x = get(s, i + 1).x, false))"))
    d = d.withColumn("s", F.expr("sort_array(transform(s, x -> bigint(x.p)))"))
    return d.select(
        *keep,
        "n_words",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _removed(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(s, (p, i) -> least(3L, coalesce(get(s, i + 1) - p, 3L))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _removed("!?").cast("long").alias("n_marks"),
    )


#: Features of the rules: shares of the counts above, each 0 where its base is 0.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def features() -> dict[str, Column]:
    return {k: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) for k, (a, b) in FEATURES.items()} | {"n_words": F.col("n_words").cast("double")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, cols: dict[str, Column]) -> Column:
        c = cols[self.feature]
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int, steps: int) -> list[Condition]:
    """Conditions added one by one, each of the largest FOIL gain over all thresholds tried."""
    rule, inside = [], np.ones(len(bad), dtype=bool)
    while len(rule) < max_conditions and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            cuts = np.unique(np.quantile(np.concatenate([v, v[y]]), np.linspace(0, 1, steps)))
            order = np.argsort(v, kind="stable")
            pos = np.concatenate([[0], np.cumsum(y[order])])
            below = np.searchsorted(v[order], cuts, side="left")
            for above in (True, False):
                p = p0 - pos[below] if above else pos[below]
                n = (len(v) - below if above else below) - p
                ok = p > 0
                gain = np.where(ok, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, above, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, steps: int = 200) -> list[list[Condition]]:
    """Ordered rules for bad rows: grow on two thirds, prune on the rest, remove what a rule covers."""
    part = np.arange(len(bad)) % 3
    rules, left = [], np.ones(len(bad), dtype=bool)
    while len(rules) < max_rules:
        g, h = left & (part != 0), left & (part == 0)
        if bad[g].sum() < 5 or not (~bad[g]).any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], max_conditions, steps)
        hx, hy = {k: v[h] for k, v in x.items()}, bad[h]

        def worth(r, hx=hx, hy=hy):
            c = _covers(r, hx, len(hy))
            p, n = hy[c].sum(), (~hy[c]).sum()
            return ((p - n) / (p + n) if p + n else -1.0, -len(r))

        candidates = [rule[:i] for i in range(1, len(rule) + 1)]
        if not candidates:
            break
        rule = max(candidates, key=worth)
        c = _covers(rule, x, len(bad)) & left
        if not c.any() or bad[c].mean() < min_precision or not bad[c & h].any():
            break
        rules.append(rule)
        left &= ~c
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5, max_rows: int = 20000) -> DataFrame:
    """At most ``max_rows`` documents with label 0 or 1 outside fold 0, chosen by hash of the id."""
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
    chosen = chosen.select(id_col, F.col(label_col).alias("_label")).orderBy(F.xxhash64(id_col), id_col, "_label").limit(max_rows)
    return docs.join(F.broadcast(chosen), id_col)  # max_rows bounds what is broadcast


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20000, **options) -> list[list[Condition]]:
    """The ordered rules that mark bad documents."""
    stats = statistics(labelled_sample(docs.select("doc_id", "text"), labels, max_rows=max_rows), keep=("doc_id", "_label"))
    rows = stats.select("doc_id", "_label", *[c.alias(f"f_{k}") for k, c in features().items()]).toPandas().sort_values(["doc_id", "_label"])
    x = {k: rows[f"f_{k}"].to_numpy(dtype=float) for k in features()}
    return learn(x, (rows["_label"] == 0).to_numpy(), **options)


def verdict(rules: list[list[Condition]]) -> Column:
    """CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true END."""
    cols = features()
    out = None
    for rule in rules:
        c = rule[0].column(cols)
        for x in rule[1:]:
            c = c & x.column(cols)
        out = F.when(c, False) if out is None else out.when(c, False)
    return F.lit(True) if out is None else out.otherwise(True)


def score(docs: DataFrame, rules: list[list[Condition]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed and kept of every document."""
    s = statistics(docs, text_col, (id_col,))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
