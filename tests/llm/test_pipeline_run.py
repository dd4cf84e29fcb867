"""The whole chain against brute force, given the fitted quality model; odd rows and columns; an empty table."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import corpus, lower, plain_words
from pyspark.sql import functions as F

from sparkloom.llm import quality, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def write(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def shingles(text):
    w = plain_words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def kept(rows, model, items):
    """(doc_id, text) after quality, one of each component, passages cut, leaks dropped."""
    rows = sorted((d, t or "") for (d, t), s in zip(rows, model.score([(t or "").encode() for _, t in rows]), strict=True) if s >= 0.3)
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    rows = [r for i, r in enumerate(rows) if label[i] == i or not sets[i]]
    seen, cut = set(), []
    for d, t in rows:
        w = plain_words(t)
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            if x in seen:
                gone[i : i + 20] = True
            seen.add(x)
        if not len(w) or not gone.all():
            cut.append((d, [x for x, g in zip(w, gone) if not g]))
    windows = set()
    for _, t in items:
        w = WORD.findall(lower(t or ""))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    out = []
    for d, w in cut:
        norm = WORD.findall(lower(" ".join(w)))
        if not any(tuple(norm[i : i + len(p)]) == p for p in windows for i in range(len(norm) - len(p) + 1)):
            out.append((d, w))
    return out


def test_whole_chain(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(d, t) for d, t, *_ in corpus(31, 70)]
    rows += [(900 + i, " ".join(["#|$"] * (20 + i))) for i in range(20)]
    rows.append((999, rows[3][1]))
    text = next(t for _, t in rows if t and len(t.split()) > 50)
    items = [("i", " ".join(text.split()[4:24])), ("n", None), ("s", "nowhere")]
    docs = spark.createDataFrame([(d, t, "en", "x", len(t or ""), 1) for d, t in rows], "doc_id long, text string, lang string, `a-b c` string, n_chars int, k long")
    labels = [(d, int(not (t or "#").startswith("#")), 0) for d, t in rows]
    write(spark, str(tmp_path), docs, labels, items)
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", "quality"))
    want = kept(rows, model, items)
    assert 10 < len(want) < len(rows) - 20
    at = docs
    for i, (name, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        out.write.parquet(str(tmp_path / f"stage{i}"))
        at = spark.read.parquet(str(tmp_path / f"stage{i}"))
    left = at.collect()
    assert sorted((r.doc_id, tuple(plain_words(r.text))) for r in left) == sorted((d, tuple(w)) for d, w in want)
    assert all(r.n_chars == len(r.text or "") and r["a-b c"] == "x" for r in left)
    encode, pieces = queries.public_encoder(), Counter()
    for r in left:
        ids = [*encode([r.text or ""])[0].tolist(), 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        pieces.update((r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = p.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    odd = [(None, None), (1, "a b c"), (1, "a b c"), (None, ""), (2, "x " * 3000), (None, "a b c")]
    docs = spark.createDataFrame([(d, t, None) for d, t in odd], "doc_id long, text string, id string")
    write(spark, f"{tmp_path}/odd", docs, [(None, 1, 0), (1, None, 0)], [("i", None)])
    got = p.run(spark, f"{tmp_path}/odd").collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter({None: 3, 2: 1})
    write(spark, f"{tmp_path}/empty", docs.filter(F.lit(False)), [], [])
    assert p.run(spark, f"{tmp_path}/empty").count() == 0
