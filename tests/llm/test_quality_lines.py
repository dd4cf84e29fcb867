"""Long labelled documents count as much as short ones in the line model."""

import numpy as np
import pytest

from sparkloom.llm import quality


def test_longest_run():
    assert [quality.longest_run(np.array([3, 10, 7]), b) for b in (100, 20, 19, 9, 2)] == [10, 10, 9, 3, 0]
    assert quality.longest_run(np.empty(0, np.int64), 5) == 0


@pytest.mark.parametrize("max_rows", [4000, 24])  # all lines, or runs of 200 and fewer
def test_long_documents_are_learned_from(spark, max_rows):
    good = [(i, "\n".join(f"The quiet river number {j} runs to the sea." for j in range(5))) for i in range(40)]
    bad = [(100 + i, "\n".join(f"{j} {i} {j * 7} ## 0x{j:x}" for j in range(900))) for i in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, max_rows=max_rows)).collect()}
    assert min(s for i, s in scores.items() if i < 100) > 0.5 > max(s for i, s in scores.items() if i >= 100)


def test_lines_of_one_document_disagree():
    """Junk lines within good documents are bad, their neighbours good; line labels are never given."""
    r = np.random.default_rng(2)
    words = "the quiet river runs past old houses and a mill where people met on market days".split()

    def prose():
        return " ".join(r.choice(words, 12)).capitalize() + "."

    def junk():
        return " ".join(f"#{x:x}|{x}" for x in r.integers(0, 9999, 8))

    texts, label = [], []
    for i in range(300):
        good = i % 3 > 0
        lines = [prose() if (r.random() < 0.9) == good else junk() for _ in range(int(r.integers(4, 20)))]
        texts.append("\n".join(lines).encode())
        label.append(int(good))
    model = quality.train(quality.line_features(texts), np.array(label))
    hit = {True: [], False: []}
    for _ in range(60):
        at = int(r.integers(1, 9))
        lines = [prose() for _ in range(10)]
        lines[at] = junk()
        p = model.marginals(quality.line_features(["\n".join(lines).encode()]))
        hit[True].append(p[at] < 0.5)
        hit[False].append((np.delete(p, at) > 0.5).mean())
    assert np.mean(hit[True]) > 0.95 and np.mean(hit[False]) > 0.95
    assert np.mean((model.score(texts) >= 0.5) == np.array(label)) > 0.97


def test_gradient_is_that_of_the_label_probability():
    """One chain against all labellings of its lines."""
    r = np.random.default_rng(6)
    u, trans, w = r.normal(size=4), r.normal(size=(2, 2)), np.array([3.0, 1.0, 2.0, 4.0])
    total = {0: 0.0, 1: 0.0}
    for code in range(16):
        y = np.array([(code >> i) & 1 for i in range(4)])
        value = np.exp(u @ y + sum(trans[a, b] for a, b in zip(y, y[1:])))
        share = (w * y).sum() / w.sum()
        for d in (0, 1):
            total[d] += value * np.exp(quality.AGREE * (share if d else -share) - (quality.AGREE / 2 if d else -quality.AGREE / 2))
    pull = quality.AGREE * 2 * w / w.sum()
    z = [quality.forward_backward(u + s * pull / 2, trans, np.array([4]))[2][0] for s in (1, -1)]
    assert np.isclose(1 / (1 + np.exp(z[1] - z[0] + quality.AGREE)), total[1] / (total[0] + total[1]))


def test_repeated_rows_and_very_long_texts(spark):
    text = "\n".join(f"Line {i} of a long text, and not the last." for i in range(20000))
    rows = [(1, text, "x"), (1, text, "y"), (None, "a", "z"), (2, "## ## ##", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (7, 0), (None, 1)], "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)
