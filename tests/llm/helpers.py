"""Small corpora with the awkward cases, and brute-force definitions."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, k long, id string"  # clashing extra columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60, vocabulary=40):
    """Rows (doc_id, text, ...) with copies, near copies, shared passages, nulls, blanks and a long text."""
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(vocabulary)]
    some = lambda m: [r.choice(words) for _ in range(m)]
    passage = some(60)
    texts = []
    for i in range(n):
        t = some(r.choice([0, 1, 3, 25, 60, 120]))
        if i % 5 == 0:
            t = t[:30] + passage + t[30:]
        if i % 6 == 0 and texts:
            t = WORD.findall(texts[r.randrange(len(texts))] or "")
            if t and i % 12 == 0:
                t[r.randrange(len(t))] = "changed"
        texts.append((" \n" if i % 4 else " ").join(t))
    texts += [None, "", " \t\n", "a", " ".join(some(30) * 60), " ".join(["x"] * 90)]
    return [(i * 3, t, "en", 1, "z") for i, t in enumerate(texts)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_words(text):
    return WORD.findall(text or "")
