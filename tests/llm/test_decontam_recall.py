"""Recall of seeds against all alignments over the threshold, and what common phrases make of candidates."""

import random

import numpy as np

from tidejoin.llm import decontam


def test_recall_against_all_alignments(spark):
    """Every third word replaced, and words at random up to 40 %, in items of 12 to 55 words full of common words."""
    rng = random.Random(11)
    common = "the of and to in is a that it was".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(500)}"
    items = [" ".join(word() for _ in range(n)) for n in (12, 20, 40, 55) for _ in range(8)]
    copies, third = [], set()
    for t in items:
        third.add(len(copies))
        copies.append(" ".join(f"new{k}" if k % 3 == 2 else w for k, w in enumerate(t.split())))
        for share in (0.2, 0.3, 0.35, 0.4):
            copies += [" ".join(word() if rng.random() < share else w for w in t.split()) for _ in range(2)]
    texts = [" ".join(word() for _ in range(40)) + f" {c} " + " ".join(word() for _ in range(40)) for c in copies]
    texts += [" ".join(word() for _ in range(120)) for _ in range(60)]  # clean
    number = {}
    ids = lambda t: np.asarray([number.setdefault(w, len(number)) for w in t.split()])
    want = set()
    for j, item in enumerate(items):
        scores = decontam.align(np.stack([np.pad(ids(t), (0, 140 - len(t.split())), constant_values=-1) for t in texts]), np.tile(ids(item), (len(texts), 1)))[0] / (2 * len(item.split()))
        want |= {(d, j) for d in np.flatnonzero(scores >= decontam.THRESHOLD).tolist()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_matches(docs, bench).collect()}
    assert len(want) > 200
    assert got <= want and len(got & want) >= 0.98 * len(want)
    every_third = {(d, j) for d, j in want if d in third}
    assert len(every_third) >= len(items) and len(got & every_third) >= 0.98 * len(every_third)


def test_a_common_phrase_does_not_hide_copies(spark, monkeypatch):
    """A phrase in every text is common: a copy is found by its other words, and a clean text with the phrase stays clean."""
    monkeypatch.setattr(decontam, "RARE_HITS", 5)
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [words(10) + " once upon a time " + words(10) for _ in range(3)] + ["once upon a time"]
    texts = [words(30) + " once upon a time " + words(30) for _ in range(200)] + [words(20) + " " + items[1] + " " + words(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_matches(docs, bench).collect()}
    assert got == {(200, 1)} | {(d, 3) for d in range(201)}  # an item that is all common phrase is found by it
