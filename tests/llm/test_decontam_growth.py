"""Decontamination's cost of a text: n-grams in compiled code, and words a second time only where there is a candidate."""

import pytest
from pyspark.sql import functions as F

from data import prose
from tidejoin.llm import decontam


def slow_grams(words):
    """(at, words of the n-gram) of both shapes, the last spaced one of the words there are."""
    return [(k, s, tuple(words[k + o] for o in shape if k + o < len(words))) for k in range(len(words) - 2) for s, shape in enumerate(decontam.SHAPES)]


def test_grams_are_compiled(spark):
    """Every place gives both shapes; no plan node above the words' hashes is interpreted."""
    texts = [None, "", "a", "a b", "a b c", "a b c d", "a b c a b c", prose(1, 300), "x " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    grams = decontam._with_grams(docs.select("doc_id", decontam.word_ids(F.col("text")).alias("ids")), "doc_id")
    want = [(d, at, s, g) for d, t in enumerate(texts) for at, s, g in slow_grams((t or "").split())]
    rows = grams.collect()
    assert sorted((r["doc_id"], r["at"]) for r in rows) == sorted((d, at) for d, at, _, _ in want)
    assert len({r["seed"] for r in rows}) == len({(s, g) for _, _, s, g in want})
    plan = grams._jdf.queryExecution().executedPlan().toString()
    made = [x for x in plan.splitlines() if "Generate" in x]
    assert made and all("transform(" not in x for x in made)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_words_are_made_again_only_for_candidates(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", limit)
    monkeypatch.setattr(decontam, "drop", lambda *_: None)  # tables stay, so what was passed can be read
    passed = []
    chunks = decontam._with_chunks
    monkeypatch.setattr(decontam, "_with_chunks", lambda texts, over: passed.append(texts.select("key")) or chunks(texts, over))
    item = prose(1, 30)
    cut = " ".join(w for k, w in enumerate(item.split()) if k != 12)
    rows = [(k, prose(100 + k, 60)) for k in range(50)] + [(60, prose(200, 40) + " " + item), (61, cut), (62, cut), (63, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam.find_matches(docs, spark.createDataFrame([(7, item), (8, prose(900, 30))], "item_id long, text string"))
    seen = found.select("doc_id", "item_id").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in seen) == [(60, 7), (61, 7), (62, 7)]
    assert 3 <= passed[-1].count() < 20  # of 54 rows
