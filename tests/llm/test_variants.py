"""Spelling variants against a brute-force version: counts by a plain loop, near words by single deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SF

from data import documents, empty
from tidejoin.llm import variants
from tidejoin.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def slow_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_near(counts):
    """Words that share a form with a letter deleted, or of which one is such a form of the other, compared plainly."""
    held, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for form in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            held[form].add(w)
    for group in held.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_edit(a, b)}
    return near


def slow_groups(counts):
    near, form = slow_near(counts), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def result(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = result(QUERIES["op11_spelling_variants"](spark, SF))
    assert got == slow_groups(slow_counts(rows))
    assert any(form and root != form for form, root, *_ in got.values())


@pytest.mark.parametrize("leaf,over", [(60, 4), (40, 0), (1 << 18, 4)])
def test_leaves_parts_and_blocks(spark, monkeypatch, leaf, over):
    """The same groups whatever the leaves' size, with leaves dealt into parts, small samples and small blocks."""
    monkeypatch.setattr(variants, "LEAF_CHARS", leaf)
    monkeypatch.setattr(variants, "OVER", over)
    monkeypatch.setattr(variants, "SAMPLE", 100)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcéÿz") for _ in range(rng.randint(4, 7))) for _ in range(250)]
    anagrams = ["".join(rng.sample("abbccdd", 7)) for _ in range(200)]
    long = "x" * 300
    base += anagrams + [long, long[:-1], long[:-2] + "y", "abcde" * 90, "abcde" * 40 + "q" + "abcde" * 50, "zzzzzzzzzzzzz"]
    counts = {w: rng.randint(3, 60) for w in base}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    near = slow_near(counts)
    got = {r["word"]: (r["n"], r["n_near"], r["best_n"], r["best"]) for r in variants.near_words(words).collect()}
    want = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        want[w] = (n, len(near[w]), counts.get(best), best)
    assert got == want


def test_edge_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns; an empty table."""
    docs = documents(spark, ["apples apples apples apples apples apples angles angles angles", "appless " * 3 + "Élan élan ÉLAN élans élans élans ×÷×÷× " * 3])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = result(variants.variant_groups(docs))
    assert got == slow_groups(slow_counts(rows)) and got
    assert variants.variant_groups(empty(spark)).count() == 0
    assert variants.variant_groups(spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "doc_id long, text string")).count() == 0


def test_roots_follow_whole_chains(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(20)] + [("a", "w3"), ("b", "c")]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(links, "word string, form string"), 20).collect()}
    assert got == {**{f"w{k}": "w20" for k in range(20)}, "a": "w20", "b": "c"}


def test_vectors_bound_edits():
    """One edit moves a vector at most one up and one down; boxes never shut out a vector inside."""
    rng = random.Random(1)
    for _ in range(300):
        w = bytes(rng.choice(b"abcdefz\xe9\xff") for _ in range(rng.randint(5, 30)))
        k = rng.randrange(len(w))
        v = lambda x: variants.codes(np.frombuffer(x, np.uint8)[None])[0]
        up = lambda a, b: int(variants._above(v(a), v(b)))
        changed, longer = w[:k] + b"q" + w[k + 1 :], w[:k] + b"q" + w[k:]
        assert up(changed, w) <= 1 and up(w, changed) <= 1 and up(longer, w) <= 1 and up(w, longer) == 0
