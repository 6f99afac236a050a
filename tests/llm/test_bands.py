"""The pipeline's near-duplicate candidates: bands of minima find the pairs, and nothing compares all texts with all."""

import corpus_pipeline
import numpy as np
import pytest

from data import prose
from tidejoin.llm import simhash


@pytest.mark.parametrize("n", [9, 90, 900])
def test_bands_find_pairs_at_the_threshold(n):
    """Pairs at an index of exactly 0.8 share each band with probability 0.8 ** BAND_ROWS, and none is missed."""
    rng, shared = np.random.default_rng(n), []
    for _ in range(20_000 if n < 100 else 2_000):
        x = rng.integers(0, 1 << 64, n + n // 9, dtype=np.uint64)  # 8 of 10 ninths on both sides
        a, b = x[:n], x[n // 9 :]
        shared.append((simhash.band_keys(a) == simhash.band_keys(b)).sum())
    assert min(shared) > 0
    assert abs(np.mean(shared) / simhash.BANDS - 0.8**simhash.BAND_ROWS) < 0.01
    x = rng.integers(0, 1 << 64, (200, n), dtype=np.uint64)
    assert len(np.unique([simhash.band_keys(r) for r in x])) == 200 * simhash.BANDS


def test_shingle_hashes_tell_shingles_apart():
    """Equal where the runs of words are equal, up to letter case and white space, and nowhere else."""
    w = [f"w{k % 37}v{k % 11}" for k in range(3000)]
    h = simhash.shingle_hashes(" ".join(w), 5)
    assert len(h) == len(w) - 4 and len(np.unique(h)) == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    assert (simhash.shingle_hashes("\t".join(w).upper(), 5) == h).all()
    short = ["a", "b", "a a", "a b", "b a", "a b c", "a b c d", "a b c d e", "e d c b a"]
    assert len({int(x) for t in short for x in simhash.shingle_hashes(t, 5)}) == len(short)
    assert len(simhash.shingle_hashes(None, 5)) == len(simhash.shingle_hashes(" \n", 5)) == 0


def test_texts_are_not_compared_all_with_all(spark, monkeypatch):
    """Work follows the texts: unrelated ones share no key, and no tile meets another."""

    def tiles(*_):
        raise AssertionError("all fingerprints are compared with all")

    monkeypatch.setattr(simhash, "links", tiles)
    rows = [(k, prose(5000 + k, 80)) for k in range(300)]
    rows += [(1000 + k, rows[7 * k][1] + " more") for k in range(20)] + [(2000 + k, " ") for k in range(5)] + [(3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.banded_groups(docs, 5).collect()}
    assert groups == {7 * k: 7 * k for k in range(20)} | {1000 + k: 7 * k for k in range(20)} | dict.fromkeys([*range(2000, 2005), 3000], 2000)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    assert kept == [*range(300), 2000]
