"""Packing: every id in one piece, no padding, and windows against a plain greedy search by BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF

from data import documents, empty, pairs, prose
from tidejoin.llm import packing, tokens
from tidejoin.llm.queries import QUERIES, tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def ids_of(texts):
    tk = tokens._encoder(WORDS).tk
    return [[*e.ids, 2] for e in tk.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check(rows, docs):
    """docs: (doc_id, ids). Pieces tile the documents (equal ids are told apart by their pieces), sequences have no gap."""
    sequences, cut = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        cut[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)
    by_id = defaultdict(list)
    for d, ids in docs:
        by_id[d].append(ids)
    assert set(by_id) == set(cut)
    for d, held in by_id.items():
        want, parts = Counter(), Counter((r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in cut[d])
        for ids in held:  # each document's pieces: a chain of starts, chosen among what is left
            at = 0
            while at < len(ids):
                found = next(p for p in parts if parts[p] > want[p] and p[0] == len(ids) and p[1] == at and p[3] == crc(ids[at : at + p[2]]))
                want[found] += 1
                at += found[2]
            assert at == len(ids)
        assert want == parts


def test_query_packs_every_id(spark):
    rows = QUERIES["op13_retrieval_packing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(rows, list(zip([r["doc_id"] for r in docs], ids_of([r["text"] for r in docs]), strict=True)))
    lengths = Counter()
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    assert sum(n == 4096 for n in lengths.values()) > 0.9 * len(lengths)


@pytest.mark.parametrize("shard_tokens", [3000, 1 << 21])
def test_edge_rows(spark, shard_tokens):
    docs = documents(spark, [prose(7, 9000)])
    packed = packing.packed(docs, WORDS, shard_tokens=shard_tokens)
    rows = packing.pieces(packed).collect()
    held = pairs(docs)
    check(rows, list(zip([d for d, _, _ in held], ids_of([t for _, t, _ in held]), strict=True)))
    assert packed.where("pad_to != length").count() == 0
    assert packing.pieces(packing.packed(empty(spark), WORDS)).count() == 0


def slow_windows(docs, window, scores):
    """A plain version: a full sort of all scores, one id at a time."""
    order, free, out = [], set(range(len(docs))), []
    while free:
        seed = min(free)
        free.discard(seed)
        order.append((seed, 0))
        room = window - sum(len(docs[d]) for d, _ in order) % window
        asked = seed
        while free and asked is not None:
            ranked = sorted(free, key=lambda k: (-scores[asked][k], k))
            room, asked_next = window - sum(len(docs[d]) for d, _ in order) % window, None
            for k in ranked:
                free.discard(k)
                order.append((k, 0))
                if len(docs[k]) >= room:
                    asked_next = k if len(docs[k]) > room and (len(docs[k]) - room) % window else None
                    break
                room -= len(docs[k])
            asked = asked_next
    stream = [(d, i) for d, _ in order for i in range(len(docs[d]))]
    for a in range(0, len(stream), window):
        out.append(stream[a : a + window])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_plain_greedy(seed):
    rng = random.Random(seed)
    docs = [np.array([*(rng.choice([*range(20), *range(20, 60, 3)]) for _ in range(rng.choice([0, 3, 8, 17, 40, 130]))), 2], np.uint16) for _ in range(60)]
    df = np.zeros(64, np.int64)
    for d in docs:
        df[np.unique(d[:-1])] += 1
    total = sum(map(len, docs))
    weights = packing.Weights(df, len(docs), total)
    idf = [math.log(1 + (60 - n + 0.5) / (n + 0.5)) for n in df]
    index = packing.Index(*packing.terms_of(docs), np.array([len(d) for d in docs]), weights)
    tf = [Counter(d[:-1].tolist()) for d in docs]
    for k in range(60):
        want = [sum(idf[t] * tf[j][t] * 2.2 / (tf[j][t] + 1.2 * (0.25 + 0.75 * len(docs[j]) / (total / 60))) for t in tf[k] if t in tf[j]) for j in range(60)]
        assert np.allclose(index.scores(k), want, rtol=1e-5)
    got = [[(d, s + i) for d, s, n in pieces for i in range(n)] for pieces in packing.windows(index, [len(d) for d in docs], 64)]
    full = [w for w in got if len(w) == 64]
    plain = slow_windows([d.tolist() for d in docs], 64, [index.scores(k).tolist() for k in range(60)])
    assert full == [w for w in plain if len(w) == 64]
    assert sum(got, []) == sum(plain, [])
    assert all(len(w) & (len(w) - 1) == 0 for w in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=9))
def test_powers_of_two(lengths):
    pieces = [(k, 5, n) for k, n in enumerate(lengths)]
    out = list(packing.in_powers(pieces))
    sizes = [sum(n for _, _, n in s) for s in out]
    assert sum(sizes) == sum(lengths) and sizes == sorted(set(sizes), reverse=True) and all(n & (n - 1) == 0 for n in sizes)
    assert [(d, s + i) for seq in out for d, s, n in seq for i in range(n)] == [(k, 5 + i) for k, n in enumerate(lengths) for i in range(n)]


def test_keys_share_or_split_shards():
    n = np.array([0, 30, 50, 40, 250, 0, 10, 100])
    first, parts = packing.deal(n, 100)
    assert parts.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]
    assert [int(first[k]) for k in (1, 2, 3, 4, 6, 7)] == [0, 0, 1, 2, 5, 6]


def test_copies_share_windows(spark):
    """Edited copies are mostly packed beside each other; by chance one in six would be (a copy only meets a seed that is near)."""
    docs = []
    for k in range(120):
        text = prose(1000 + k, 120)
        docs += [(k, text), (k + 5000, text.replace(text.split()[40], "altered", 1))]
    rows = packing.pieces(packing.packed(spark.createDataFrame(docs, "doc_id long, text string"), WORDS)).collect()
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"]].add(r["sequence_id"])
    beside = sum(any(abs(a - b) <= 1 for a in where[k] for b in where[k + 5000]) for k in range(120))
    assert beside > 80
