"""Fill-in-the-middle: containers against sorted lists, cuts against plain strings, edge rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from data import documents, empty, pairs, prose
from tidejoin.llm import fim


@pytest.mark.parametrize("text,kinds", [("a" * 200_000, {"run"}), ("aé" * 60_000, {"bitmap", "array", "run"}), ("日本" * 1000, {"array"}), ("日本" * 3000, {"bitmap"}), ("日" * 70_000, {"bitmap"}), ("", {"run"})])
def test_select_finds_every_boundary(text, kinds):
    raw = text.encode()
    bounds = fim.BoundarySet(np.frombuffer(raw, np.uint8))
    assert len(bounds) == len(text) + 1 and {c.kind for c in bounds.containers} <= kinds
    want = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) if text else [0]
    for k in {0, len(text), *(random.Random(1).randrange(len(text) + 1) for _ in range(500))}:
        assert bounds.select(k) == want[k]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é日𝄞\n"), max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_equal_plain_strings(text, first, second):
    n, p, q, a, b = fim.cut(text.encode(), first, second)
    assert n == len(text) and (p, q) == tuple(sorted((first % (n + 1), second % (n + 1))))
    assert text[:p] == text.encode()[:a].decode() and text[p:q] == text.encode()[a:b].decode()


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:p], text[p:q], text[q:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", p, q - p, f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 20 else (n, "psm", p, q - p, f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_edge_rows(spark):
    docs = documents(spark, ["<P> in a text", "<<S><<M", "<S<P<M", "日本é𝄞 " * 20_000, prose(4, 20_000), "<" * 50, *(f"{k} <" for k in range(60))])
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out), key=key)
    want = sorted(((d, *plain(d, t), t or "") for d, t, _ in pairs(docs)), key=key)
    assert got == want
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(empty(spark)).count() == 0
