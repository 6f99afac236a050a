import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from oracle import SF, compare

import __spark_entry__ as entry
from data import prose
from test_operators import slow_targets
from tidejoin.llm import decontam, simhash, tokens
from tidejoin.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name])


def test_registered():
    assert {f"op{k}" for k in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline(spark, tmp_path):
    """Every stage on the last one's rows: clean documents stay, copies and test items go, the mix meets its targets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        if name == "simhash_dedup":
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(kept) == docs.count() and set(kept.values()) == {kept[k] for k in kept}
            assert len(set(kept.values())) == len(kept)  # no exact copy stays
            sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in kept.items() for w in [t.lower().split()]}
            first = {}
            for d, s in sets.items():
                for g in s:
                    e = first.setdefault(g, d)
                    assert e == d or len(s & sets[e]) / len(s | sets[e]) < 0.8
            assert len(kept) > 0.85 * before.count()
        elif name == "decontamination":
            items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r["text"].lower() for r in docs.collect() for i in items)
            assert docs.count() > 0.9 * before.count()
        elif name == "source_mix":
            assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()


@pytest.mark.parametrize("block", [simhash.BLOCK_SHINGLES, 300])
def test_near_duplicates_are_verified(spark, monkeypatch, block):
    """What stays and goes equals brute-force components of the pairs at 0.8 or more."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rng = random.Random(3)
    texts = []
    for k in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(100)]
        texts.append(" ".join(w))
        for m in (5, 11, 20, 25, 30, 45):  # an index of about 0.9 to 0.4: a changed stretch at the end
            texts.append(" ".join(w[:-m] + [f"x{rng.randrange(5000)}" for _ in range(m)]))
    base = [f"v{j}" for j in range(100)]
    texts += [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(0, 100, 2)]  # one large group
    texts += ["line one two three four five\n" * 20 + t for t in texts[:14:7]] + [texts[0], texts[0].upper(), "", "  "]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for t in texts for w in [t.lower().split()]]
    like = lambda a, b: len(a & b) / len(a | b) >= 0.8
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if like(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()}
    assert kept == {d for d in range(len(sets)) if parent[d] == d}
    assert all(any(like(sets[d], s) for k, s in enumerate(sets) if k != d) for d in range(len(sets)) if d not in kept)


PIPELINE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _size long, size long, row string, rid long, key string, copies int, words int"


def write_corpus(spark, path, rows, items):
    table = spark.createDataFrame([(*r, 1, 7, 7, 7, "r", 7, "k", 7, 7) for r in rows], PIPELINE_SCHEMA)
    table.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def brute_force(rows, items):
    """The rows that language ID, near-duplicates and decontamination leave, one pair at a time."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and "日" not in r[1]]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for _, t, *_ in rows for w in [t.lower().split()]]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k])
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    number = {}
    ids = lambda t: np.asarray([[number.setdefault(w, len(number)) for w in t.lower().split()]])
    score = lambda t, i: decontam.align(ids(t), ids(i))[0][0] / (2 * len(i.split()))
    return [r for r in kept if not any(i and score(r[1], i) >= decontam.THRESHOLD for _, i in items)]


def test_run_equals_brute_force(spark, tmp_path):
    """Nulls, repeats, shared ids and columns of any name through run(), held against plain Python."""
    items = [(k, prose(3000 + k, 30)) for k in range(4)] + [(None, prose(3010, 30)), (9, None)]
    rows = [(k, prose(2000 + k, 60 + k % 40), "en", f"s{k % 3}") for k in range(90)]
    near = rows[3][1].split()
    rows += [(200, " ".join([*near[:-2], "zz", "yy"]), "en", "s0"), (2, rows[5][1], "en", "s1"), (None, rows[7][1], "en", "s2"), rows[8], rows[8]]  # near copy, copies
    rows += [(None, prose(2500, 70), "en", None), (None, prose(2501, 70) + " " + items[0][1], "en", None), (None, prose(2502, 70), None, "s0")]  # one null id of three is contaminated
    rows += [(300, prose(2503, 70), "en", "s1"), (300, prose(2504, 30) + " " + items[4][1], "en", "s1"), (301, items[2][1].upper(), "en", "s2")]
    rows += [(400, None, "en", "s0"), (401, "", "en", "s0"), (402, "12 %%", None, None), (403, "日本語" * 30, None, "s1"), (404, prose(2600, 4000), "en", "s1")]
    sf_dir = write_corpus(spark, tmp_path, rows, items)
    want = brute_force(rows, items)
    assert len(want) < len(rows) - 10
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for (name, stage), k in zip(corpus_pipeline.STAGES[:3], range(3), strict=True):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns, k
    pair = lambda r: (r[0], r[1])
    assert Counter(map(tuple, docs.select("doc_id", "text").collect())) == Counter(map(pair, want))
    library = tokens._encoder(tokenizer_path("word_bpe_49k.json")).tk
    encoded = lambda t: np.asarray([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
    expect = {(d, len(x), zlib.crc32(x.tobytes())): (t, source) for d, t, _, source in want for x in [encoded(t)]}
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert set(got) <= set(expect) and max(got.values()) <= 2
    sizes, taken = Counter(), Counter()
    for key, (t, source) in expect.items():
        sizes[source] += len(t.split())
        taken[source] += got[key] * len(t.split())
    target = slow_targets(sizes)
    largest = max(len(t.split()) for t, s in expect.values() if s != "s1")
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes if s != "s1")
    assert all(got[key] for key, (_, source) in expect.items() if target[source] >= sizes[source])


def test_run_on_empty_tables(spark, tmp_path):
    sf_dir = write_corpus(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
