"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, bucket int, hash long, start long, line string, words int, fp string, key string, extra string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = "the of and to in is on ther wor mil pan sto gre lin dar fen kul mar tiv sel".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(spark, extra=()):
    a, b = prose(1, 80), prose(2, 60)
    near = b.replace(b.split()[30], "changed", 1)
    texts = [None, "", "   ", a, a, b, near, prose(3, 3000), "one", "two words", "%% !! 12", "Ünï　code ß\r\nx\ty", a.upper(), *(prose(k, 40) for k in range(10, 22)), *(x for x in extra)]
    rows = [(k, t, None if k % 7 == 3 else ("en", "fr")[k % 2], None if k % 5 == 0 else f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [rows[5], (6, prose(99, 20), "en", "s1"), (None, "no id", "en", "s2")]  # a repeated row, an id on two texts, a null id
    return spark.createDataFrame([(*r, 1, 9, 9, 9, 9, 9, "c", 9, "c", "c", "c") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
