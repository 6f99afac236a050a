"""Sketches of sites against exact counts at a threshold where they differ."""

from tidejoin.llm import lines


def test_lines_near_a_large_threshold_are_counted(spark):
    """200 sites: what is near is exact, what is far rests on its sketch, and both fall on the right side."""
    spread = {f"line {k}": k for k in (2, 150, 176, 195, 199, 200, 201, 210, 224, 260, 300)}
    rows = [(s, "\n".join(x for x, k in spread.items() if s < k), f"site{s}") for s in range(300) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = {r["line"]: r["n_sites"] for r in lines.boilerplate(docs, 200).collect()}
    by_hash = {r["h"]: r["t"] for r in spark.createDataFrame([(x,) for x in spread], "t string").select("t", lines.line_hash(lines.F.col("t")).alias("h")).collect()}
    got = {by_hash[h]: n for h, n in found.items()}
    assert set(got) == {x for x, k in spread.items() if k >= 200}
    assert all(got[f"line {k}"] == k for k in (200, 201, 210))
    assert all(abs(n - spread[x]) <= 0.1 * spread[x] for x, n in got.items())
