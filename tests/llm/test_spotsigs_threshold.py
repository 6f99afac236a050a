"""The likeness join at exactly its threshold: every size up to 70, a common signature less, and an empty table."""

from data import empty
from tidejoin.llm import spotsigs


def text(signatures):
    """A text with just these signatures: an anchor before two content words of their own."""
    return " ".join(f"the {s}a {s}b" for s in signatures)


def test_pairs_at_the_threshold_are_linked(spark):
    rows, linked, apart, doc = [], set(), set(), 0
    for j in range(1, 15):
        common = 4 * j  # Jaccard 0.8: 9 * common = 4 * (n + m)
        for n in range(common, 9 * j // 2 + 1):
            m = 9 * j - n
            for less in (0, 1):
                mark = f"k{doc}x"
                shared = [f"{mark}c{k}" for k in range(common - less)]
                rows.append((doc, text(shared + [f"{mark}l{k}" for k in range(n - len(shared))])))
                rows.append((doc + 1, text(shared + [f"{mark}r{k}" for k in range(m - len(shared))])))
                (apart if less else linked).add(doc)
                doc += 2
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in spotsigs.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(linked) > 50
    assert all(got[d] == (d, 1) and got[d + 1] == (d, 1) for d in linked)
    assert all(got[d] == (d, 0) and got[d + 1] == (d + 1, 0) for d in apart)


def test_no_documents(spark):
    assert spotsigs.duplicate_classes(empty(spark)).count() == 0
