"""Spelling variants: words one inserted, deleted or replaced letter apart, found by K-d trees over letter counts.

Words are counted over all texts. One edit moves a word's vector of letter counts by an L1 distance of two at most: a
replaced letter takes one count up and one down, an inserted one takes one up. Counts of DIMS letter classes, each told
apart up to LEVELS, are kept in unary, 128 bits a word, so that "how far up" and "how far down" between two vectors,
or a vector and a tree's box, are bit counts of an and-not; folding and capping only shorten distances, so nothing near
is pruned.

For each length, an upper K-d tree deals the words into leaves of about LEAF_CHARS letters. It is fitted on a sample of
at most SAMPLE words; every word is then indexed, in the one leaf that its own vector leads to. A word asks the leaves
of its length and of the next whose boxes lie within one edit, of its own length only leaves behind its own, so each
pair meets once. A leaf far over its size is dealt into parts by hash, and its askers go to every part. Inside a leaf, a
second K-d tree with tight boxes down to BUCKET vectors is searched by blocks of askers; vectors that pass are expanded
to their words and the order of letters is compared. What leaves a task are counts and best neighbours of words, not
pairs.

A word's form is its commonest near word if that is RATIO times as common; forms are followed to the last by pointer
doubling, whose rounds are bounded by the logarithm of the longest chain that the counts allow.

Defined results: a null text has no words, an empty one neither; a null doc_id counts as an empty string of digits;
equal rows count each; of near words with equal counts the smallest in code point order is the form; texts and words
of any length are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, prepare, release

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: A run whose hash this divides loses a letter.
DROP_EVERY = 97
DIMS, LEVELS = 32, 4
#: Words that the upper trees are fitted on, at most; letters of a leaf, about; a leaf beyond OVER times that is dealt
#: into parts; vectors of an inner bucket; askers of a block; pairs and bytes compared at a time.
SAMPLE, LEAF_CHARS, OVER, BUCKET, BLOCK, PAIRS = 1 << 17, 1 << 18, 4, 32, 1 << 16, 1 << 18
#: Bytes of counted words that a task holds before it passes them on.
HELD_BYTES = 24 << 20

_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_CHARS)
#: Letter class of each Latin-1 byte: a to z their own, other letters by remainder.
_CLASS = np.array([b - 97 if 97 <= b <= 122 else 26 + b % (DIMS - 26) for b in range(256)], np.int64)
_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)

FOUND = "word string, n long, n_near long, best_n long, best string"
ENTRIES = "leaf long, role int, word string, n long"


def runs_of(doc_id: int | None, text: str) -> Counter[bytes]:
    """Words of a text, in Latin-1, and their counts: lower-cased runs, some of them with a letter deleted."""
    found: Counter[bytes] = Counter()
    head = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % DROP_EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < MIN_CHARS:
                continue
        found[run] += n
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    held: Counter[bytes] = Counter()
    size = 0

    def flush() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            before = len(held)
            words = runs_of(doc_id, text)
            held.update(words)
            size += 100 * (len(held) - before) + sum(len(w) for w in words if len(w) > 50)
            if size > HELD_BYTES:
                yield flush()
                held.clear()
                size = 0
    if held:
        yield flush()


def word_counts(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """docs (doc_id, text) to (word, n) of the words that occur ``least`` times or more. Tasks count before they shuffle."""
    prepare(docs.sparkSession)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def matrix(words: list[bytes], length: int) -> np.ndarray:
    """Letters of words of one length, a row a word."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def codes(letters: np.ndarray) -> np.ndarray:
    """Letter counts in unary: bit LEVELS * class + k is set if the class occurs more than k times. Two uint64 a word."""
    m = len(letters)
    at = _CLASS[letters] + DIMS * np.arange(m)[:, None]
    counts = np.bincount(at.ravel(), minlength=DIMS * m).reshape(m, DIMS)
    bits = counts[:, :, None] > np.arange(LEVELS)
    return np.packbits(bits.reshape(m, DIMS * LEVELS), axis=1, bitorder="little").view("<u8")


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far ``a`` lies above ``b``, summed over the classes (in unary)."""
    return np.bitwise_count(a[..., 0] & ~b[..., 0]) + np.bitwise_count(a[..., 1] & ~b[..., 1])


def _balance(sample: np.ndarray) -> tuple[int, int]:
    """The bit that halves the vectors best, and how many its smaller side has."""
    ones = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(len(sample), 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    smaller = np.minimum(ones, len(sample) - ones)
    bit = int(np.argmax(smaller))
    return bit, int(smaller[bit])


def _bit(vectors: np.ndarray, bit: int) -> np.ndarray:
    return (vectors[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1


class Upper:
    """The upper tree of one length. Boxes are what the splits leave: lower and upper bounds of the counts, in unary."""

    def __init__(self, sample: np.ndarray, capacity: float):
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, int]] = []  # low, high, bit, lower child, upper child or leaf
        self.leaves = 0
        self._split(sample, max(1.0, capacity), np.zeros(2, "<u8"), np.full(2, ~np.uint64(0)))

    def _split(self, sample: np.ndarray, capacity: float, low: np.ndarray, high: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((low, high, -1, -1, self.leaves))
        bit, smaller = _balance(sample) if len(sample) > capacity else (-1, 0)
        if not smaller:
            self.leaves += 1
            return at
        first, level = bit - bit % LEVELS, bit % LEVELS
        word, shift = bit // 64, first % 64
        more, less = low.copy(), high.copy()
        more[word] |= np.uint64(((1 << (level + 1)) - 1) << shift)  # more than k, so more than any fewer
        less[word] &= ~np.uint64((((1 << LEVELS) - 1) & ~((1 << level) - 1)) << shift)
        has = _bit(sample, bit)
        below = self._split(sample[~has], capacity, low, less)
        above = self._split(sample[has], capacity, more, high)
        self.nodes[at] = (low, high, bit, below, above)
        return at

    def visit(self, vectors: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose boxes lie at most ``up`` above and ``down`` below each vector."""
        rows, leaves = [], []
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            at, idx = stack.pop()
            low, high, bit, below, above = self.nodes[at]
            v = vectors[idx]
            idx = idx[(_above(low, v) <= up) & (_above(v, high) <= down)]
            if not len(idx):
                continue
            if bit < 0:
                rows.append(idx)
                leaves.append(np.full(len(idx), above))
            else:
                stack += [(below, idx), (above, idx)]
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


class Inner:
    """The K-d tree inside a leaf: distinct vectors, tight boxes (bits that all have, bits that any has), buckets."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, int, int]] = []  # low, high, from, to, children
        self._build(0, len(vectors))

    def _build(self, a: int, b: int) -> int:
        part = self.vectors[self.order[a:b]]
        low, high = np.bitwise_and.reduce(part, axis=0), np.bitwise_or.reduce(part, axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, a, b, -1, -1))
        if b - a > BUCKET:
            bit, _ = _balance(part)
            has = _bit(part, bit)
            own = self.order[a:b]
            self.order[a:b] = np.concatenate([own[~has], own[has]])
            mid = b - int(has.sum())
            if a < mid < b:
                self.nodes[at] = (low, high, a, b, self._build(a, mid), self._build(mid, b))
        return at

    def search(self, asked: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of asked, vector) in pieces: all pairs at most ``up`` up and ``down`` down."""
        stack = [(0, np.arange(len(asked)))]
        while stack:
            at, idx = stack.pop()
            low, high, a, b, below, above = self.nodes[at]
            v = asked[idx]
            idx = idx[(_above(low, v) <= up) & (_above(v, high) <= down)]
            if not len(idx):
                continue
            if below >= 0:
                stack += [(below, idx), (above, idx)]
                continue
            own = self.order[a:b]
            held = self.vectors[own]
            for k in range(0, len(idx), PAIRS // (b - a) + 1):
                some = idx[k : k + PAIRS // (b - a) + 1]
                v = asked[some][:, None, :]
                i, j = np.nonzero((_above(held[None], v) <= up) & (_above(v, held[None]) <= down))
                if len(i):
                    yield some[i], own[j]


class Words:
    """Words of one length: letters, vectors, their groups of equal vectors, and ranks by count, then code point order."""

    def __init__(self, words: list[bytes], n: list[int], length: int):
        self.length, self.n = length, np.asarray(n, np.int64)
        self.letters = matrix(words, length)
        padded = np.zeros((len(words), -(-length // 8) * 8), np.uint8)
        padded[:, :length] = self.letters
        self.packed = padded.view("<u8")
        self.text = np.array(words, f"S{length}")
        by = np.lexsort((self.text, -self.n))
        self.by_rank, self.rank = by, np.empty(len(by), np.int64)
        self.rank[by] = np.arange(len(by))
        vectors = codes(self.letters)
        _, first, group = np.unique(vectors.view("V16").ravel(), return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        self.members = np.argsort(group, kind="stable")
        self.sizes = np.bincount(group, minlength=len(first))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.n)


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Which pairs of words differ by exactly one edit; words of ``b`` are as long as those of ``a``, or a letter longer."""
    if a.length == b.length:
        differ = np.zeros(len(i), np.uint8)
        for k in range(a.packed.shape[1]):
            x = a.packed[i, k] ^ b.packed[j, k]
            differ += np.bitwise_count((((x & _LOW7) + _LOW7) | x) & _HIGH)  # bytes that aren't zero
        return differ == 1 if a.length < 200 else (a.letters[i] != b.letters[j]).sum(1) == 1
    x, y = a.letters[i], b.letters[j]
    end = np.ones((len(i), 1), bool)
    head = np.argmax(np.hstack([x != y[:, :-1], end]), axis=1)
    tail = np.argmax(np.hstack([(x != y[:, 1:])[:, ::-1], end]), axis=1)
    return head + tail >= a.length


def near_pairs(a: Words, b: Words, tree: Inner) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) one edit apart; ``tree`` holds b's vectors."""
    step = max(1, min(PAIRS, (PAIRS << 5) // b.length))
    for p, q in tree.search(a.vectors, 1, 1 if a.length == b.length else 0):
        wide = b.sizes[q]
        upto = np.cumsum(a.sizes[p] * wide)
        for s in range(0, int(upto[-1]), step):
            at = np.arange(s, min(s + step, int(upto[-1])))
            k = np.searchsorted(upto, at, "right")
            at -= np.where(k > 0, upto[k - 1], 0)
            i = a.members[a.starts[p[k]] + at // wide[k]]
            j = b.members[b.starts[q[k]] + at % wide[k]]
            ok = one_edit(a, i, b, j)
            if ok.any():
                yield i[ok], j[ok]


class Leaf:
    """A leaf's words with the counts and best neighbours found so far."""

    def __init__(self, words: list[bytes], n: list[int]):
        self.own = Words(words, n, len(words[0]))
        self.tree = Inner(self.own.vectors)
        self.near = np.zeros(len(self.own), np.int64)
        self.best_n = np.zeros(len(self.own), np.int64)
        self.best = np.zeros(len(self.own), f"S{self.own.length}")
        for k in range(0, len(words), BLOCK):
            part = self.own if len(words) <= BLOCK else Words(words[k : k + BLOCK], n[k : k + BLOCK], self.own.length)
            near, best = self._ask(part, False)
            self.near[k : k + BLOCK] += near
            self._better(np.arange(k, k + len(part)), best, self.own)

    def _ask(self, asked: Words, both: bool) -> tuple[np.ndarray, np.ndarray]:
        """Near words and best rank of each asker (a rank beyond the last: none); with ``both``, of the own words too."""
        near, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.own), np.int64)
        back = np.full(len(self.own), len(asked), np.int64)
        for i, j in near_pairs(asked, self.own, self.tree):
            near += np.bincount(i, minlength=len(asked))
            np.minimum.at(best, i, self.own.rank[j])
            if both:
                self.near += np.bincount(j, minlength=len(self.own))
                np.minimum.at(back, j, asked.rank[i])
        if both:
            self._better(np.arange(len(self.own)), back, asked)
        return near, best

    def _better(self, rows: np.ndarray, ranks: np.ndarray, of: Words) -> None:
        has = ranks < len(of)
        rows, found = rows[has], of.by_rank[ranks[has]]
        n, text = of.n[found], of.text[found]
        wins = (n > self.best_n[rows]) | ((n == self.best_n[rows]) & (text < self.best[rows]))
        self.best_n[rows[wins]], self.best[rows[wins]] = n[wins], text[wins]

    def ask(self, words: list[bytes], n: list[int]) -> pa.RecordBatch | None:
        asked = Words(words, n, len(words[0]))
        near, best = self._ask(asked, True)
        hit = np.flatnonzero(near)
        if not len(hit):
            return None
        found = self.own.by_rank[best[hit]]
        return _found(asked.text[hit], np.zeros(len(hit), np.int64), near[hit], self.own.n[found], self.own.text[found])

    def result(self) -> pa.RecordBatch:
        return _found(self.own.text, self.own.n, self.near, self.best_n, self.best)


def _found(words, n, near, best_n, best) -> pa.RecordBatch:
    text = lambda x: pa.array([w.decode("latin-1") for w in x.tolist()], pa.string())
    none = best_n == 0
    columns = [text(words), pa.array(n), pa.array(near), pa.array(best_n, mask=none), pa.array([None if z else w.decode("latin-1") for z, w in zip(none.tolist(), best.tolist(), strict=True)], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leaf and role: a leaf's own words (0) build it, then its askers, equally long (1) or shorter (2)."""
    release()
    at: tuple[int, int] = (-1, 0)
    leaf: Leaf | None = None
    words: list[bytes] = []
    counts: list[int] = []

    def close() -> Iterator[pa.RecordBatch]:
        """Ends a run of rows of one leaf and role, or a block of them."""
        nonlocal leaf, words, counts
        if not words:
            return
        if at[1] == 0:
            leaf = Leaf(words, counts)
        elif leaf is not None and (found := leaf.ask(words, counts)) is not None:
            yield found
        words, counts = [], []

    for batch in batches:
        for key, role, word, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if (key, role) != at:
                yield from close()
                if key != at[0]:
                    if leaf is not None:
                        yield leaf.result()
                    leaf = None
                at = (key, role)
            elif role and len(words) >= BLOCK:
                yield from close()
            words.append(word.encode("latin-1"))
            counts.append(n)
    yield from close()
    if leaf is not None:
        yield leaf.result()


def _by_length(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of a batch's words."""
    words = [w.encode("latin-1") for w in batch.column(column).to_pylist()]
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, codes(matrix([words[k] for k in rows.tolist()], length))


def _key(length: int, leaf: np.ndarray | int, part: np.ndarray | int) -> np.ndarray | int:
    return (length << 40) + (leaf << 20) + part


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for length, rows, v in _by_length(batch):
            yield pa.RecordBatch.from_arrays([pa.array([length] * len(rows), pa.int64()), pa.array(v[:, 0].view("<i8")), pa.array(v[:, 1].view("<i8"))], names=["length", "a", "b"])


def fit(words: DataFrame) -> dict[int, Upper]:
    """Upper trees by length, from a sample by hash of at most about SAMPLE of the words (24 bytes each)."""
    total = words.count()
    share = min(1.0, SAMPLE / max(1, total))
    some = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("word")
    got = some.mapInArrow(_vectors, "length long, a long, b long").toArrow()
    length = got.column("length").to_numpy()
    vectors = np.stack([got.column(c).to_numpy() for c in ("a", "b")], axis=1).view("<u8")
    return {k: Upper(vectors[length == k], LEAF_CHARS / k * share) for k in np.unique(length).tolist()}


def _leaf_of(trees: dict[int, Upper], length: int, vectors: np.ndarray) -> np.ndarray:
    """The one leaf that holds each vector."""
    if length not in trees:
        return np.zeros(len(vectors), np.int64)
    rows, leaves = trees[length].visit(vectors, 0, 0)
    out = np.zeros(len(vectors), np.int64)
    out[rows] = leaves
    return out


def _homes(trees: dict[int, Upper]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, v in _by_length(batch):
                leaves, n = np.unique(_leaf_of(trees, length, v), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(n), pa.int64()), pa.array(leaves), pa.array(n)], names=["length", "leaf", "n"])

    return run


def _entries(trees: dict[int, Upper], parts: dict[tuple[int, int], int]):
    def spread(length: int, rows: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each (row, leaf) to (row, key) of all the leaf's parts."""
        n = np.array([parts.get((length, k), 1) for k in leaves.tolist()], np.int64)
        ends = np.cumsum(n)
        part = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        return np.repeat(rows, n), _key(length, np.repeat(leaves, n), part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            words, n = batch.column(0), batch.column(1)
            for length, at, v in _by_length(batch):
                home = _leaf_of(trees, length, v)
                dealt = np.array([parts.get((length, k), 1) for k in home.tolist()], np.int64)
                own = _key(length, home, np.array([zlib.crc32(words[k].as_py().encode()) for k in at.tolist()], np.int64) % dealt)
                out = [(np.arange(len(at)), own, 0)]
                rows, leaves = trees[length].visit(v, 1, 1) if length in trees else (np.arange(len(at)), home)
                rows, keys = spread(length, rows, leaves)
                behind = keys > own[rows]
                out.append((rows[behind], keys[behind], 1))
                longer = length + 1
                rows, leaves = trees[longer].visit(v, 1, 0) if longer in trees else (np.arange(len(at)), np.zeros(len(at), np.int64))
                out.append((*spread(longer, rows, leaves), 2))
                for rows, keys, role in out:
                    take = pa.array(at[rows])
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([role] * len(rows), pa.int32()), words.take(take), n.take(take)], names=[c.split()[0] for c in ENTRIES.split(", ")])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), distinct, in Latin-1 letters, to (word, n, n_near, best_n, best): its near words and the commonest."""
    prepare(words.sparkSession)
    trees = fit(words)
    homes = words.select("word").mapInArrow(_homes(trees), "length long, leaf long, n long").groupBy("length", "leaf").agg(F.sum("n").alias("n"))
    large = homes.where(F.col("n") * F.col("length") > OVER * LEAF_CHARS).collect()  # leaves that the sample didn't foresee
    parts = {(r["length"], r["leaf"]): -(-r["n"] * r["length"] // LEAF_CHARS) for r in large}
    entries = words.select("word", "n").mapInArrow(_entries(trees, parts), ENTRIES)
    found = entries.repartition("leaf").sortWithinPartitions("leaf", "role").mapInArrow(_search, FOUND)
    best = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    merged = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame, most: int) -> DataFrame:
    """links (word, form) without cycles, in chains of ``most`` links at most, to (word, root). Each round doubles the reach."""
    now, path = cut(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, most - 1).bit_length()):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, new = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        drop(links.sparkSession, path)
        now, path = after, new
    return now


def variant_groups(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """docs (doc_id, text) to word, form, root, n, n_near, form_n."""
    words, words_path = cut(word_counts(docs), "words")
    near = near_words(words)
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    found, _ = cut(near.select("word", form.alias("form"), "n", "n_near", F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    drop(docs.sparkSession, words_path)
    low, high = found.agg(F.min("n"), F.max("n")).first()
    most = int(math.log(high / low, ratio)) + 1 if low else 0  # each link takes a word's count up ``ratio`` times
    ends = roots(found.where("form is not null").select("word", "form"), most)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
