"""SimHash near-duplicates: by tiled exact comparison, or within bands of shared minima.

A fingerprint has 64 bits for each of ``words`` hash words. Distinct fingerprints are sorted into cells by the
population counts of their four 16-bit quarters, packed into tiles, and each tile is compared with the tiles whose
counts lie within the radius: the differences of the quarters' counts, summed, bound the Hamming distance from below,
so skipped tile pairs hold no link. Within a tile pair the same bound skips pairs of small sub-tiles; the rest is
numpy exclusive-or and bit counts. A tile pair yields a spanning forest of its links, never all of them, so a group of
thousands of copies costs no more rows than its members; the forests' components are the links' components.

Such comparisons grow with the square of the fingerprints. ``banded_groups`` grows with the texts: a text has BANDS keys,
each made of BAND_ROWS minima of its shingle hashes under as many orders, and texts that share a key are one group. Two
sets of Jaccard index s share a band with probability s ** BAND_ROWS, so (1 - s ** BAND_ROWS) ** BANDS of the pairs share
none: 5 of a million at 0.8, 1 of ten million at 0.85. A key gives a link from each of its texts to its smallest doc_id,
so a key that many texts hold makes no pairs.

``verified_roots`` holds groups against the texts: within each, the pairs of distinct shingle sets that aren't joined yet
and whose SimHash fingerprints differ in at most ``radius`` bits are compared exactly, in blocks of a bounded number of
shingles, each pair of blocks once.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; equal fingerprints are one
component; rows with equal doc_id are told apart only by what they hold; a null doc_id has a null component; texts of
any length are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, prepare, release
from .components import components

SEED = 42
#: A table makes about TILES tiles, of at least MIN_TILE and at most MAX_TILE fingerprints, compared in sub-tiles of
#: SUB. What tile pairs shuffle is TILES times the fingerprints until tiles reach MAX_TILE, which bounds a task's memory.
TILES, MIN_TILE, MAX_TILE, SUB = 16, 4096, 1 << 17, 256
#: Keys of a text, and minima in each.
BANDS, BAND_ROWS = 40, 6
#: Shingles, about, in a block of a component's sets.
BLOCK_SHINGLES = 1 << 19
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def _majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    n, total = len(h), np.zeros(64, np.int64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    for k in range(0, n, 255):  # eight counters of a byte in each word
        total += np.add.reduce(bits[k : k + 255], axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words. ASCII letters are lower-cased, words are runs of anything but ASCII white space."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(found)) - 1 :][:n] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4, words: int = 1, distinct: bool = False) -> list[int]:
    """distinct: a repeated shingle counts once."""
    h = shingles(text, shingle)
    return _of_hashes(np.unique(h) if distinct else h, words)


def _of_hashes(h: np.ndarray, words: int) -> list[int]:
    if not len(h):
        return [0] * words
    out = [_majority(h)]
    for k in range(1, words):
        x = h * np.uint64(_MIX[(k - 1) % 4]) + np.uint64(k)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX[k % 4])
        out.append(_majority(x ^ (x >> np.uint64(29))))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _odd(n: int, salt: int) -> np.ndarray:
    """Odd numbers that look random."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MIX[0]) + np.uint64(salt)) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the same runs of words as ``shingles``, made of one hash a word: about half the time."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    n, h = max(1, len(found) - shingle + 1), np.uint64(min(shingle, len(found)))
    for k, odd in enumerate(_odd(shingle, SEED)[: len(found)]):
        h = h + word[k : k + n] * odd
    return _mixed(h)


@cache
def _orders(n: int) -> np.ndarray:
    return (_odd(n, SEED + 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of shingle hashes, repeats allowed; the empty set has keys of its own."""
    n = BANDS * BAND_ROWS
    least, x = np.full(n, 0xFFFFFFFF, np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 256):  # a product with an odd number is another order of the 32-bit numbers
        np.minimum(least, (x[k : k + 256, None] * _orders(n)).min(axis=0), out=least)
    return _mixed((least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * _odd(BAND_ROWS, SEED + 2)).sum(axis=1) + _odd(BANDS, SEED + 3))


def _bands(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            keys = [band_keys(shingle_hashes(x, shingle)).view(np.int64) for x in b.column(1).to_pylist()]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], names=["doc_id", "keys"])

    return run


def banded_groups(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (doc_id, text), each doc_id once, to (doc_id, component_id): the texts that share a key with another, and
    the smallest doc_id reachable by shared keys."""
    spark = texts.sparkSession
    prepare(spark)
    held, path = cut(texts.select("doc_id", "text").mapInArrow(_bands(shingle), "doc_id long, keys array<long>"), "bands")
    keys = held.select("doc_id", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head != last").select("key", "head")
    root = components(keys.join(heads.hint("merge"), "key").where("doc_id != head").select(F.col("doc_id").alias("u"), F.col("head").alias("v")))
    drop(spark, path)
    return root.union(root.select("root", "root").distinct()).toDF("doc_id", "component_id")


def _fingerprints(shingle: int, words: int, distinct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            fps = [fingerprint(x, shingle, words, distinct) for x in b.column(1).to_pylist()]
            flat = np.asarray(fps, np.uint64).reshape(-1).view(np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * words, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp array<long>)."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(shingle, words, distinct), "doc_id long, fp array<long>")


def _quarters(first: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(first).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _gap(lo1, hi1, lo2, hi2) -> np.ndarray:
    """Lower bound of the distance of first words, from ranges of the quarters' counts."""
    return np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1)).sum(axis=-1)


def _ranges(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(q), SUB)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, links a - b."""
    root = np.arange(n)
    while len(a):
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[b], m)
        new = new[new]
        while not (new == new[new]).all():
            new = new[new]
        if (new == root).all():
            break
        root = new
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def links_of_tiles(x: np.ndarray, y: np.ndarray | None, radius: int, screen: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (indices into x, then y) of the pairs within radius; y None: pairs within x.

    x, y: [n, words] of uint64, sorted by the quarters' counts of the first word, in which a link has at most
    ``screen`` different bits.
    """
    both = x if y is None else np.concatenate([x, y])
    z, shift = (x, 0) if y is None else (y, len(x))
    qx, qz = _quarters(x[:, 0]), _quarters(z[:, 0])
    (lx, hx), (lz, hz) = _ranges(qx), _ranges(qz)
    near = _gap(lx[:, None], hx[:, None], lz[None], hz[None]) <= screen
    if y is None:
        near &= np.tri(len(lx), dtype=bool).T
    root = np.arange(len(both))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def settle() -> None:
        nonlocal root, held, count
        if held:
            a, b = (np.concatenate(v) for v in zip(*held, strict=True))
            root = _roots(len(both), np.concatenate([a, np.arange(len(both))]), np.concatenate([b, root]))
            held, count = [], 0

    for i, j in zip(*np.nonzero(near), strict=True):
        p, q = x[i * SUB : (i + 1) * SUB], z[j * SUB : (j + 1) * SUB]
        hit = np.bitwise_count(p[:, 0][:, None] ^ q[:, 0][None]) <= screen
        if y is None and i == j:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        a, b = np.nonzero(hit)
        if x.shape[1] > 1:
            ok = np.bitwise_count(p[a] ^ q[b]).sum(axis=1, dtype=np.int64) <= radius
            a, b = a[ok], b[ok]
        if len(a):
            held.append((a + i * SUB, b + j * SUB + shift))
            count += len(a)
            if count > 1 << 20:
                settle()
    settle()
    node = np.flatnonzero(root != np.arange(len(both)))
    return root[node], node


def _tile_rows(size: int):
    """Sorted (doc_id, fp) rows of a partition to tiles: part, number, ids and fingerprints, ranges of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        held = 0

        def close(ids: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            q = _quarters(fp[:, 0])
            row = [[(part << 32) + number], [ids.astype("<i8").tobytes()], [fp.astype("<u8").tobytes()], [q.min(axis=0).tolist()], [q.max(axis=0).tolist()]]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["tile", "ids", "fps", "lo", "hi"])

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            fps.append(b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(b.num_rows, -1))
            held += b.num_rows
            if held >= 2 * size:
                i, f = np.concatenate(ids), np.concatenate(fps)
                yield close(i[:size], f[:size])
                ids, fps, held = [i[size:]], [f[size:]], held - size
        if held:  # a rest of up to two tiles is one or two of its own
            i, f = np.concatenate(ids), np.concatenate(fps)
            half = held if held <= 1.2 * size else -(-held // 2)
            yield close(i[:half], f[:half])
            if half < held:
                yield close(i[half:], f[half:])

    return run


def _compare(words: int, radius: int, screen: int):
    """Rows (tile, other, ids, fps), two for each pair of tiles, one if tile and other are the same, to links."""

    def of(x: np.ndarray, y: np.ndarray | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = links_of_tiles(x, y, radius, screen)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first = None
        for batch in batches:
            for k in range(batch.num_rows):
                tile, other, i, f = (batch.column(c)[k].as_py() for c in range(4))
                x, ids = np.frombuffer(f, "<u8").reshape(-1, words), np.frombuffer(i, "<i8")
                if tile == other:
                    yield from of(x, None, ids)
                elif first is None:
                    first = x, ids
                else:
                    yield from of(first[0], x, np.concatenate([first[1], ids]))
                    first = None

    return run


def links(distinct: DataFrame, words: int, radius: int, screen: int | None = None) -> tuple[DataFrame, str]:
    """distinct (doc_id, fp), each fp once, to spanning links (u, v) of all pairs within ``radius`` differing bits, and
    the path of the tiles that they are read from."""
    spark = distinct.sparkSession
    screen = radius if screen is None else screen
    size = min(MAX_TILE, max(MIN_TILE, -(-distinct.count() // TILES)))
    first = F.col("fp")[0]
    quarter = [F.bit_count(F.shiftrightunsigned(first, 16 * k).bitwiseAND(F.lit(0xFFFF))).alias(f"q{k}") for k in range(4)]
    order = ["q0", "q1", "q2", "q3", "doc_id"]
    ordered = distinct.select("doc_id", "fp", *quarter).repartitionByRange(*order).coalesce(max(1, -(-distinct.count() // size))).sortWithinPartitions(*order)
    tiles, path = cut(ordered.select("doc_id", "fp").mapInArrow(_tile_rows(size), "tile long, ids binary, fps binary, lo array<int>, hi array<int>"), "tiles")
    # Tile numbers and ranges only: a tile meets the strips of count that its first quarter's range, widened by the
    # radius, touches.
    heads = tiles.select("tile", "lo", "hi")
    home = heads.select("tile", "lo", "hi", F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])).alias("strip"))
    reach = heads.select(F.col("tile").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("lo")[0] - screen), F.least(F.lit(16), F.col("hi")[0] + screen))).alias("strip"))
    gap = sum((F.greatest(F.lit(0), F.col("lo")[k] - F.col("hi2")[k], F.col("lo2")[k] - F.col("hi")[k]) for k in range(4)), F.lit(0))
    pairs = home.join(reach, "strip").where((F.col("tile") <= F.col("other")) & (gap <= screen)).select("tile", "other").distinct()
    # A tile's contents go once to each of its pairs.
    of = tiles.select(F.col("tile").alias("of"), "ids", "fps")
    ends = pairs.select("tile", "other", F.col("tile").alias("of")).union(pairs.where("tile != other").select("tile", "other", F.col("other").alias("of")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = ends.join(of, "of").repartition(4 * n, "tile", "other").sortWithinPartitions("tile", "other", "of")
    return dealt.select("tile", "other", "ids", "fps").mapInArrow(_compare(words, radius, screen), "u long, v long"), path


def near_duplicates(docs: DataFrame, shingle: int = 4, words: int = 1, radius: int = 4, screen: int | None = None, distinct: bool = False) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp, component_id): the smallest doc_id reachable by links, itself included."""
    fps, _ = cut(fingerprints(docs, shingle, words, distinct), "fingerprints")
    rep, _ = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    # A doc_id on rows of different texts stands for several fingerprints; these are linked by it.
    again = rep.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    shared = fps.join(again.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "fp").distinct()
    unique = rep.select(F.col("rep").alias("doc_id"), "fp")
    found, tiles = links(unique, words, radius, screen)
    same_doc = shared.join(rep, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    root = components(found.union(same_doc))
    drop(docs.sparkSession, tiles)
    placed, _ = cut(rep.join(root, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "placed")
    return fps.join(placed, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _sets(shingle: int, words: int):
    """(doc_id, component_id, text) to the text's shingle set, its size, digest and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            sets = [np.unique(shingle_hashes(x, shingle)) for x in b.column(2).to_pylist()]
            blobs = [x.astype("<u8").tobytes() for x in sets]
            fps = [np.asarray(_of_hashes(x, words), "<u8").tobytes() for x in sets]
            columns = [b.column(0), b.column(1), pa.array([hashlib.md5(x).digest() for x in blobs], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "component_id", "digest", "n", "fp", "hashes"])

    return run


def links_of_sets(sets: list[np.ndarray], side: np.ndarray, threshold: float, fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Spanning links of the pairs of sets with a Jaccard index of at least ``threshold`` and fingerprints within ``radius``.

    side: 0 or 1 for each set; if both occur, only pairs across count. fps: [n, words] of uint64.
    """
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.asarray([len(x) for x in sets], np.int64)
    parts = np.split(flat, np.cumsum(n)[:-1])
    across, mark = bool((side != side[0]).any()), np.zeros(len(flat) + 1, bool)
    root = np.arange(len(sets))
    u: list[int] = []
    v: list[int] = []
    for a in range(len(sets)):
        open_ = (root[a + 1 :] != root[a]) & (np.minimum(n[a + 1 :], n[a]) >= threshold * np.maximum(n[a + 1 :], n[a]) - 1e-9) & (n[a + 1 :] > 0)
        if across:
            open_ &= side[a + 1 :] != side[a]
        others = np.flatnonzero(open_) + a + 1
        others = others[np.bitwise_count(fps[others] ^ fps[a]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(others):
            continue
        mark[parts[a]] = True
        both = np.add.reduceat(mark[np.concatenate([parts[b] for b in others])], np.concatenate([[0], np.cumsum(n[others])[:-1]]), dtype=np.int64)
        mark[parts[a]] = False
        good = others[both >= threshold * (n[a] + n[others] - both) - 1e-9]
        if len(good):
            joined, first = np.unique(root[good], return_index=True)
            u += [a] * len(first)
            v += good[first].tolist()
            root[np.isin(root, joined)] = root[a]
    return u, v


def _verify(threshold: float, radius: int):
    """Rows (component_id, lo, hi, block, doc_id, fp, hashes) sorted by the first three to links."""

    def of(rows: list[tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        blocks, ids, fps, blobs = zip(*rows, strict=True)
        side = np.asarray(blocks)
        fp = np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1)
        u, v = links_of_sets([np.frombuffer(x, "<u8") for x in blobs], side, threshold, fp, radius)
        if u:
            ids = np.asarray(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, held = None, []
        for b in batches:
            for c, lo, hi, *row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if key != (c, lo, hi):
                    if len(held) > 1 and (key[1] == key[2] or len({x[0] for x in held}) > 1):
                        yield from of(held)
                    key, held = (c, lo, hi), []
                held.append(row)
        if len(held) > 1 and (key[1] == key[2] or len({x[0] for x in held}) > 1):
            yield from of(held)

    return run


def verified_roots(texts: DataFrame, shingle: int, threshold: float, words: int, radius: int) -> DataFrame:
    """texts (doc_id, component_id, text) to (node, root) as components() gives them.

    Links are all pairs within a component whose fingerprints of ``words`` words lie within ``radius`` and whose shingle
    sets have a Jaccard index of at least ``threshold``; equal sets, empty ones too, are linked.
    """
    spark = texts.sparkSession
    prepare(spark)
    sets, sets_path = cut(texts.select("doc_id", "component_id", "text").mapInArrow(_sets(shingle, words), "doc_id long, component_id long, digest binary, n long, fp binary, hashes binary"), "sets")
    reps, reps_path = cut(sets.groupBy("component_id", "digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "distinct")
    same = sets.select("doc_id", "component_id", "digest").join(reps, ["component_id", "digest"]).where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    blocks = reps.groupBy("component_id").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("m > 1")
    block = F.pmod(F.xxhash64("rep", "digest"), F.greatest("blocks", F.lit(1))).cast("int")
    placed = reps.join(blocks, "component_id").select("component_id", "digest", F.col("rep").alias("doc_id"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("o"))
    ends = placed.select("component_id", "digest", "doc_id", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block")
    rows = ends.join(sets.select("doc_id", "digest", "component_id", "fp", "hashes"), ["doc_id", "digest", "component_id"])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.select("component_id", "lo", "hi", "block", "doc_id", "fp", "hashes").repartition(4 * n, "component_id", "lo", "hi").sortWithinPartitions("component_id", "lo", "hi")
    root = components(dealt.mapInArrow(_verify(threshold, radius), "u long, v long").union(same))  # a table of its own
    drop(spark, sets_path)
    drop(spark, reps_path)
    return root
