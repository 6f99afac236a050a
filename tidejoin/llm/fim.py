"""Fill-in-the-middle transformation with cut offsets from a roaring-style set of code point boundaries.

A text is UTF-8 bytes; its boundaries are the offsets at which code points begin, and its end. ``BoundarySet`` holds
them in containers of 2 ** 16 offsets each, by what is smallest: a sorted array, a bitmap, or runs (ASCII is one run).
Containers carry cumulative cardinalities, so the byte offset of the k-th code point is a binary search for its
container and a select inside it, and both cuts of a text come from one set without decoding the text.

Digits of a seeded SHA-256 of the doc_id choose the cuts and the form: ``psm`` (prefix, suffix, middle), ``spm`` (suffix,
prefix, middle) or ``plain`` (the text as it is). A text that holds a marker is plain, so a marker in a transformed text
always is one, and ``restored`` rebuilds the text from output and form alone.

One pass without a shuffle. Defined results: a null text is the empty one, which is plain; a null doc_id counts as an
empty string of digits; rows with equal doc_id are cut by the same numbers, each by its own length; texts of any length
are cut whole, in containers of bounded size; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, release

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: texts that are transformed, and of these the ones in suffix-prefix-middle form.
TRANSFORMED, SPM = 90, 20
SEED = "1"
#: Offsets of a container; the most that an array holds, beyond which a bitmap is smaller.
CHUNK, ARRAY_MOST = 1 << 16, 4096
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ArrayContainer:
    kind = "array"

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    kind = "bitmap"

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words).astype(np.int64))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, "right"))
        left, w = k - (int(self.upto[word - 1]) if word else 0), int(self.words[word])
        for _ in range(left):
            w &= w - 1  # drops the lowest bit
        return 64 * word + (w & -w).bit_length() - 1


class RunContainer:
    kind = "run"

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.upto = starts.astype(np.uint16), np.cumsum(lengths)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.upto, k, "right"))
        return int(self.starts[run]) + k - (int(self.upto[run - 1]) if run else 0)


def container(low: np.ndarray):
    """The smallest container of sorted offsets below CHUNK."""
    if low[-1] - low[0] + 1 == len(low):
        return RunContainer(low[:1], np.array([len(low)]))
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    firsts = np.concatenate([[0], breaks])
    if 4 * len(firsts) < min(2 * len(low), CHUNK // 8):
        return RunContainer(low[firsts], np.diff(np.append(firsts, len(low))))
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """Offsets of UTF-8 bytes at which a code point begins, and the end. ``len`` is the number of code points plus one."""

    def __init__(self, data: np.ndarray):
        self.keys: list[int] = []
        self.containers: list = []
        sizes: list[int] = []
        for key in range(len(data) // CHUNK + 1):
            part = data[key * CHUNK : (key + 1) * CHUNK]
            low = np.flatnonzero((part & 0xC0) != 0x80)
            if len(part) < CHUNK:  # the end lies in this chunk
                low = np.append(low, len(part))
            if len(low):
                self.keys.append(key)
                self.containers.append(container(low))
                sizes.append(len(low))
        self.upto = np.cumsum(sizes)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """Byte offset of code point k; the end for k = their number."""
        at = int(np.searchsorted(self.upto, k, "right"))
        return self.keys[at] * CHUNK + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


def cut(raw: bytes, first: int, second: int) -> tuple[int, int, int, int, int]:
    """(n, prefix units, units up to the middle's end, and the bytes of both) of a text; cuts are taken modulo n + 1."""
    bounds = BoundarySet(np.frombuffer(raw, np.uint8))
    n = len(bounds) - 1
    p, q = sorted((first % (n + 1), second % (n + 1)))
    return n, p, q, bounds.select(p), bounds.select(q)


def _transform(transformed: int, spm: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p_, s_, m_ = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows: list[tuple] = []
            for raw, h1, h2, h3, h4 in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                n, p, q, a, b = cut(raw, h1, h2)
                if not raw or h3 % 100 >= transformed or any(m in raw for m in marks):
                    rows.append((n, "plain", None, None, raw))
                elif h4 % 100 < spm:
                    rows.append((n, "spm", p, q - p, b"".join((s_, raw[b:], p_, raw[:a], m_, raw[a:b]))))
                else:
                    rows.append((n, "psm", p, q - p, b"".join((p_, raw[:a], s_, raw[b:], m_, raw[a:b]))))
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ([],) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return run


def transform(docs: DataFrame, seed: str = SEED, transformed: int = TRANSFORMED, spm: int = SPM) -> DataFrame:
    """docs (doc_id, text) to doc_id, n (code points), form, prefix_chars, middle_chars (null if plain), output."""
    prepare(docs.sparkSession)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    ready = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *map(group, range(4)))
    return ready.mapInArrow(_transform(transformed, spm), OUT)


def restored(output: Column, form: Column) -> Column:
    """The text of a transformed one."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(4), F.length(output))
        one = F.substring_index(body, first, 1)
        rest = F.substring(body, F.length(one) + 4, F.length(body))
        two = F.substring_index(rest, second, 1)
        return one, two, F.substring(rest, F.length(two) + 4, F.length(rest))

    prefix, suffix, middle = parts(SUFFIX, MIDDLE)
    suffix2, prefix2, middle2 = parts(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
