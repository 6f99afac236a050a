"""Token-ID output: texts become ids, written as patched frame-of-reference pages in ascending doc_id order.

The ``tokenizers`` library encodes every text. Where the file's normaliser and pre-tokenizer are the ones that
PLAIN_RULES names, texts of common Latin characters are first split into the pieces that they make, and the library's
model encodes each distinct piece once; all other texts, and all texts under other rules, go to the library whole.

The written form is a folder with two Parquet tables, so Spark's commit protocol covers lost and repeated tasks and
any Hadoop file system can hold it:

* ``pages``: shard, page, start (ids before it in its shard), n_ids, doc_ids, doc_lens, body (see pfor.py). A page
  holds whole documents and is closed at PAGE_IDS ids or PAGE_DOCS documents.
* ``shards``: shard, base (ids in all shards before it), n_ids.

Defined results: a null text is encoded as the empty one; an empty text has the end id only; rows with equal doc_id
stand together in ascending order of text, each row of its own; a null doc_id comes first; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .common import keep, prepare, scratch

PAGE_IDS, PAGE_DOCS = 1 << 16, 4096
#: Bytes of distinct pieces, with what Python adds, that a worker remembers; the memory is emptied beyond that, which
#: changes speed only.
MEMO_BYTES = 40 << 20
PIECE_BYTES = 170
#: Characters of text that are split into words at a time.
SLICE = 1 << 19

PAGES = "shard int, page int, start long, n_ids long, doc_ids array<long>, doc_lens array<int>, body binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, page int"

# The normaliser and pre-tokenizer for which the splitting below is right.
PLAIN_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Under these rules, texts of these characters alone change in nothing but letter case, and split into these pieces.
_PLAIN = re.compile(r"[\t-\r !-~À-ÖØ-öø-ÿŒœ]*")
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿœ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ÿœ]+")
_BYTES = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
#: The printable character that stands for each byte in a byte-level vocabulary.
_BYTES |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _BYTES)}


class WordEncoder:
    """Ids of texts as little-endian uint32 bytes, from a ``tokenizers`` file.

    Under PLAIN_RULES, plain texts are split into pieces, and the library's model encodes each distinct piece once,
    which is remembered. Other texts, and those that may hold a special token, go to the library as they are.
    """

    def __init__(self, path: str, memo_bytes: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        vocab = self.tk.get_vocab()
        rules = {k: json.loads(getattr(self.tk, k).__getstate__()) if getattr(self.tk, k) else None for k in PLAIN_RULES}
        self.special = [x.content for x in self.tk.get_added_tokens_decoder().values()]
        ends = [k for w, k in vocab.items() if w.endswith("</w>")]
        self.split = rules == PLAIN_RULES and getattr(self.tk.model, "end_of_word_suffix", None) == "</w>"
        if self.split:
            self.model = Tokenizer(self.tk.model)  # the same model, without normaliser, pre-tokenizer and special tokens
            self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a piece
            self.last[ends] = True
        self.pieces: dict[str, bytes] = {}
        self.held, self.most = 0, memo_bytes

    def _library(self, strings: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tk.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in new]
        ids = np.asarray(self.model.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(new):  # the vocabulary doesn't mark the ends of all pieces
            self.pieces.update(zip(new, self._library(new), strict=True))
            return
        raw = ids.tobytes()
        self.pieces.update(zip(new, (raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.split:
            return self._library(texts)
        low = [x.lower() for x in texts]
        split = [None if not _PLAIN.fullmatch(x) or any(s in x or s in y for s in self.special) else _PIECE.findall(y) for x, y in zip(texts, low, strict=True)]
        new = set(chain.from_iterable(pieces for pieces in split if pieces is not None)).difference(self.pieces)
        if new:
            self._learn(list(new))
            self.held += PIECE_BYTES * len(new) + sum(map(len, new))
        get = self.pieces.__getitem__
        whole = iter(self._library([x for x, pieces in zip(texts, split, strict=True) if pieces is None]))
        out = [next(whole) if pieces is None else b"".join(map(get, pieces)) for pieces in split]
        if self.held > (self.most or MEMO_BYTES):
            self.pieces, self.held = {}, 0
        return out


def _encoder(path: str, memo_bytes: int | None = None) -> WordEncoder:
    """The worker's encoder; ``memo_bytes`` in place of MEMO_BYTES where tasks hold little else."""
    return keep(("tokens", path, memo_bytes), lambda: WordEncoder(path, memo_bytes))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE characters."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _to_pages(path: str, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, page, start = TaskContext.get().partitionId(), 0, 0
        encoder = _encoder(path)
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal page, start, held, ids, parts
            body = pfor.encode(np.frombuffer(b"".join(parts), "<u4"))
            n = held // 4
            row = [[shard], [page], [start], [n], [ids], [[len(p) // 4 for p in parts]], [body]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            page, start, held, ids, parts = page + 1, start + n, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in PAGES.split(", ")])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                for d, x in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids.append(d)
                    parts.append(x + end)
                    held += len(x) + 4
                    if held >= 4 * PAGE_IDS or len(ids) >= PAGE_DOCS:
                        yield close()
        if ids:
            yield close()

    return run


def _from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, page, start, doc_ids, lens, body in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            ids = pfor.decode(body).astype("<u4", copy=False)
            ends = np.cumsum(lens)
            begins = ends - lens
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
            n = len(lens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([page] * n, pa.int32())],
                names=[c.split()[0] for c in READ.split(", ")],
            )


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode docs (doc_id, text) into the folder ``path``. One shuffle of the texts, by ranges of doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_to_pages(tokenizer, end_id), PAGES).write.parquet(f"{path}/pages")
    shards = spark.read.schema(PAGES).parquet(f"{path}/pages").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_ids").write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written folder, decoded: doc_id, start, n_tokens, ids_crc32, shard, page."""
    pages = spark.read.schema(PAGES).parquet(f"{path}/pages")
    shards = spark.read.schema("shard int, base long, n_ids long").parquet(f"{path}/shards").select("shard", "base")
    placed = pages.join(shards, "shard").select("shard", "page", (F.col("start") + F.col("base")).alias("start"), "doc_ids", "doc_lens", "body")
    return placed.mapInArrow(_from_pages, READ)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
