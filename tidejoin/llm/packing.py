"""Packing documents into training sequences by lexical retrieval.

The lexical terms are the tokenizer's ids, so document frequencies, counted over all documents, are a table bounded by
the vocabulary. Documents are dealt into shards by their term of largest BM25 weight, so that documents about the same
lie together: terms share a shard until it holds SHARD_TOKENS, and a term with more has several, dealt by a hash of the
doc_id. Each shard has its own inverted index over all its documents. A seed, the first unused document, asks it for
unused neighbours by BM25 score, which fill the seed's window in that order; the one that doesn't fit is cut there, and
what is left of it is the seed of the next window. So full windows need no padding; a shard's last tokens become
sequences whose lengths are powers of two, which need none either.

A task reads its shards in order and packs each by itself; one that turns out larger than twice SHARD_TOKENS is packed in
pieces of that size, so a task's memory is bounded whatever the documents. Ids are shuffled once, compressed.

The written form is a Parquet table, a row a sequence: sequence_id, length, pad_to, width (bytes of an id), ids (binary,
little-endian), and arrays of its pieces: doc_ids, starts (ids of the document before the piece), lengths, doc_tokens.

Defined results: a null text is encoded as the empty one, which has the end id only; rows with equal or null doc_id are
documents of their own; equal scores follow the order of doc_id, then length; texts of any length are encoded whole, and
those beyond a window fill several; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, prepare, release, scratch
from .tokens import _encoder, _slices

WINDOW = 4096
#: Tokens of a shard, about: what one inverted index holds.
SHARD_TOKENS = 1 << 21
K1, B = 1.2, 0.75
#: Bytes of encoded pieces that a worker remembers: tasks that encode hold nothing else.
MEMO_BYTES = 160 << 20
#: Of so many documents, those that a term stands in make it a dense row of the index.
DENSE = 8

TOKENS = "doc_id long, n long, ids binary, n_terms long, terms binary, tf binary"
DEALT = "shard long, " + TOKENS
SEQUENCES = "sequence_id long, length long, pad_to long, width int, ids binary, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _squeeze(ids: np.ndarray) -> bytes:
    return pa.compress(ids.tobytes(), codec="zstd", asbytes=True)


def _restore(body: bytes, n: int, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(body, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), kind)


def _encode(path: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, MEMO_BYTES)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                end = int(end_id).to_bytes(4, "little")
                ids = [np.frombuffer(x + end, "<u4").astype(kind) for x in encoder.encode(texts[a:b])]
                terms, tf, counts = terms_of(ids)
                ends = np.cumsum(counts).tolist()
                cuts = list(zip([0, *ends], ends, strict=False))
                terms, tf = terms.astype(kind), tf.astype("<u4")
                columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([_squeeze(x) for x in ids], pa.binary()), pa.array(counts), *(pa.array([x[p:q].tobytes() for p, q in cuts], pa.binary()) for x in (terms, tf))]
                yield pa.RecordBatch.from_arrays([doc_ids[a:b], *columns], names=_names(TOKENS))

    return run


def terms_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of documents without their end ids, ascending, how often each occurs, and their number by document.

    All documents are sorted at once, by their number and the id.
    """
    sizes = np.array([len(x) - 1 for x in docs], np.int64)
    ids = np.concatenate([x[:-1] for x in docs])
    half = 16 if ids.itemsize == 2 and len(docs) <= 1 << 16 else 32  # both fit into 32 bits, or into 64
    kind = np.uint32 if half == 16 else np.uint64
    wide = np.repeat(np.arange(len(docs), dtype=kind) << kind(half), sizes) | ids.astype(kind)
    wide.sort()
    first = np.flatnonzero(np.append(True, wide[1:] != wide[:-1])) if len(wide) else np.empty(0, np.int64)
    tf = np.diff(np.append(first, len(wide)))
    held = wide[first]
    return (held & kind((1 << half) - 1)).astype(np.int64), tf, np.bincount((held >> kind(half)).astype(np.int64), minlength=len(docs))


class Weights:
    """BM25's weights from statistics over all documents."""

    def __init__(self, df: np.ndarray, documents: int, tokens: int):
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        self.mean = max(1.0, tokens / max(1, documents))

    def __call__(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Weights of terms that occur ``tf`` times in documents of ``length``."""
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def keys(self, terms: np.ndarray, tf: np.ndarray, counts: np.ndarray, lengths: np.ndarray, end_id: int) -> np.ndarray:
        """The term of largest weight of each document, the smallest of equals; the end id for one without terms."""
        out = np.full(len(counts), end_id, np.int64)
        has = np.flatnonzero(counts)
        if len(has):
            weights = self(terms, tf, np.repeat(lengths, counts))
            starts = (np.cumsum(counts) - counts)[has]
            best = np.repeat(np.maximum.reduceat(weights, starts), counts[has])
            at = np.where(weights == best, np.arange(len(weights)), len(weights))
            out[has] = terms[np.minimum.reduceat(at, starts)]
        return out


def _flat(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, tf, terms by document and length of a batch's documents, end to end."""
    joined = lambda c, k: np.frombuffer(b"".join(batch.column(c).to_pylist()), k).astype(np.int64)
    return joined("terms", kind), joined("tf", "<u4"), batch.column("n_terms").to_numpy(), batch.column("n").to_numpy()


def _sums(of, vocabulary: int, kind: str):
    """Per task, sums over its documents by term, as (term, n) without zeros; ``of`` gives terms and amounts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            terms, amounts = of(*_flat(batch, kind))
            total += np.bincount(terms, amounts, vocabulary).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    return run


def _by_term(tokens: DataFrame, of, vocabulary: int, kind: str) -> np.ndarray:
    """Sums over all documents by term: a number for each id of the vocabulary, which bounds what the driver gets."""
    rows = tokens.select("n", "n_terms", "terms", "tf")
    got = rows.mapInArrow(_sums(of, vocabulary, kind), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


def deal(tokens_by_key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each key term: small keys share one, large ones have several."""
    parts = np.maximum(1, -(-tokens_by_key // size))
    first, shard, held = np.zeros(len(parts), np.int64), 0, 0
    for k in np.flatnonzero(tokens_by_key).tolist():
        n = int(tokens_by_key[k])
        if held and held + n > size:
            shard, held = shard + 1, 0
        first[k] = shard
        if parts[k] > 1:
            shard, held = shard + int(parts[k]), 0
        else:
            held += n
    return first, parts


def _place(weights: Weights, first: np.ndarray, parts: np.ndarray, kind: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = weights.keys(*_flat(batch, kind), end_id)
            shards = []
            for doc_id, key in zip(batch.column("doc_id").to_pylist(), keys.tolist(), strict=True):
                row += 1
                mark = b"%d" % doc_id if doc_id is not None else b"row %d" % row  # rows without a doc_id spread too
                shards.append(int(first[key]) + zlib.crc32(mark) % int(parts[key]))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *batch.columns], names=_names(DEALT))

    return run


class Index:
    """An inverted index of a shard's documents. A term's postings are documents and weights; those of terms in one
    document of DENSE or more are kept as a row of weights over all documents, which add up faster."""

    def __init__(self, terms: np.ndarray, tf: np.ndarray, counts: np.ndarray, lengths: np.ndarray, weights: Weights):
        self.size = len(counts)
        values = weights(terms, tf, np.repeat(lengths, counts)).astype(np.float32)
        order = np.argsort(terms, kind="stable")
        rows, values = np.repeat(np.arange(self.size), counts)[order], values[order]
        held, place, n = np.unique(terms, return_inverse=True, return_counts=True)
        ends = np.cumsum(n)
        dense = np.flatnonzero(n * DENSE >= self.size)
        self.table = np.zeros((len(dense), self.size), np.float32)
        for k, t in enumerate(dense.tolist()):
            span = slice(ends[t] - n[t], ends[t])
            self.table[k, rows[span]] = values[span]
        line = np.full(len(held), -1, np.int64)
        line[dense] = np.arange(len(dense))
        self.rows, self.values, self.starts, self.ends, self.line = rows, values, ends - n, ends, line
        self.terms = np.split(place, np.cumsum(counts)[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for the seed's terms."""
        terms = self.terms[seed]
        lines = self.line[terms]
        found = self.table[lines[lines >= 0]].sum(axis=0)
        rare = terms[lines < 0]
        if len(rare):
            starts, n = self.starts[rare], self.ends[rare] - self.starts[rare]
            at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
            found += np.bincount(self.rows[at], self.values[at], self.size).astype(np.float32)
        return found


def neighbours(scores: np.ndarray, free: np.ndarray) -> Iterator[int]:
    """Free documents by descending score, then position."""
    left = np.flatnonzero(free)
    k = 64
    while len(left):
        if len(left) > k:
            s = scores[left]
            least = np.partition(s, len(s) - k)[len(s) - k]
            some, left = left[s >= least], left[s < least]
        else:
            some, left = left, left[:0]
        yield from some[np.argsort(-scores[some], kind="stable")].tolist()
        k *= 4


def windows(index: Index, sizes: list[int], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of a shard, whose documents have ``sizes`` ids, as lists of (document, start, length)."""
    free = np.ones(len(sizes), bool)
    held: list[tuple[int, int, int]] = []
    room, seed, start, first = window, -1, 0, 0
    while True:
        if seed < 0:  # the first unused document
            while first < len(sizes) and not free[first]:
                first += 1
            if first == len(sizes):
                break
            seed, start, free[first] = first, 0, False
        while sizes[seed] - start >= room:
            yield [*held, (seed, start, room)]
            start, held, room = start + room, [], window
        if start < sizes[seed]:
            held.append((seed, start, sizes[seed] - start))
            room -= sizes[seed] - start
            asked, seed = seed, -1
            for k in neighbours(index.scores(asked), free):
                free[k] = False
                if sizes[k] >= room:  # fills the window; the rest, if any, is the next seed
                    seed, start = k, 0
                    break
                held.append((k, 0, sizes[k]))
                room -= sizes[k]
        else:
            seed = -1
    yield from in_powers(held)


def in_powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """What is left, cut into sequences whose lengths are descending powers of two."""
    total = sum(n for _, _, n in pieces)
    out: list[tuple[int, int, int]] = []
    room = 1 << max(0, total.bit_length() - 1)
    for doc, start, n in pieces:
        while n:
            take = min(n, room)
            out.append((doc, start, take))
            start, n, room, total = start + take, n - take, room - take, total - take
            if not room:
                yield out
                out, room = [], 1 << max(0, total.bit_length() - 1)


def _pack(weights: Weights, window: int, size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        doc_ids: list[int | None] = []
        docs: list[np.ndarray] = []
        terms: list[bytes] = []
        tf: list[bytes] = []
        shard, held, number = -1, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal doc_ids, docs, terms, tf, held, number
            if not docs:
                return
            rows: list[tuple] = []
            sizes = [len(x) for x in docs]
            counts = np.array([len(x) for x in terms], np.int64) // np.dtype(kind).itemsize
            index = Index(np.frombuffer(b"".join(terms), kind).astype(np.int64), np.frombuffer(b"".join(tf), "<u4"), counts, np.array(sizes), weights)
            for pieces in windows(index, sizes, window):
                length = sum(n for _, _, n in pieces)
                ids = np.concatenate([docs[d][s : s + n] for d, s, n in pieces])
                pad = length if length & (length - 1) == 0 else window
                rows.append(((shard << 32) + number, length, pad, ids.itemsize, ids.tobytes(), [doc_ids[d] for d, _, _ in pieces], [s for _, s, _ in pieces], [n for _, _, n in pieces], [len(docs[d]) for d, _, _ in pieces]))
                number += 1
                if len(rows) == 128:
                    yield _sequences(rows)
                    rows = []
            if rows:
                yield _sequences(rows)
            doc_ids, docs, terms, tf, held = [], [], [], [], 0

        for batch in batches:
            for at, doc_id, n, body, own, often in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6)), strict=True):
                if at != shard or held > 2 * size:
                    yield from close()
                if at != shard:
                    shard, number = at, 0
                doc_ids.append(doc_id)
                docs.append(_restore(body, n, kind))
                terms.append(own)
                tf.append(often)
                held += n
        yield from close()

    return run


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 4]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=_names(SEQUENCES))


def write_sequences(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> None:
    """Pack docs (doc_id, text) into the Parquet table ``path``. ``window`` is a power of two."""
    from tokenizers import Tokenizer

    if window < 1 or window & (window - 1):
        raise ValueError("a window is a power of two")
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = max(max(Tokenizer.from_file(tokenizer).get_vocab().values()), end_id) + 1
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    tokens, tokens_path = cut(rows.mapInArrow(_encode(tokenizer, end_id, kind), TOKENS), "encoded")
    documents, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _by_term(tokens, lambda terms, tf, counts, lengths: (terms, None), vocabulary, kind)
    weights = Weights(df, documents, total)
    keyed = lambda terms, tf, counts, lengths: (weights.keys(terms, tf, counts, lengths, end_id), lengths)
    first, parts = deal(_by_term(tokens, keyed, vocabulary, kind), shard_tokens)
    placed = tokens.mapInArrow(_place(weights, first, parts, kind, end_id), DEALT).repartition("shard").sortWithinPartitions("shard", "doc_id", "n", "ids")
    placed.mapInArrow(_pack(weights, window, shard_tokens, kind), SEQUENCES).write.option("compression", "zstd").parquet(path)
    drop(spark, tokens_path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEQUENCES).parquet(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        out: list[tuple] = []
        for sequence, width, body, doc_ids, starts, lengths, doc_tokens in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            ids, at = np.frombuffer(body, f"<u{width}").astype("<u4"), 0
            for d, s, n, t in zip(doc_ids, starts, lengths, doc_tokens, strict=True):
                out.append((d, s, n, zlib.crc32(ids[at : at + n].tobytes()), t, sequence, at))
                at += n
        columns = zip(*out, strict=True) if out else ((),) * 7
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=_names(PIECES))


def pieces(sequences: DataFrame) -> DataFrame:
    """A row a piece, its checksum taken from the sequences' ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return sequences.select("sequence_id", "width", "ids", "doc_ids", "starts", "lengths", "doc_tokens").mapInArrow(_pieces, PIECES)


def packed(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """The sequences of docs, written to ``path`` (or the shared folder) and read back."""
    path = path or scratch(docs.sparkSession, "sequences")
    write_sequences(docs, path, tokenizer, **options)
    return read_sequences(docs.sparkSession, path)
