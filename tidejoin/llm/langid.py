"""Language ID by interpolated Kneser-Ney character models.

Texts are lower-cased runs of letters; everything else is one boundary symbol, and a context never reaches beyond the
last boundary, so the score of a white-space-delimited word depends on that word alone and is remembered by workers.
Grams of up to four symbols of 16 bits are keys of 64 bits; each order keeps one sorted array of hashed keys (the
product with an odd constant, which is one to one) with a row of log probabilities, one for each language. A row holds
the full interpolated probability, also for languages that never saw the gram; grams that no language saw back off
through the context's weights. The language with the lowest cross-entropy a symbol wins; ties go to the first by name.

Learning: all documents with text and lang whose id doesn't fall to the held-out quarter. Their words are counted by
language, then the words' grams. Every gram counts and stays: the model, which is broadcast, grows with the distinct
grams of the languages. About CALIBRATE_DOCS documents of each language (a tenth of all, if fewer), chosen by a hash of
doc_id, are first left out and calibrate a model of the others: the score's temperature, and each language's usual
cross-entropy. Then they are counted too. A language's probabilities rest on its own counts and the
alphabet of all, so a model beyond MODEL_BYTES is scored by slices of its languages, each in a pass of its own over the
texts, and the sums of all slices decide as they would together. A document is rejected if it has no letter, or if its cross-entropy exceeds
its language's mean by REJECT deviations, widened for short texts.

Defined results: null text, or none with a letter: ``und``, score 0, rejected. A table to learn from without a usable
row: all ``und``. A null doc_id counts as not held out. Rows are predicted one by one, so repeated rows agree; very
long texts are scored whole. Other columns are ignored; keep_accepted carries them, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, drop, keep, prepare, release

CALIBRATE_DOCS = 300
#: Distinct words, and their bytes, that a counting task holds before it passes them on.
HELD_WORDS, HELD_BYTES = 200_000, 1 << 24
ORDER, BOUNDARY = 4, 1
REJECT = 12.0
#: Bytes, about, of a model that may be broadcast: a row a distinct gram, a float a language. Languages beyond it are
#: scored a slice at a time; no gram is left out for it, and a slice has one language at least.
MODEL_BYTES = 1 << 30
#: Bytes of scored words, with what Python adds, that a worker remembers; emptied beyond that, which changes speed only.
MEMO_BYTES = 24 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = [np.uint64((1 << 16 * n) - 1) for n in range(5)]
_NONE = np.uint64(0)

COUNTS = "lang string, gram long, n long"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"

_symbols: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """Symbol of each code point: letters keep theirs, those beyond 16 bits share a private range."""
    if not _symbols:
        t = np.full(0x110000, BOUNDARY, np.uint64)
        for c in range(0x110000):
            if chr(c).isalpha():
                t[c] = c if c < 0x10000 else 0xE000 + (c & 0xFFF)
        _symbols.append(t)
    return _symbols[0]


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the grams of order 4 of all words, and the number of keys of each word (0: no letter)."""
    texts = [" " + w.decode("utf-8", "replace").lower() + " " for w in words]
    joined = "".join(texts)
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = _symbol_table()[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    edge = s == BOUNDARY
    keep = ~(edge & np.concatenate([[False], edge[:-1]]))
    s, owner, edge = s[keep], owner[keep], edge[keep]
    b = np.uint64(BOUNDARY)
    p1 = np.concatenate([[b], s[:-1]])
    p2 = np.where(p1 == b, b, np.concatenate([[b, b], s[:-2]])[: len(s)])
    p3 = np.where(p2 == b, b, np.concatenate([[b, b, b], s[:-3]])[: len(s)])
    key = (p3 << np.uint64(48)) | (p2 << np.uint64(32)) | (p1 << np.uint64(16)) | s
    scored = ~(edge & (p1 == b))  # a boundary is predicted at a letter's end only
    scored[0] = False
    # The boundary that ends a word may have merged with the one before the next word: it belongs to its letter's word.
    owner = np.where(edge, np.concatenate([[0], owner[:-1]]), owner)
    return key[scored], np.bincount(owner[scored], minlength=len(words))


class Table:
    """Rows of values under sorted hashed keys, with an index by the hash's upper bits."""

    BITS = 18

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = keys * _ODD
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order]
        self.first = np.searchsorted(self.hashes, np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)).astype(np.int64)
        counts = np.diff(np.append(self.first, len(h)))
        self.depth = int(counts.max()) if len(h) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return out
        h = keys * _ODD
        at = self.first[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
        open_ = np.arange(len(keys))
        for _ in range(self.depth):
            inside = at < len(self.hashes)
            open_, at, h = open_[inside], at[inside], h[inside]
            got = self.hashes[at]
            hit = got == h
            out[open_[hit]] = at[hit]
            go = got < h
            open_, at, h = open_[go], at[go] + 1, h[go]
            if not len(open_):
                break
        return out


class Figures:
    """What decides on sums of log probabilities: languages, the score's temperature, and usual cross-entropies."""

    def __init__(self, languages: list[str]):
        self.languages, n = languages, len(languages)
        self.temperature, self.mean, self.spread, self.noise = 1.0, np.zeros(n), np.ones(n), np.ones(n)

    def calibrated_by(self, other: Figures) -> None:
        """Takes the temperature, and the figures of languages that the other has; others get wide ones."""
        self.temperature = other.temperature
        self.spread[:] = 10.0
        for k, lang in enumerate(self.languages):
            if lang in other.languages:
                j = other.languages.index(lang)
                self.mean[k], self.spread[k], self.noise[k] = other.mean[j], other.spread[j], other.noise[j]

    def limit(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.mean[lang] + REJECT * (self.spread[lang] + self.noise[lang] / np.sqrt(np.maximum(n, 1)))


class Model(Figures):
    """Tables of log probabilities and back-off weights for a list of languages."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], symbols: int | None = None):
        """counts: for each language the keys of order 4 and their counts; symbols: of all languages, if these are some."""
        super().__init__(languages)
        n = len(languages)
        by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for keys, c in counts:
            by_order[ORDER].append((keys, c.astype(np.float64)))
            for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols to the left
                keys, c = np.unique(by_order[order + 1][-1][0] & _LOW[order], return_counts=True)
                by_order[order].append((keys, c.astype(np.float64)))
        alphabet = np.unique(np.concatenate([k for k, _ in by_order[1]])) if n else np.zeros(0, np.uint64)
        self.floor = -np.log((symbols or len(alphabet)) + 1.0)
        self.grams: list[Table | None] = [None]
        self.weights: list[Table | None] = [None]
        for order in range(1, ORDER + 1):
            union = np.unique(np.concatenate([k for k, _ in by_order[order]])) if n else np.zeros(0, np.uint64)
            contexts = np.unique(union >> np.uint64(16))
            at = np.searchsorted(contexts, union >> np.uint64(16))
            logs, weights = np.zeros((len(union), n)), np.zeros((len(contexts), n))
            lower = self._lower(union, order)
            for lang, (keys, c) in enumerate(by_order[order]):
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                ctx = np.searchsorted(contexts, keys >> np.uint64(16))
                total = np.bincount(ctx, c, len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts))
                seen = total > 0
                back = np.where(seen, d * kinds / np.maximum(total, 1), 1.0)
                own = np.zeros(len(union))
                own[np.searchsorted(union, keys)] = np.maximum(c - d, 0)
                p = own / np.maximum(total[at], 1) + back[at] * np.exp(lower[:, lang])
                logs[:, lang], weights[:, lang] = np.log(p), np.log(back)
            self.grams.append(Table(union, logs.astype(np.float32)))
            self.weights.append(Table(contexts, weights.astype(np.float32)))

    def _lower(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of the last symbol with one symbol of context less."""
        if order == 1:
            return np.full((len(keys), len(self.languages)), self.floor)
        return self.logs(keys & _LOW[order - 1], order - 1)

    def logs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        row = self.grams[order].find(keys)
        out = self.grams[order].values[np.maximum(row, 0)].astype(np.float64) if len(self.grams[order].values) else np.zeros((len(keys), len(self.languages)))
        miss = np.flatnonzero(row < 0)
        if len(miss):
            k = keys[miss]
            ctx = self.weights[order].find(k >> np.uint64(16))
            back = np.where((ctx >= 0)[:, None], self.weights[order].values[np.maximum(ctx, 0)], 0.0) if len(self.weights[order].values) else 0.0
            out[miss] = back + self._lower(k, order)
        return out


class Scorer:
    """Sums of log probabilities by language, and symbols, of whole texts."""

    def __init__(self, model: Model):
        self.model, self.row, self.held = model, {}, 0
        self.sums = np.zeros((0, len(model.languages) + 1))

    def _learn(self, words: set[bytes]) -> None:
        new = list(words)
        self.held += sum(map(len, new)) + len(new) * (140 + 8 * self.sums.shape[1])
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            keys, n = grams_of(part)
            logs = self.model.logs(keys)
            total = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
            ends = np.cumsum(n)
            rows = np.concatenate([total[ends] - total[ends - n], n[:, None]], axis=1)
            self.row.update(zip(part, range(len(self.row), len(self.row) + len(part)), strict=True))
            self.sums = np.concatenate([self.sums, rows])

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [(x or "").encode("utf-8", "replace").split() for x in texts]
        out = np.zeros((len(texts), len(self.model.languages) + 1))
        if self.held > MEMO_BYTES:
            self.row, self.held = {}, 0
            self.sums = np.zeros((0, self.sums.shape[1]))
        missing = {w for words in split for w in words if w not in self.row}
        if missing:
            self._learn(missing)
        get = self.row.__getitem__
        for i, words in enumerate(split):
            if words:
                out[i] = self.sums[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0)
        return out


def decide(model: Figures, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: none), score, cross-entropy, whether rejected."""
    n = sums[:, -1]
    if not model.languages:
        return np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
    ce = -sums[:, :-1] / np.maximum(n, 1)[:, None]
    best = ce.argmin(axis=1)
    low = ce[np.arange(len(n)), best]
    score = 1 / np.exp(-np.minimum((ce - low[:, None]) * model.temperature, 700)).sum(axis=1)
    none = n == 0
    return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, low), none | (low > model.limit(best, n))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, n), a word once for each HELD_WORDS or HELD_BYTES of distinct words in a task."""
    release()
    held: dict[str, Counter] = {}

    def close() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            words, counts = list(n), list(n.values())
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array(counts[a : a + 50_000], pa.int64())], names=["lang", "word", "n"])
        held.clear()

    size = 0
    for b in batches:
        for lang, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = held.setdefault(lang, Counter())
            before = len(n)
            words = x.encode("utf-8", "replace").split()
            n.update(words)
            if len(n) > before:
                size += max(map(len, words)) * (len(n) - before)
        if size > HELD_BYTES or sum(map(len, held.values())) > HELD_WORDS:
            yield from close()
            size = 0
    yield from close()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) to (lang, gram, n)."""
    release()
    for b in batches:
        langs, counts = np.asarray(b.column(0).to_pylist(), object), b.column(2).to_numpy()
        words = b.column(1).to_pylist()
        for lang in sorted(set(langs.tolist())):
            mine = np.flatnonzero(langs == lang)
            keys, size = grams_of([words[k] for k in mine])
            grams, at = np.unique(keys, return_inverse=True)
            n = np.zeros(len(grams), np.int64)
            np.add.at(n, at, np.repeat(counts[mine], size))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _calibrate(model: Figures, rows: list) -> None:
    """rows: (lang, sums) of documents that weren't counted."""
    rows = [(model.languages.index(r["lang"]), np.asarray(r["sums"])) for r in rows if r["lang"] in model.languages]
    rows = [(k, s) for k, s in rows if s[-1] > 0]
    if not rows:
        model.spread[:] = 10.0
        return
    lang, sums = np.asarray([k for k, _ in rows]), np.stack([s for _, s in rows])
    n = sums[:, -1]
    ce = -sums[:, :-1] / n[:, None]
    own = ce[np.arange(len(n)), lang]
    grid = np.geomspace(0.5, 200, 40)
    losses = [np.log(np.exp(-np.minimum((ce - own[:, None]) * t, 700)).sum(axis=1)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    every = own.std() if len(own) > 1 else 1.0
    for k in range(len(model.languages)):
        mine = own[lang == k]
        model.mean[k] = np.median(mine) if len(mine) else np.median(own)
        model.spread[k] = max(mine.std() if len(mine) > 9 else every, 0.05)
        model.noise[k] = 1.0


def _gram_counts(texts: DataFrame) -> str:
    """Counts the grams of (lang, text) into a table (lang, gram, n), every gram once; its path."""
    words = texts.select("lang", "text").mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return cut(words.mapInArrow(_count_grams, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")[1]


class Counts:
    """Gram counts in tables of the shared folder, and slices of languages whose models may be broadcast."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.grams = spark.read.schema(COUNTS).parquet(*paths)
        sizes = {r["lang"]: r["n"] for r in self.grams.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
        self.slices: list[list[str]] = [[]]
        for lang in sorted(sizes):
            wide = [*self.slices[-1], lang]
            if self.slices[-1] and sum(sizes[x] for x in wide) * (16 + 8 * len(wide)) > MODEL_BYTES:
                self.slices.append([lang])
            else:
                self.slices[-1] = wide
        self.symbols = self.grams.agg(F.countDistinct(F.col("gram").bitwiseAND(F.lit(0xFFFF)))).first()[0] if len(self.slices) > 1 else None

    def model(self, k: int) -> Model:
        """The model of a slice, built on the driver, a language's counts at a time."""
        found = [self.grams.where(F.col("lang") == name).select("gram", "n").toArrow().replace_schema_metadata({"lang": name}) for name in self.slices[k]]
        return Model(*_by_language(found), symbols=self.symbols)


class SlicedModel(Figures):
    """A model whose slices are built from their counts when they are asked for."""

    def __init__(self, counts: Counts):
        super().__init__([x for part in counts.slices for x in part])
        self.counts = counts


def _by_language(tables: list[pa.Table]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Languages, and the keys and summed counts of each."""
    name = lambda t: t.schema.metadata[b"lang"].decode()
    names = sorted({name(t) for t in tables})
    counts = []
    for lang in names:
        mine = [t for t in tables if name(t) == lang]
        keys, at = np.unique(np.concatenate([t.column("gram").to_numpy() for t in mine]).view(np.uint64), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, at, np.concatenate([t.column("n").to_numpy() for t in mine]))
        counts.append((keys, n))
    return names, counts


def _made(counts: Counts) -> Model | SlicedModel:
    return counts.model(0) if len(counts.slices) == 1 else SlicedModel(counts)


def _with_sums(df: DataFrame, text: str, model: Model | SlicedModel) -> DataFrame:
    """df with ``sums``: of log probabilities by language, and the number of symbols. A pass a slice, each but the last
    written to the shared folder, so that no worker holds two slices."""
    spark = df.sparkSession
    slices = [model] if isinstance(model, Model) else model.counts.slices
    now, path = df.withColumn("sums", F.expr("cast(array() as array<double>)")), None
    at = df.columns.index(text)
    for k in range(len(slices)):
        shared = spark.sparkContext.broadcast(model if isinstance(model, Model) else model.counts.model(k))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value)
            for b in batches:
                new = scorer.score(b.column(at).to_pylist())
                both = [np.append(x[:-1], s) for x, s in zip(b.column(b.num_columns - 1).to_pylist(), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(both, b.schema.types[-1])], schema=b.schema)

        scored = now.mapInArrow(run, now.schema)
        if isinstance(model, Model):
            return scored
        now, new = cut(scored, "sums")
        shared.destroy()
        if path:
            drop(spark, path)
        path = new
    return now


def train(docs: DataFrame, calibrate_docs: int = CALIBRATE_DOCS) -> Model | SlicedModel:
    """A model from docs (doc_id, text, lang); held-out rows are left out here."""
    spark = docs.sparkSession
    prepare(spark)
    usable = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language to learn
    shares = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(0.1, calibrate_docs / r["n"]))))) if sizes else F.expr("map('', 0D)")
    at = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    calibrates = at < F.element_at(shares, F.col("lang"))
    sample, path = cut(usable.where(calibrates).select("lang", "text"), "sample")
    others = _gram_counts(usable.where(~calibrates))
    model = _made(Counts(spark, [others]))
    _calibrate(model, _with_sums(sample, "text", model).select("lang", "sums").collect())  # CALIBRATE_DOCS a language
    more = _gram_counts(sample)
    whole = _made(Counts(spark, [others, more]))
    whole.calibrated_by(model)
    drop(spark, path)
    if isinstance(whole, Model):
        drop(spark, others)
        drop(spark, more)
    return whole


def _scorer(key: str, shared) -> Scorer:
    return keep(("langid", key), lambda: Scorer(shared.value))


def _decided(rows: DataFrame, model: Figures) -> DataFrame:
    """rows with sums to rows with lang_pred, score, cross_entropy, rejected."""
    figures = Figures(model.languages)
    figures.calibrated_by(model)
    names = [*model.languages, "und"]
    kept = rows.drop("sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.array(b.column(b.num_columns - 1).to_pylist(), np.float64).reshape(b.num_rows, len(figures.languages) + 1)
            lang, score, ce, rejected = decide(figures, sums)
            found = [pa.array([names[k] for k in lang], pa.string()), pa.array(score), pa.array(ce), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], names=[*b.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"])

    schema = StructType([*kept.schema.fields, *StructType.fromDDL("lang_pred string, score double, cross_entropy double, rejected boolean").fields])
    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | SlicedModel) -> DataFrame:
    """docs (doc_id, text) to PREDICTED. No shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    if isinstance(model, SlicedModel):
        rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
        return _decided(_with_sums(rows, "text", model).drop("text"), model)
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, shared)
        names = [*scorer.model.languages, "und"]
        for b in batches:
            lang, score, ce, rejected = decide(scorer.model, scorer.score(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([names[k] for k in lang], pa.string()), pa.array(score), pa.array(ce), pa.array(rejected)], names=[c.split()[0] for c in PREDICTED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out")).mapInArrow(run, PREDICTED)


def keep_accepted(docs: DataFrame, model: Model | SlicedModel) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject. No shuffle."""
    prepare(docs.sparkSession)
    if isinstance(model, SlicedModel):
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("t"))
        return _decided(_with_sums(rows, "t", model).drop("t"), model).where(~F.col("rejected")).select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key, column = uuid.uuid4().hex, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, shared)
        for b in batches:
            rejected = decide(scorer.model, scorer.score(b.column(column).to_pylist()))[3]
            yield b.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
