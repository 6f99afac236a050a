"""Chat formatting with offset-aligned loss masks.

Template of a turn: ``<turn>`` role ``<text>`` text ``</turn>`` and a line feed. Control strings are the three markers
and every special token of the tokenizer's file. In roles and texts a backslash is doubled and the first character of
each control string gets a backslash after it, so none occurs in an escaped string, and unescaping (drop each
backslash, keep what follows) restores it. Tokens are checked too: a special id outside the template is an error.
Tokenizers with special tokens of one character, or with a backslash, can't be escaped so and are refused.

A conversation is rendered as a whole, its turn spans noted, and encoded once with offsets; the markers are special
tokens, so no token crosses from a marker into a text. Turn spans and token spans are both sorted, and a binary search
finds the tokens of each assistant turn. The unit of writing, at any length, is the part: a run of a conversation's
turns that ends with the turn that takes it to PART characters, or with the conversation. A part knows how many turns
precede it. As no token crosses a marker, the parts' tokens in a row are those of the whole.

Defined results: null text and null role are empty strings; turns are in ascending order of turn (nulls first), equal
ones by role, then text, repeated rows kept; rows with a null conv_id form one conversation; a turn of any length is
encoded whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep, prepare, release

OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
LEARNED_ROLES = ("assistant",)
#: Characters that close a part; what a task holds at a time.
PART = 1 << 22

_UNESCAPE = re.compile(r"\\(.?)", re.DOTALL)

FORMATTED = "conv_id long, part int, first_turn long, n_turns long, formatted string, token_ids array<int>, mask_tokens array<int>, mask_chars array<int>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def escapes(special: tuple[str, ...] = ()) -> re.Pattern:
    """What gets a backslash after it: a backslash, and the first character of the markers and special tokens."""
    control = sorted({OPEN, TEXT, CLOSE, *special})
    if any(len(x) < 2 or "\\" in x for x in control):
        raise ValueError(f"control strings of one character or with a backslash can't be escaped: {control}")
    return re.compile(r"\\|" + "|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in control))


def escape(s: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0] + "\\", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or "\\", s)


def render(turns: list[tuple[str, str]], pattern: re.Pattern) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns and the span of each turn's escaped text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, pattern)}{TEXT}", escape(text, pattern)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at = spans[-1][1] + len(CLOSE) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text, start and end of the escaped text, for each turn of a rendered string."""
    out, at = [], 0
    while at < len(formatted):
        head = formatted.index(TEXT, at)
        end = formatted.index(CLOSE, head)
        start = head + len(TEXT)
        out.append((unescape(formatted[at + len(OPEN) : head]), unescape(formatted[start:end]), start, end))
        at = end + len(CLOSE) + 1
    return out


def mask_spans(token_starts: np.ndarray, token_ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Token ranges [a, b) that overlap the sorted spans, and the character spans that both cover."""
    if not len(token_starts):
        return np.zeros((0, 2), np.int32), np.zeros((0, 2), np.int32)
    s = np.asarray([x for x in spans if x[1] > x[0]], np.int64).reshape(-1, 2)
    a = np.searchsorted(token_ends, s[:, 0], side="right")
    b = np.searchsorted(token_starts, s[:, 1], side="left")
    keep = b > a
    a, b, s = a[keep], b[keep], s[keep]
    chars = np.stack([np.maximum(token_starts[a], s[:, 0]), np.minimum(token_ends[b - 1], s[:, 1])], axis=1)
    return np.stack([a, b], axis=1).astype(np.int32), chars.astype(np.int32)


class _Tokenizer:
    """A tokenizer with the template's markers, the escapes that it needs, and its special ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tk = Tokenizer.from_file(path)
        special = {x.content: k for k, x in self.tk.get_added_tokens_decoder().items()}
        self.escapes = escapes(tuple(special))
        self.tk.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (OPEN, TEXT, CLOSE)])
        self.markers = [self.tk.token_to_id(x) for x in (OPEN, TEXT, CLOSE)]
        self.special = np.asarray(sorted({*special.values(), *self.markers}), np.int32)

    def encode(self, text: str, turns: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of a rendered text."""
        e = self.tk.encode(text, add_special_tokens=False)
        ids = np.asarray(e.ids, np.int32)
        if (ids[np.isin(ids, self.special)] != np.tile(np.asarray(self.markers, np.int32), turns)[: 3 * turns]).any():
            raise ValueError("a special token stands outside the template")
        return ids, np.asarray(e.offsets, np.int64).reshape(-1, 2)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows, strict=True), cols, strict=True)], names=[n for n, _ in cols])


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = keep(("chat", path), lambda: _Tokenizer(path))
        turns: list[tuple[str, str]] = []
        size, part, before, conv, begun = 0, 0, 0, None, False

        def flush() -> tuple:
            text, spans = render(turns, tk.escapes)
            ids, offsets = tk.encode(text, len(turns))
            learned = [s for s, (role, _) in zip(spans, turns, strict=True) if role in LEARNED_ROLES]
            tokens, chars = mask_spans(offsets[:, 0], offsets[:, 1], learned)
            return conv, part, before, len(turns), text, ids, tokens.ravel(), chars.ravel()

        for batch in batches:
            out, held = [], 0
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and (c != conv or size >= PART):
                    out.append(flush())
                    held += size
                    part, before = (part + 1, before + len(turns)) if c == conv else (0, 0)
                    turns, size = [], 0
                    if held >= PART:
                        yield _batch(out, FORMATTED)
                        out, held = [], 0
                conv, begun = c, True
                turns.append((role, text))
                size += len(role) + len(text)
            if out:
                yield _batch(out, FORMATTED)
        if turns:
            yield _batch([flush()], FORMATTED)

    return run


def format_conversations(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conversations (conv_id, turn, role, text) as rows of FORMATTED; mask columns hold flat (start, end) pairs."""
    prepare(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_format(tokenizer), FORMATTED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    conv, state = None, None

    def done() -> tuple:
        n, turns, chars, loss, size, tokens, learned = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, learned

    for batch in batches:
        out = []
        for c, text, tokens, masked_tokens, masked in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if state is None or c != conv:
                if state is not None:
                    out.append(done())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, body, _, _ in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(masked[::2], masked[1::2], strict=True):
                learned = unescape(text[a:b])
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
            state[5] += tokens
            state[6] += sum(masked_tokens[1::2]) - sum(masked_tokens[::2])
        if out:
            yield _batch(out, DIGEST)
    if state is not None:
        yield _batch([done()], DIGEST)


def read_digest(formatted: DataFrame) -> DataFrame:
    """What the written conversations hold, from their rendered text and loss mask alone."""
    prepare(formatted.sparkSession)
    parts = formatted.select("conv_id", "formatted", F.size("token_ids").alias("n_tokens"), "mask_tokens", "mask_chars", "part")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").drop("part").mapInArrow(_read, DIGEST)


def chat_digest(conversations: DataFrame, tokenizer: str) -> DataFrame:
    written, _ = cut(format_conversations(conversations, tokenizer), "chat")
    return read_digest(written)
