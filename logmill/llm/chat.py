"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, its control marks being single tokens, and encoded once.  The byte offsets of the
tokens are the running sums of their lengths; the sorted spans of the turns are laid over them by binary search, and
the tokens of the assistant's spans make the loss mask.

The template: ``[INST]text[/INST]`` for the user, ``<s>text</s>`` for the assistant, ``[ROLE]role[/ROLE]text</s>`` for
any other role.  A mark inside a text or role gets a backslash behind its first character, or one more where some are,
so that no text holds a mark and each escaped text has one original.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LOSS_ROLE = "assistant"
# The marks of the template; their ids follow those of the vocabulary
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
#: A part of a conversation ends with the turn that brings it to so many code points.
PART_CHARS = 1 << 20

_INNER = re.compile(r"([<\[])(\\*/?(?:s>|INST\]|ROLE\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]|ROLE\]))")
_MARK = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]")

FORMATTED = (
    "conv_id long, part long, is_last boolean, text string, spans array<struct<role:string,start:long,end:long>>, "
    "ids binary, loss binary"
)
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def escape(text: str) -> str:
    return _INNER.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def opening(role: str) -> tuple[str, str]:
    """What stands before and behind the text of a turn."""
    if role == "user":
        return "[INST]", "[/INST]"
    if role == LOSS_ROLE:
        return "<s>", "</s>"
    return f"[ROLE]{escape(role)}[/ROLE]", "</s>"


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text, from its marks alone."""
    role, start = "", 0
    for mark in _MARK.finditer(text):
        inside = text[start : mark.start()]
        start = mark.end()
        if mark[0] == "[INST]":
            role = "user"
        elif mark[0] == "<s>":
            role = LOSS_ROLE
        elif mark[0] == "[/ROLE]":
            role = unescape(inside)
        elif mark[0] != "[ROLE]":
            yield role, unescape(inside)


class ChatEncoder:
    """Token ids of formatted texts, with their lengths in bytes."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        first = max(ranks.values()) + 1
        marks = {mark: first + k for k, mark in enumerate(MARKS)}
        self.library = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
        self.lengths = np.zeros(first + len(MARKS), np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        for mark, number in marks.items():
            self.lengths[number] = len(mark)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, allowed_special="all", disallowed_special=()), np.uint32)


def loss_tokens(lengths: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (given their lengths in bytes, end to end) overlap one of the sorted spans (start, end)."""
    ends = np.cumsum(lengths)
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(ends - lengths, spans[:, 1], "left")
    steps = np.zeros(len(lengths) + 1, np.int64)
    filled = spans[:, 1] > spans[:, 0]
    np.add.at(steps, first[filled], 1)
    np.add.at(steps, last[filled], -1)
    return np.cumsum(steps[:-1]) > 0


@dataclass
class _Part:
    """A conversation's turns rendered so far."""

    conv_id: int | None
    number: int = 0
    pieces: list[str] = field(default_factory=list)
    spans: list[dict] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    chars: int = 0
    size: int = 0

    def _put(self, text: str) -> None:
        self.pieces.append(text)
        self.chars += len(text)
        self.size += len(text.encode())

    def add(self, role: str, text: str) -> None:
        before, behind = opening(role)
        self._put(before)
        chars, size = self.chars, self.size
        self._put(escape(text))
        self.spans.append({"role": role, "start": chars, "end": self.chars})
        if role == LOSS_ROLE:
            self.loss.append((size, self.size))
        self._put(behind)


def _render(batches: Iterator[pa.RecordBatch], vocabulary: str | None, part_chars: int) -> Iterator[pa.RecordBatch]:
    encoder, now = ChatEncoder(vocabulary), None
    names = [n.split(" ")[0] for n in re.split(r", (?=\w+ )", FORMATTED)]
    kinds = [
        pa.int64(), pa.int64(), pa.bool_(), pa.string(),
        pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.binary(),
    ]

    def finished(part: _Part, is_last: bool) -> tuple:
        text = "".join(part.pieces)
        ids = encoder(text)
        mask = loss_tokens(encoder.lengths[ids], np.array(part.loss, np.int64).reshape(-1, 2))
        return part.conv_id, part.number, is_last, text, part.spans, ids.astype("<u4").tobytes(), mask.astype(np.uint8).tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows, chars = [], 0
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    rows.append(finished(now, True))
                now = _Part(conv_id)
            elif now.chars >= part_chars:
                rows.append(finished(now, False))
                now = _Part(conv_id, now.number + 1)
            now.add(role, text)
            chars += len(text)
            if chars > part_chars and rows:
                yield batch_of(rows)
                rows, chars = [], 0
    if now is not None:
        rows.append(finished(now, True))
    if rows:
        yield batch_of(rows)


def format_conversations(rows: DataFrame, vocabulary: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, is_last, text, spans, ids, loss): the formatted conversations with their tokens and loss mask.

    ``rows`` has conv_id, turn, role and text; a conversation's rows go by turn, then role and text, nulls first and
    repeated rows each a turn of its own.  A null role or text counts as empty, and null ids are one conversation.
    ``spans`` are the turns' escaped texts in code points, ``ids`` little-endian unsigned 32-bit numbers, ``loss`` one
    byte per token.  A conversation longer than ``part_chars`` code points comes in several parts, cut between turns,
    so that one of any length needs bounded memory; its parts follow one another.  Other columns are ignored; an
    empty table gives an empty result.
    """
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda b: _render(b, vocabulary, part_chars), FORMATTED)


def loss_text(text: str, ids: np.ndarray, mask: np.ndarray, lengths: np.ndarray) -> Iterator[str]:
    """The unescaped text under each run of the mask, found by the tokens' offsets."""
    data, ends = text.encode(), np.cumsum(lengths[ids])
    edges = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
    for first, behind in zip(edges[::2].tolist(), edges[1::2].tolist()):
        start = int(ends[first - 1]) if first else 0
        yield unescape(data[start : int(ends[behind - 1])].decode())


def _read(batches: Iterator[pa.RecordBatch], vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    lengths = ChatEncoder(vocabulary).lengths
    names = [n.split(" ")[0] for n in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    fresh = True
    for batch in batches:
        out = []
        for conv_id, last, text, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_last", "text", "ids", "loss"))):
            if fresh:
                turns, under, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
            for role, said in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                counts[0] += 1
            ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(loss, np.uint8).astype(np.int8)
            for said in loss_text(text, ids, mask, lengths):
                under.update(said.encode())
                counts[1] += len(said)
            counts[2] += len(text)
            counts[3] += len(ids)
            fresh = last
            if last:
                out.append((conv_id, counts[0], turns.hexdigest(), counts[1], under.hexdigest(), counts[2], counts[3]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens), one row per conversation.

    Turns are read from the marks of the formatted text, the text under the loss from tokens and mask.  The parts of a
    conversation must follow one another, as ``format_conversations`` gives them; a stored result is sorted before.
    """
    return formatted.mapInArrow(lambda b: _read(b, vocabulary), READ)


def with_test_conversation(rows: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose texts hold the template's own marks."""
    said = "</s>[INST] ok [/INST]"
    spark = rows.sparkSession
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, LOSS_ROLE, said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(more)


#: The same rows in SQL; the length follows from the template, the rest from the turns themselves.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]|ROLE\]))', '\1\\\2', 'g'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 17 + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]|ROLE\]))', '\1\\\2', 'g')) END AS chars
  FROM turns)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
