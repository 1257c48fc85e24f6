"""Splitting oversized texts at natural boundaries, by content-defined landmarks.

A gear hash rolls over the token ids. A landmark is a boundary that is the best within LEAST tokens on either side: of
the most natural kind there (paragraph, else line, else sentence, else a character), and of these the one with the
smallest hash. Text is cut at every landmark; a stretch between two landmarks that is too long for one piece is halved
by the same rule. No cut depends on an earlier one, so an edit can move cuts only within LEAST tokens of it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowloom.llm import bpe

LIMIT, OVERLAP = 512, 32
#: Smallest piece before its overlap, and the tokens that the rolling hash sees.
LEAST, SEEN = 160, 16
_BOUNDARIES = (
    regex.compile(rb"\r?\n[ \t]*\r?\n\s*"),
    regex.compile(rb"\r?\n\s*"),
    regex.compile("(?:[.!?]+[\"')\\]]*\\s+|[。！？]+[」』]*|।\\s*)".encode()),
)


def gear(size: int) -> np.ndarray:
    """One fixed pseudo-random 64-bit number for each token id (splitmix)."""
    z = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def rolled(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hash of the SEEN tokens before each position between tokens 0 .. n; the first position has none."""
    value, h = table[ids], np.zeros(len(ids) + 1, dtype=np.uint64)
    for k in range(min(SEEN, len(ids))):
        h[k + 1 :] += value[: len(ids) - k] << np.uint64(k)
    # high bits have seen all tokens, so they decide
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


def boundary_ranks(data: bytes, ends: np.ndarray) -> np.ndarray:
    """For each position between tokens 0 .. n: 0 after a paragraph, 1 after a line, 2 after a sentence, 3 at the start
    of a character, 4 within one. A boundary inside a token counts for the token's start, so that it stays whole."""
    n = len(ends)
    starts = np.r_[0, ends]
    first = np.frombuffer(data + b" ", dtype=np.uint8)[starts]
    rank = np.where((first & 0xC0) == 0x80, 4, 3)
    for level in (2, 1, 0):
        at = np.fromiter((m.end() for m in _BOUNDARIES[level].finditer(data)), dtype=np.int64)
        token = np.searchsorted(starts, at, side="right") - 1
        token = token[(token > 0) & (token < n)]
        rank[token[rank[token] <= 3]] = level
    return rank


_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _window_least(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, in linear time: key[i : i + width] for each i."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, _NEVER, dtype=np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def landmarks(key: np.ndarray, least: int) -> np.ndarray:
    """Positions whose key is below all keys of the ``least`` positions before and not above those behind."""
    wide = np.full(len(key) + 2 * least, _NEVER, dtype=np.uint64)
    wide[least : least + len(key)] = key
    best = _window_least(wide, least)  # best[i] covers the positions i - least .. i - 1
    before, behind = best[: len(key)], best[least + 1 : least + 1 + len(key)]
    return np.flatnonzero((key < before) & (key <= behind) & (key != _NEVER))


def cuts(ids: np.ndarray, rank: np.ndarray, hashes: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Token positions at which the pieces' own parts start; the first is 0.

    No part is shorter than the smaller of LEAST and a third of what a piece holds besides its overlap, none longer
    than that. Where no start of a character lies far enough from the ends, a part may start within one.
    """
    n, room = len(ids), limit - overlap
    least = max(1, min(LEAST, room // 3))
    key = (rank.astype(np.uint64) << np.uint64(61)) | (hashes[: len(rank)] >> np.uint64(3))
    key = np.r_[key, _NEVER][: n + 1]
    key[: least], key[max(0, n - least + 1) :] = _NEVER, _NEVER
    bounds = [0, *landmarks(key, least).tolist(), n]
    out, todo = [], list(zip(bounds, bounds[1:]))[::-1]
    while todo:
        a, b = todo.pop()
        if b - a <= (room if a else limit):
            out.append(a)
            continue
        at = a + least + int(np.argmin(key[a + least : b - least + 1]))
        todo += [(at, b), (a, at)]
    return out


def split(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, piece_no, n_pieces, start_token, end_token, cut_kind, ids, piece): the pieces of texts of more than ``limit`` tokens.

    A piece has at most ``limit`` tokens and starts with the last ``overlap`` tokens of the piece before it. ``cut_kind``
    says what stands before its own part: start, paragraph, line, sentence, character, or byte (only where a run of
    tokens has no start of a character). ``piece`` is the decoded text; where the overlap starts inside a character its
    torn bytes read U+FFFD. Null, empty and shorter texts give no rows. Whole texts are read, of any length.
    """
    make = bpe.encoder_for(documents, vocabulary, pattern)
    kinds = ("paragraph", "line", "sentence", "character", "byte")
    name = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        strings = encoder.strings()
        width = np.array([len(s) for s in strings], dtype=np.int64)
        table = gear(len(strings))
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            keys = batch.column(0)
            for i, value in enumerate(batch.column(1)):
                content = value.as_py()
                ids = np.frombuffer(encoder.encode(content), dtype=np.int32) if content else array("i")
                if len(ids) <= limit:
                    continue
                data, ends = content.encode(), np.cumsum(width[ids])
                rank = boundary_ranks(data, ends)
                at = cuts(ids, rank, rolled(ids, table), limit, overlap)
                starts = np.r_[0, ends]
                for j, c in enumerate(at):
                    a, b = max(0, c - overlap) if j else 0, at[j + 1] if j + 1 < len(at) else len(ids)
                    piece = data[starts[a] : starts[b]].decode("utf-8", "replace")
                    rows.append((keys[i].as_py(), j + 1, len(at), a, b, kinds[rank[c]] if j else "start", ids[a:b], piece))
                held += len(data)
                if held > 4_000_000:
                    yield _batch(rows, batch.schema.field(0).type, key)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, batch.schema.field(0).type, key)

    schema = f"`{key}` {name}, piece_no int, n_pieces int, start_token int, end_token int, cut_kind string, ids array<int>, piece string"
    return bpe._balanced(documents.select(key, text)).mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    columns = list(zip(*rows))
    whole = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string()]
    names = [key, "piece_no", "n_pieces", "start_token", "end_token", "cut_kind", "ids", "piece"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *whole])], names)
