"""Byte-level BPE encoding of a corpus with a public vocabulary.

The vocabulary is read once on the driver (under 1 MB, so its broadcast is bounded) and every text is encoded inside
Arrow batches: a regular expression cuts it into words, each distinct word is merged once per task and remembered.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered by one task, and the longest word in characters that is remembered.
CACHE_WORDS, CACHE_CHARS = 400_000, 48


def default_vocabulary() -> tuple[str, str]:
    """(path of byte_bpe_50k's ranks, its word pattern) where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """Encodes texts with the merge ranks of one vocabulary file (lines of base64 token and rank)."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}
        self.words = regex.compile(pattern).findall
        encoder = self

        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                ids = encoder.merge(word.encode())
                if len(word) <= CACHE_CHARS:
                    if len(self) >= CACHE_WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self.known = Known()

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merges by rank from a priority queue over a doubly linked list of symbols.

        Symbol i covers word[i:end[i]]; an entry (rank, i, m, e) says that i..m and m..e may merge, and is stale once
        either symbol has changed. The lowest rank goes first, the leftmost of equal ones.
        """
        rank, n = self.rank, len(word)
        end, before, queue = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (r := rank.get(word[i : i + 2])) is not None:
                queue.append((r, i, i + 1, i + 2))
        heapq.heapify(queue)
        while queue:
            _, i, m, e = heapq.heappop(queue)
            if end[i] != m or end[m] != e:
                continue
            end[i], end[m] = e, -1
            if e < n:
                before[e] = i
                if (r := rank.get(word[i : end[e]])) is not None:
                    heapq.heappush(queue, (r, i, e, end[e]))
            p = before[i]
            if p >= 0 and (r := rank.get(word[p:e])) is not None:
                heapq.heappush(queue, (r, p, i, e))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> array:
        """The ids of a text; none for a null or empty one."""
        return array("i", chain.from_iterable(map(self.known.__getitem__, self.words(text)))) if text else array("i")

    def strings(self) -> list[bytes]:
        """The vocabulary's strings by id."""
        out = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            out[r] = token
        return out

    def decode(self, ids) -> bytes:
        strings = self.strings()
        return b"".join(strings[i] for i in ids)


def encoder_for(df: DataFrame, vocabulary: str | None, pattern: str | None):
    """A function that gives the Encoder inside a task."""
    path, words = default_vocabulary() if vocabulary is None or pattern is None else (vocabulary, pattern)
    with open(vocabulary or path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    words = pattern or words
    return lambda: Encoder(shared.value, words)


def _balanced(df: DataFrame) -> DataFrame:
    """Encoding costs far more than reading: a table in few large files is spread over the cores first."""
    sc = df.sparkSession.sparkContext
    return df.repartition(sc.defaultParallelism * 2) if df.rdd.getNumPartitions() < sc.defaultParallelism else df


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids array<int>): the ids of every text, without special tokens.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. Texts are
    encoded whole, however long; repeated rows stay repeated; other columns are ignored. ``vocabulary`` is the path of
    a ranks file and ``pattern`` its word pattern (byte_bpe_50k of the installed public tokenizers by default).
    """
    make = encoder_for(documents, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for value in batch.column(1):
                flat.extend(encoder.encode(value.as_py()))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return _balanced(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def lengths(documents: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` with the number of tokens of each text; 0 for a null or empty one."""
    make = encoder_for(documents, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            n = array("q", (len(encoder.encode(v.as_py())) for v in batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(memoryview(n), pa.int64())], [*keep, out])

    schema = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return _balanced(documents.select(*keep, F.col(text))).mapInArrow(run, f"{schema}, {out} bigint")
