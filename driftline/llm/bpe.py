"""Token ids of whole texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: The published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_FOLDER = "/opt/tokenizers"
#: Encoded pre-tokens that a worker keeps, and the letters of the longest it keeps, which bounds the store in bytes;
#: it is emptied when full, and longer ones are merged each time: both cost time but change nothing.
KEPT, KEPT_LETTERS = 300_000, 48


class RankQueue:
    """Positions waiting under merge ranks; the lowest rank is found by first-set bits of a bitmap of three levels."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // 64 + 1)
        self.groups = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.words[rank >> 6] |= 1 << (rank & 63)
        self.groups[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank with its leftmost position."""
        if not self.top:
            return None
        g = (self.top & -self.top).bit_length() - 1
        w = g << 6 | (self.groups[g] & -self.groups[g]).bit_length() - 1
        rank = w << 6 | (self.words[w] & -self.words[w]).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[w] &= self.words[w] - 1
            if not self.words[w]:
                self.groups[g] &= self.groups[g] - 1
                if not self.groups[g]:
                    self.top &= self.top - 1
        return rank, position


class Encoder(dict):
    """Ids by pre-token; what is missing is merged once and kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) > KEPT_LETTERS:
            return self.merge(piece.encode())
        if len(self) >= KEPT:
            self.clear()
        ids = self[piece] = self.merge(piece.encode())
        return ids

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the bytes of one pre-token, lowest rank first, leftmost first among equals.

        Tokens are nodes of a linked list, named by their first byte's place. ``pair`` holds the rank of a node
        joined with the next; a queued position whose pair has another rank by now is stale and skipped.
        """
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        queue = self.queue
        following, previous, pair = list(range(1, n + 2)), list(range(-1, n)), [-1] * n
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue
            gone = following[i]
            after = following[i] = following[gone]
            pair[gone] = pair[i] = -1
            if after < n:
                previous[after] = i
                joined = ranks.get(piece[i : following[after]])
                if joined is not None:
                    pair[i] = joined
                    queue.push(joined, i)
            before = previous[i]
            if before >= 0:
                joined = ranks.get(piece[before:after])
                if joined is None:
                    pair[before] = -1
                elif joined != pair[before]:
                    pair[before] = joined
                    queue.push(joined, before)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : following[i]]])
            i = following[i]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.split(text)))) if text else 0


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary to the workers, once per application: they need not have the folder. Returns the file's name."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_driftline_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            ends, flat = [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(chain.from_iterable(map(own.__getitem__, own.split(text))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    return run


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            *others, texts = batch.columns
            counts = pa.array([own.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*others, counts], [*batch.schema.names[:-1], "n_tokens"])

    return run


def encode(df: DataFrame, key: str, text: str, vocabulary_path: str | None = None) -> DataFrame:
    """Ids of each text: ``key, ids array<int>``. Rows are neither moved nor grouped; texts are taken whole.

    Merging follows the ranks of the vocabulary through a bitmap rank queue, whose time stays near linear for very
    long pre-tokens. Null and empty texts have the empty list of ids. Special tokens in a text are ordinary text.
    Rows repeated are encoded each. The vocabulary is read at ``vocabulary_path`` by the driver and sent to the workers.
    """
    name = _shipped(df.sparkSession, vocabulary_path or vocabulary())
    kind = dict(df.dtypes)[key]
    out = df.select(key, text).mapInArrow(_encode(name), f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keys: list[str], text: str, vocabulary_path: str | None = None) -> DataFrame:
    """Sizes of texts in tokens: ``keys, n_tokens``; 0 for null and empty texts."""
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, text).mapInArrow(_count(_shipped(df.sparkSession, vocabulary_path or vocabulary())), f"{fields}, n_tokens long")
