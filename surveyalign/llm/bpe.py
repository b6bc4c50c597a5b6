"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary answers whole pre-tokens. Tier 2: the rest is
merged by a heap over a doubly linked list of byte pieces, lowest rank first, leftmost on ties.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyalign.llm.common import Remembered, slices

#: Encoded pre-tokens in each of the two generations that a worker remembers.
REMEMBERED = 200_000


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings, by hash and displace.

    Keys fall into buckets; the largest buckets choose first a seed that sends all their keys to
    free slots, and buckets of one key take the remaining slots by number. A lookup costs one
    hash and one comparison with the key in the slot, so foreign strings are told apart.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        buckets: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            buckets.setdefault(xxhash.xxh3_64_intdigest(key) % max(n, 1), []).append(i)
        self.seeds = [0] * n
        slots: list[int] = [-1] * n
        singles = []
        for bucket, members in sorted(buckets.items(), key=lambda b: -len(b[1])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            seed = 0
            while True:
                seed += 1
                spots = {xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in members}
                if len(spots) == len(members) and all(slots[s] < 0 for s in spots):
                    break
            self.seeds[bucket] = seed
            for i in members:
                slots[xxhash.xxh3_64_intdigest(keys[i], seed) % n] = i
        free = iter([s for s in range(n) if slots[s] < 0])
        for bucket, i in singles:
            slot = next(free)
            slots[slot] = i
            self.seeds[bucket] = -slot - 1
        self.keys = [keys[i] for i in slots]
        self.values = [values[i] for i in slots]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.n]
        slot = -seed - 1 if seed <= 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return self.values[slot] if self.keys[slot] == key else None


def read_ranks(path: str) -> tuple[list[bytes], list[int]]:
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    return [base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs]


class Encoder:
    """Encoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        keys, values = read_ranks(path)
        self.whole = PerfectHash(keys, values)
        self.ranks = dict(zip(keys, values))
        self.split = regex.compile(pattern).findall
        self.known = Remembered(self.encode_piece, REMEMBERED)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary.

        ``after`` and ``before`` link the live parts by their first byte; ``due[i]`` is the rank
        of the pair that part i begins, and a heap entry that differs from it is out of date.
        Entries order by rank, then by place, in one integer.
        """
        n, get = len(piece), self.ranks.get
        shift = n.bit_length()
        low = (1 << shift) - 1
        after, before = list(range(1, n + 2)), list(range(-1, n))
        due = [get(piece[i:i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [due[i] << shift | i for i in range(n - 1) if due[i] >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & low
            if due[i] != entry >> shift:
                continue
            j = after[i]
            k = after[j]
            due[j] = -1
            after[i] = k
            before[k] = i
            due[i] = rank = get(piece[i:after[k]], -1) if k < n else -1
            if rank >= 0:
                heappush(heap, rank << shift | i)
            h = before[i]
            if h >= 0:
                due[h] = rank = get(piece[h:k], -1)
                if rank >= 0:
                    heappush(heap, rank << shift | h)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.whole.get(raw)
        return array("i", [whole] if whole is not None else self.merge(raw)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        self.known.rest()
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), np.int32)


class Decoder:
    """Bytes of ids, by table."""

    def __init__(self, path: str):
        keys, values = read_ranks(path)
        self.pieces = np.empty(max(values, default=-1) + 1, object)
        self.pieces[values] = keys

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.pieces[ids])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, built from the rank file there, so nothing is broadcast."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text; no shuffle.

    A null text counts as empty and gives an empty list; null and repeated ids keep their rows;
    other columns are not carried. ``rank_file`` is read on every worker.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                coded = [own.encode(t or "") for t in part.column("text").to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
                flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))], ["id", "ids"])

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of every id list as ``out_col``, replacing a column of that name. Null ids give null bytes."""
    names = [c for c in coded.columns if c != out_col]
    where = names.index(ids_col)
    inner = [f"c{i}" for i in range(len(names))]
    source = coded.select(*names).toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(rank_file)
        for batch in batches:
            raw = [own.decode(ids.values.to_numpy()) if ids.is_valid else None for ids in batch.column(where)]
            yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], [*inner, "out"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("out", T.BinaryType())])).toDF(*names, out_col)
