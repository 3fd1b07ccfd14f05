"""Byte-level BPE: encoding and decoding with length-bucketed numpy matrices.

The distinct pieces of a batch lie in padded matrices, one for each bucket of lengths. Each
round, every row merges its leftmost pair of least rank; the pair's column goes and the
matrix is compacted, and rows without a pair leave it. Ranks of pairs come from an
open-addressing hash table over (left id, right id). A row too long for a bucket is merged in the
same order, leftmost pair of least rank first, with a heap of its pairs in place of a search of
the whole row each round.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from rasterweave.llm.tokens import bounded_batches, release

#: No merge. Ranks are below it.
NONE = 2**31 - 1
#: Upper ends of the buckets of piece lengths in bytes; longer pieces are rows of their own.
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Characters that are encoded together, and pieces that a worker remembers.
CHARS, PIECES = 1_000_000, 150_000
#: Rows whose ids a worker holds at once.
ROWS = 256


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line.strip())}


class Pairs:
    """Rank of the token that two tokens make, by linear probing; built from the ranks alone."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.bits = max(10, (2 * len(keys)).bit_length() + 1)
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left_k, left_v = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(left_k)
        while len(left_k):  # the first comer of a slot stays, the others go on
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(at), bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]] = left_k[wins]
            self.values[at[wins]] = left_v[wins]
            left_k, left_v, at = left_k[~wins], left_v[~wins], (at[~wins] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is no such token or an id is below 0."""
        shape = left.shape
        keys = (left.astype(np.int64).ravel() << 32) | right.astype(np.int64).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out.reshape(shape)


class BPE:
    """An encoder and decoder for ranks and a pattern that splits text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs, self.pattern = ranks, Pairs(ranks), regex.compile(pattern)
        self.byte = np.full(256, -1, np.int32)
        for b in range(256):
            if bytes([b]) not in ranks:
                raise ValueError(f"byte {b} has no rank")
            self.byte[b] = ranks[bytes([b])]
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.known: dict[str, bytes] = {}
        self.by_pair: dict[int, int] | None = None

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as the bytes of int32."""
        out: list[bytes] = [b""] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                out[i] = np.int32(rank).tobytes()
            elif p:
                by.setdefault(next((b for b in BUCKETS if len(p) <= b), 0), []).append(i)
        for width, rows in by.items():
            if width:
                for some in (rows[k : k + 20_000] for k in range(0, len(rows), 20_000)):
                    self._bucket(pieces, some, width, out)
            else:
                for i in rows:
                    out[i] = self._long(pieces[i])
        return out

    def _bucket(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        size = np.fromiter((len(pieces[i]) for i in rows), np.int64, len(rows))
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        who = np.array(rows)
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(who):
            at = rank.argmin(1)
            each = np.arange(len(who))
            best = rank[each, at]
            done = best == NONE
            if done.any():
                ended = ids[done]
                for i, row, n in zip(who[done].tolist(), ended, (ended >= 0).sum(1).tolist(), strict=True):
                    out[i] = row[:n].tobytes()
                on = ~done
                who, ids, rank, at, best = who[on], ids[on], rank[on], at[on], best[on]
                each = np.arange(len(who))
                if not len(who):
                    return
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(who), -1)
            if ids.shape[1] == 1:
                for i, row in zip(who.tolist(), ids, strict=True):
                    out[i] = row.tobytes()
                return
            keep = np.ones(rank.shape, bool)  # the merged pair's rank goes, its neighbours' change
            keep[each, at] = False
            rank = rank[keep].reshape(len(who), -1)
            left, right = at > 0, at < rank.shape[1]
            r = each[left]
            rank[r, at[left] - 1] = self.pairs(ids[r, at[left] - 1], best[left])
            r = each[right]
            rank[r, at[right]] = self.pairs(best[right], ids[r, at[right] + 1])

    def _long(self, piece: bytes) -> bytes:
        """One long row: its pairs lie in a heap by rank and place, its tokens in a linked list; a merge costs the logarithm of the length."""
        if self.by_pair is None:
            full = self.pairs.keys >= 0
            self.by_pair = dict(zip(self.pairs.keys[full].tolist(), self.pairs.values[full].tolist(), strict=True))
        rank_of = self.by_pair.get
        start = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs(start[:-1], start[1:])
        at = np.flatnonzero(first != NONE)
        heap = ((first[at].astype(np.int64) << 32) | at).tolist()  # a rank and a place in one number; places are below 2^32
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        n = len(start)
        ids, rank = start.tolist(), first.tolist() + [NONE]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            if rank[i] != entry >> 32:  # the pair that began here is gone
                continue
            ids[i] = new = entry >> 32
            gone = after[i]
            rank[gone], ids[gone] = -1, -1
            right = after[i] = after[gone]
            if right < n:
                before[right] = i
                rank[i] = r = rank_of((new << 32) | ids[right], NONE)
                if r != NONE:
                    push(heap, (r << 32) | i)
            else:
                rank[i] = NONE
            left = before[i]
            if left >= 0:
                rank[left] = r = rank_of((ids[left] << 32) | new, NONE)
                if r != NONE:
                    push(heap, (r << 32) | left)
        out = np.array(ids, np.int32)
        return out[out >= 0].tobytes()

    def _learn(self, pieces: set[str]) -> None:
        if pieces:
            new = list(pieces)
            self.known.update(zip(new, self.merge([p.encode("utf-8", "replace") for p in new]), strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text as int32; null is empty."""
        split, known = self.pattern.findall, self.known
        at = 0
        while at < len(texts):
            if len(known) > PIECES:
                known.clear()
            some, chars = [], 0
            while at < len(texts) and (not some or chars < CHARS):
                text = texts[at] or ""
                some.append(split(text))
                chars += len(text)
                at += 1
            fresh: set[str] = set()
            for pieces in some:
                fresh.update(pieces)
            self._learn(fresh.difference(known))
            get = known.__getitem__
            for pieces in some:
                yield np.frombuffer(b"".join(map(get, pieces)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_made: dict[tuple[int, str], BPE] = {}


def _coder(ranks, pattern: str) -> BPE:
    """The worker's coder; its tables are built once."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = BPE(parse_ranks(ranks.value), pattern)
    return _made[key]


def coder(spark: SparkSession, path: str, pattern: str):
    """(encode, decode): functions from a column to a column. path: the rank file, as the driver sees it.

    encode: a text's ids, array<int> (null: no ids). decode: the bytes of ids (null: none).
    The file's bytes are broadcast; its vocabulary bounds them.
    """
    bounded_batches(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _coder(ranks, pattern)
        for part in parts:
            yield pd.Series(list(bpe.encode(part.tolist())), dtype=object)

    @F.pandas_udf("binary")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _coder(ranks, pattern)
        for part in parts:
            yield pd.Series([b"" if x is None else bpe.decode(np.asarray(x, np.int32)) for x in part], dtype=object)

    return encode, decode


def _pieces(batches: Iterator[pa.RecordBatch], text_col: str, bpe: BPE) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[np.ndarray]]]:
    """(rows, texts, ids) of ROWS rows at a time, so that a worker never holds the ids of a whole Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = part.column(text_col).to_pylist()
            yield part, texts, list(bpe.encode(texts))
    bpe.known.clear()
    release()


def encoded(spark: SparkSession, docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs without text_col, with ids (array<int>; null: none) and intact: whether the ids decode to the text. Columns of these names are replaced."""
    bounded_batches(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    docs = docs.select(text_col, *[c for c in docs.columns if c not in (text_col, "ids", "intact")])
    kept = docs.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(ranks, pattern)
        for part, texts, ids in _pieces(batches, text_col, bpe):
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            intact = pa.array([bpe.decode(x) == (t or "").encode("utf-8", "replace") for x, t in zip(ids, texts, strict=True)])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists, intact], names=[*kept, "ids", "intact"])

    schema = StructType([*[docs.schema[c] for c in kept], StructField("ids", ArrayType(IntegerType())), StructField("intact", BooleanType())])
    return docs.mapInArrow(run, schema)


def digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs without text_col, with n_tokens, ids_sha256 and decoded_sha256: each text is encoded, its ids are decoded, and both are hashed in the same pass."""
    bounded_batches(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    docs = docs.select(text_col, *[c for c in docs.columns if c not in (text_col, *names)])
    kept = docs.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(ranks, pattern)
        for part, _, ids in _pieces(batches, text_col, bpe):
            found = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]),
                pa.array([sha256(bpe.decode(x)).hexdigest() for x in ids]),
            ]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *found], names=[*kept, *names])

    schema = StructType([*[docs.schema[c] for c in kept], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return docs.mapInArrow(run, schema)
