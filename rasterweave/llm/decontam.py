"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item that share a seed (SEED tokens in a row) are tiled: the longest
match of tokens that no tile has yet is found with running Karp-Rabin hashes and marked, and
so on while matches have SEED tokens or more. Tiles may come in any order, so passages are
caught when they are reordered. A text leaks an item if its tiles cover THRESHOLD of it. An item
shorter than a seed is its own seed: a text leaks it if it has all its tokens in a row. Tokens
are words; scripts that are written without spaces count character by character.

Small benchmarks are broadcast and every text is tiled where it lies. For larger ones a
bitmap of seeds, of fixed size, is broadcast, the seeds that pass it are joined with the
benchmark's, and only the pairs that share one meet.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm.tokens import bounded_batches, fresh, hash64

#: Tokens of a seed and of the shortest tile; share of an item that tiles have to cover.
SEED, THRESHOLD = 5, 0.5
#: Characters of a benchmark up to which it is broadcast, and bits of the seed bitmap beyond it.
BROADCAST_CHARS, BITMAP = 32_000_000, 1 << 27

#: A character of a script without spaces (Thai, Lao, Burmese, Khmer, kana, Han), or a run of others.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Karp-Rabin hashes, modulo 2^64, of the windows of a sequence of ids."""

    def __init__(self, ids: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(2)) * _powers(len(ids), _BASE), dtype=np.uint64)])
        self.back = _powers(len(ids) + 1, _INVERSE)

    def windows(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """Whether each window has free tokens only."""
    shut = np.concatenate([[0], np.cumsum(~free)])
    return shut[size:] == shut[:-size]


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[int]:
    """Lengths of the tiles of two sequences of ids, greedily; negative ids match nothing.

    Of equally long matches the first of the text, then the first of the item, is taken first.
    """
    out: list[int] = []
    a, b = Rolling(item), Rolling(text)
    free_a, free_b = item >= 0, text >= 0

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ha, hb = a.windows(size), b.windows(size)
        at_a = np.flatnonzero(_open(free_a, size))
        at_b = np.flatnonzero(_open(free_b, size))
        ha, hb = ha[at_a], hb[at_b]
        return at_a, at_b[np.isin(hb, ha)], ha

    top = min(len(item), len(text))
    while top >= least:
        low, high = least - 1, top  # the longest common length: if there is a match there is a shorter one
        while low < high:
            mid = (low + high + 1) // 2
            if len(common(mid)[1]):
                low = mid
            else:
                high = mid - 1
        if low < least:
            break
        at_a, hits, _ = common(low)
        marked = False
        for j in hits.tolist():
            if not free_b[j : j + low].all():
                continue
            for i in at_a.tolist():
                if free_a[i : i + low].all() and (item[i : i + low] == text[j : j + low]).all():
                    free_a[i : i + low] = free_b[j : j + low] = False
                    out.append(low)
                    marked = True
                    break
        top = low if marked else low - 1  # a hash without a match of tokens
    return out


class Benchmark:
    """Items by seed. items: (item id, text) of every item; one without tokens can't be leaked."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for key, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int64)
            if len(ids):
                self.items.append((key, ids))
        seeds, owner = [], []
        #: Items shorter than a seed: by length, the hash of all their tokens and their places.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        few: dict[int, list[tuple[int, int]]] = {}
        for k, (_, ids) in enumerate(self.items):
            if len(ids) < SEED:
                few.setdefault(len(ids), []).append((int(Rolling(ids).windows(len(ids))[0]), k))
                continue
            h = np.unique(Rolling(ids).windows(SEED))
            seeds.append(h)
            owner.append(np.full(len(h), k))
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owner = self.seeds[order], self.owner[order]
        for size, found in few.items():
            found.sort()
            self.short[size] = np.array([h for h, _ in found], np.uint64), np.array([k for _, k in found])

    def _whole(self, ids: np.ndarray) -> list[int]:
        """Places of the items shorter than a seed that a text has, all tokens in a row."""
        out = set()
        for size, (hashes, places) in self.short.items():
            if len(ids) < size:
                continue
            open_ = np.flatnonzero(_open(ids >= 0, size))
            h = Rolling(ids).windows(size)[open_]
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.flatnonzero(right > left).tolist():
                for k in places[left[i] : right[i]].tolist():
                    if k not in out and (self.items[k][1] == ids[open_[i] : open_[i] + size]).all():
                        out.add(k)
        return sorted(out)

    def leaks(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
        """(item id, tokens of the item, tokens in tiles, tiles, coverage) of the items that text leaks, in the order of the benchmark."""
        words = words_of(text)
        if not words or not self.items:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        short = {k: (self.items[k][0], n, n, 1, 1.0) for k in self._whole(ids) for n in [len(self.items[k][1])]} if self.short else {}
        found = self._tiled(ids, threshold)
        return [x for _, x in sorted([*short.items(), *found])] if short else [x for _, x in found]

    def _tiled(self, ids: np.ndarray, threshold: float) -> list[tuple[int, tuple]]:
        """(place of the item, what leaks() gives) of items of SEED tokens or more."""
        ok = np.flatnonzero(_open(ids >= 0, SEED)) if len(ids) >= SEED and len(self.seeds) else []
        if not len(ok):
            return []
        h = Rolling(ids).windows(SEED)[ok]
        left = np.searchsorted(self.seeds, h, "left")
        n = np.searchsorted(self.seeds, h, "right") - left
        hit = n > 0
        if not hit.any():
            return []
        at, left, n = ok[hit], left[hit], n[hit]
        owners = self.owner[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        where = np.repeat(at, n)
        out = []
        for k in np.unique(owners).tolist():
            key, item = self.items[k]
            own = where[owners == k]
            near = np.unique((own[:, None] + np.arange(SEED)).ravel())  # tokens in seeds; a gap keeps apart what was apart
            gap = np.flatnonzero(np.diff(near) > 1) + 1
            part = np.insert(ids[near], gap, -1)
            found = tiles(item, part)
            if sum(found) >= threshold * len(item):
                out.append((k, (key, len(item), sum(found), len(found), sum(found) / len(item))))
        return out


_LEAKS = "array<struct<item_id:bigint,item_tokens:int,matched:int,tiles:int,coverage:double>>"


def _records(found: list) -> list[dict]:
    return [dict(zip(("item_id", "item_tokens", "matched", "tiles", "coverage"), x, strict=True)) for x in found]


def _small(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float, text_col: str, out: str) -> DataFrame:
    sent = spark.sparkContext.broadcast([(r["item_id"], r["_item"]) for r in items.orderBy("item_id", "_item").collect()])

    @F.pandas_udf(_LEAKS)
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Benchmark(sent.value)
        for part in parts:
            yield pd.Series([_records(own.leaks(t, threshold)) for t in part], dtype=object)

    return docs.withColumn(out, leaks(F.col(f"`{text_col}`")))


def _large(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float, text_col: str, out: str) -> DataFrame:
    def hashes_of(text: str) -> np.ndarray:
        return hash64(words_of(text), 21) >> np.uint64(2)  # of tokens themselves: there is no vocabulary to share

    @F.pandas_udf("int")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(words_of(t)))

    lengths = [r["n"] for r in items.select(tokens("_item").alias("n")).where(f"n > 0 AND n < {SEED}").distinct().collect()]  # SEED - 1 at most

    def seeds_of(text: str, whole: bool = False) -> np.ndarray:
        """Hashes of the seeds of a text, and of its windows that could be items shorter than a seed. whole: an item, which is its own seed if it is short."""
        ids = hashes_of(text)
        sizes = [min(len(ids), SEED)] if whole else [SEED, *lengths]
        found = [Rolling(ids).windows(n) + np.uint64(n) for n in sizes if 0 < n <= len(ids)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def item_bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bitmap // 8, np.uint8)
        for part in parts:
            for text in part["_item"]:
                bit = seeds_of(text, True) % np.uint64(bitmap)
                np.bitwise_or.at(own, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [zlib.compress(own.tobytes(), 1)]})

    bitmap = BITMAP
    bits = np.zeros(bitmap // 8, np.uint8)
    for r in items.select("_item").coalesce(64).mapInPandas(item_bits, "bits binary").toLocalIterator():  # one bitmap at a time
        bits |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    def emit(column: str):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = sent.value
            for part in parts:
                keys, seeds = [], []
                for key, text in zip(part["_key"], part[column], strict=True):
                    h = seeds_of(text or "", column == "_item")
                    bit = h % np.uint64(bitmap)
                    h = h[(own[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    keys.append(np.full(len(h), key))
                    seeds.append(h.astype(np.int64))
                yield pd.DataFrame({"k": np.concatenate(keys) if keys else np.zeros(0, np.int64), "seed": np.concatenate(seeds) if seeds else np.zeros(0, np.int64)})

        return run

    text = F.col(f"`{text_col}`")
    items = items.withColumn("_key", F.xxhash64("item_id", "_item"))
    texts = docs.select(F.xxhash64(text).alias("_key"), text.alias("_text")).dropDuplicates(["_key"])  # equal texts have equal leaks
    a = texts.mapInPandas(emit("_text"), "k bigint, seed bigint").select(F.col("k").alias("_key"), "seed")
    b = items.select("_key", "_item").mapInPandas(emit("_item"), "k bigint, seed bigint").select(F.col("k").alias("_item_key"), "seed")
    pairs = a.join(b, "seed").select("_key", "_item_key").distinct()
    pairs = pairs.join(items.select(F.col("_key").alias("_item_key"), "item_id", "_item"), "_item_key").join(texts, "_key")

    @F.pandas_udf(_LEAKS)
    def tiled(item_ids: pd.Series, own: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([_records(Benchmark([(i, x)]).leaks(t, threshold)) for i, x, t in zip(item_ids, own, text, strict=True)], dtype=object)

    found = pairs.select("_key", F.explode(tiled("item_id", "_item", "_text")).alias("x")).groupBy("_key").agg(F.array_sort(F.collect_list("x")).alias("_leaks"))
    key = fresh(docs, "_key")
    joined = docs.join(found.withColumnRenamed("_key", key).withColumnRenamed("_leaks", out), F.xxhash64(text) == F.col(key), "left").drop(key)
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast(_LEAKS)))


def with_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", broadcast_chars: int = BROADCAST_CHARS, out: str = "_leaks") -> DataFrame:
    """docs with the column out: the benchmark items that each text leaks (array of item_id, item_tokens, matched, tiles, coverage).

    Null and empty texts leak nothing. Items of fewer than SEED tokens are leaked as a whole;
    items without a token or with a null text are left out; repeated items are tiled one by
    one. Other columns of docs stay; one named as out is replaced.
    """
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("_item")).where("_item IS NOT NULL")
    chars = items.agg(F.sum(F.length("_item"))).first()[0] or 0
    return (_small if chars <= broadcast_chars else _large)(spark, docs.drop(out), items, threshold, text_col, out)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that leak no item, with the columns of docs."""
    own = fresh(docs, "_leaks")
    return with_leaks(spark, docs, benchmark, threshold, out=own).where(F.size(own) == 0).drop(own)
