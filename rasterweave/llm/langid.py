"""Language identification in two steps: the family, then the language within it.

A text is the shares of hashed character n-grams of its words. Linear support vector machines
decide: one for each pair of families, then, within the family that won, one for each pair of
its languages; the side with more wins goes on, and the sum of margins parts ties. Texts are
scored whole. As every machine is linear, a word's contribution to all machines is computed
once for each distinct word of a worker.

Machines only compare languages. That a text is in none of them is told by the share of its
n-grams of LONG characters that two documents of the winner's sample have: under the language's threshold,
which is set on documents of the sample that are left out for it, the score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm.tokens import TokenTable, bounded_batches, mix64, release

#: Hash slots of n-grams, lengths of n-grams, and documents that the machines are fitted on for each language and in all (a bounded sample by a hash of id and text).
SLOTS, LENGTHS, PER_LANGUAGE, IN_ALL = 8192, (1, 2, 3, 4), 600, 60_000
#: Weights of all machines together, bits of all languages' known n-grams together, and numbers of a worker's table of words: with many languages, slots are folded so that these hold.
WEIGHTS, BITS, TABLE = 1 << 24, 1 << 28, 1 << 24
#: Languages of each family; a language that is not here is a family of its own.
FAMILIES: Mapping[str, tuple[str, ...]] = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "indic": ("hi", "bn", "ur", "pa", "mr", "gu", "ne", "si"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue"),
    "dravidian": ("ta", "te", "kn", "ml"),
}
#: Length of the n-grams that a language is known by, their slots, and documents of a language that are needed to set its threshold.
LONG, LONG_SLOTS, CALIBRATED_FROM = 4, 1 << 20, 30
#: A threshold is FITTING times the share that 99 % of the left out documents reach; a text with fewer than LEAST_LONG such n-grams is not judged.
FITTING, LEAST_LONG = 0.8, 10
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; signs that only count as numbers make no word."""
    words = _WORD.findall(text.lower()) if text else []
    return words if not words or text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def folded(most: int, each: int, least: int = 64) -> int:
    """The greatest power of two up to most of which each can be held, but least at least."""
    size = most
    while size > least and size * each > (WEIGHTS if most == SLOTS else BITS):
        size //= 2
    return size


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, index of the word) of each n-gram of words that are marked at both ends."""
    marked = [f" {w} " for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the word's end
    slots, owner = [], []
    key = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(LENGTHS) + 1):
            key = key[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(1)
            if n in LENGTHS:
                ok = left[: len(key)] >= n
                slots.append(mix64(key[ok] + np.uint64(n)) & np.uint64(SLOTS - 1))
                owner.append(word[: len(key)][ok])
    return np.concatenate(slots).astype(np.int64), np.concatenate(owner)


def shares_of(words: list[str]) -> np.ndarray:
    """The vector of a text: n-gram shares, scaled."""
    if not words:
        return np.zeros(SLOTS, np.float32)
    slots, _ = grams_of(words)
    return (np.bincount(slots, minlength=SLOTS) * (100.0 / len(slots))).astype(np.float32)


def long_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, index of the word) of each n-gram of LONG characters of words that are marked at both ends."""
    marked = [f" {w} " for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    key = np.zeros(max(0, len(codes) - LONG + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(LONG):
            key = mix64(key * np.uint64(1_000_003) + codes[i : i + len(key)])
    ok = left[: len(key)] >= LONG
    return (key[ok] & np.uint64(LONG_SLOTS - 1)).astype(np.int64), word[: len(key)][ok]


def known_of(documents: list[np.ndarray], size: int = LONG_SLOTS) -> tuple[np.ndarray, float]:
    """(packed bits of the slots that two documents have, so that none vouches for itself, and threshold) of a language. documents: distinct slots of each; too few set no threshold. size: slots are folded to so many."""
    if size < LONG_SLOTS:
        documents = [np.unique(at & (size - 1)) for at in documents]
    seen = np.zeros(size, np.int32)
    for k, at in enumerate(documents):
        if k % 5:
            seen[at] += 1
    least = 0.0
    if len(documents) >= CALIBRATED_FROM:
        shares = [(seen[at] > 1).mean() for at in documents[::5] if len(at) >= LEAST_LONG]
        least = FITTING * float(np.quantile(shares, 0.01)) if shares else 0.0
    for at in documents[::5]:
        seen[at] += 1
    return np.packbits(seen > 1), least


Sparse = tuple[np.ndarray, np.ndarray]


def sparse_of(vector: np.ndarray) -> Sparse:
    """(slots, shares) of a vector."""
    at = np.flatnonzero(vector)
    return at, vector[at]


def svm(x: list[Sparse], y: np.ndarray, slots: int = SLOTS, decay: float = 1e-3, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss, averaged subgradient steps); y is +1 or -1, classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(slots), 0.0
    total, total_b, steps = np.zeros(slots), 0.0, 0
    weight = {s: 0.5 * len(y) / max(1, int((y == s).sum())) for s in (1, -1)}
    t = 0
    for epoch in range(epochs):
        for i in rng.permutation(len(y)):
            t += 1
            rate = 1 / (decay * (t + 1000))
            at, value = x[i]
            if y[i] * (value @ w[at] + b) < 1:
                w *= 1 - rate * decay
                w[at] += (rate * weight[y[i]] * y[i] * 0.01) * value
                b += rate * weight[y[i]] * y[i] * 0.01
            else:
                w *= 1 - rate * decay
        if epoch >= epochs // 2:
            total += w
            total_b += b
            steps += 1
    return total / steps, total_b / steps


class Model:
    """Families, their languages, and a machine for each pair: (positive side, negative side) -> a row of weights and a bias. known: known_of each language, or nothing, and then no text is rejected."""

    def __init__(self, families: dict[str, list[str]], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray, known: Mapping[str, tuple[np.ndarray, float]] | None = None):
        self.families, self.pairs, self.weights, self.bias, self.known = families, pairs, weights, bias, dict(known or {})
        self.judged = {lang: i for i, lang in enumerate(sorted(self.known))}
        self.names = sorted(families)
        self.index = {p: i for i, p in enumerate(pairs)}

    def rows(self, words: list[str]) -> np.ndarray:
        """Of each word: its sum of weights for every machine, and its number of n-grams; with known, then its long n-grams that each language has, and their number."""
        slots, owner = grams_of(words)
        n = len(self.pairs)
        slots &= self.weights.shape[1] - 1
        out = np.zeros((len(words), n + 1 + (len(self.judged) + 1 if self.judged else 0)))
        for k in range(n):
            out[:, k] = np.bincount(owner, self.weights[k][slots], len(words))
        out[:, n] = np.bincount(owner, minlength=len(words))
        if self.judged:
            slots, owner = long_grams(words)
            slots &= 8 * len(next(iter(self.known.values()))[0]) - 1
            for lang, k in self.judged.items():
                bits = self.known[lang][0][slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1
                out[:, n + 1 + k] = np.bincount(owner, bits, len(words))
            out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def _best(self, kind: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name with most wins among its pairs, and its least margin."""
        if len(names) == 1:
            return names[0], np.inf
        wins, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in combinations(names, 2):
            m = float(margins[self.index[f"{kind}{a}", f"{kind}{b}"]])
            wins[a if m >= 0 else b] += 1
            for side, value in ((a, m), (b, -m)):
                sums[side] += value
                least[side] = min(least[side], value)
        best = max(names, key=lambda x: (wins[x], sums[x]))
        return best, least[best]

    def decide(self, sums: np.ndarray) -> tuple[str, float]:
        """sums: of the rows of a text's words. The language and a score of 0 to 1 (each step's margin through a sigmoid, multiplied), 0 if the text does not fit the language."""
        if not self.names:
            return UNDETERMINED, 0.0
        n = len(self.pairs)
        margins = sums[:n] * (100.0 / sums[n]) + self.bias
        family, far = self._best("family ", self.names, margins)
        language, near = self._best("", self.families[family], margins)
        if language in self.judged and sums[-1] >= LEAST_LONG and sums[n + 1 + self.judged[language]] < self.known[language][1] * sums[-1]:
            return language, 0.0
        score = 1.0
        for m in (far, near):
            score *= 1 / (1 + np.exp(-max(-30.0, min(30.0, 4 * m))))
        return language, float(score)


def fit(vectors: Mapping[str, list[Sparse]], families: Mapping[str, tuple[str, ...]] = FAMILIES, known: Mapping[str, tuple[np.ndarray, float]] | None = None) -> Model:
    """vectors: for each language the sparse vectors of its documents. known: see Model."""
    family = {lang: name for name, langs in families.items() for lang in langs}
    groups: dict[str, list[str]] = {}
    for lang in sorted(vectors):
        groups.setdefault(family.get(lang, lang), []).append(lang)
    pairs, rows, bias = [], [], []
    machines = len(groups) * (len(groups) - 1) // 2 + sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    slots = folded(SLOTS, machines)
    if slots < SLOTS:
        vectors = {lang: [sparse_of(np.bincount(at & (slots - 1), v, slots)) for at, v in x] for lang, x in vectors.items()}

    def add(a: str, b: str, xa: list[Sparse], xb: list[Sparse]) -> None:
        w, c = svm(xa + xb, np.concatenate([np.ones(len(xa), int), -np.ones(len(xb), int)]), slots)
        pairs.append((a, b))
        rows.append(w)
        bias.append(c)

    for a, b in combinations(sorted(groups), 2):
        add(f"family {a}", f"family {b}", [v for x in groups[a] for v in vectors[x]], [v for x in groups[b] for v in vectors[x]])
    for langs in groups.values():
        for a, b in combinations(langs, 2):
            add(a, b, vectors[a], vectors[b])
    return Model(groups, pairs, np.array(rows).reshape(len(rows), slots).astype(np.float32), np.array(bias), known)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on up to per_language documents of each language, and about IN_ALL in all, that are not held out.

    Every language is learned; with more than IN_ALL / per_language of them, each from fewer
    documents. A document is in the sample if a hash of its id and text falls under a share of
    its language, set for 1.15 times as many documents as it keeps; the driver keeps the first
    by hash. Rows with a null language, or without a letter, are not learned from; rows that
    repeat id and text count once.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    counts = known.groupBy("_lang").agg(F.count("*").alias("n")).collect()  # as many rows as languages
    if not counts:
        return fit({})
    per_language = max(1, min(per_language, IN_ALL // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["_lang"]), F.lit(min(1.0, 1.15 * per_language / r["n"])))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), F.col("_id").cast("string"), "_text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    @F.pandas_udf("v binary, long binary")
    def sparse(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part:
                words = words_of(text)
                v = shares_of(words)
                at = np.flatnonzero(v).astype(np.uint16)
                out.append((at.tobytes() + v[at].tobytes(), np.unique(long_grams(words)[0]).astype(np.int32).tobytes() if words else b""))
            yield pd.DataFrame(out, columns=["v", "long"], dtype=object)

    drawn = known.withColumn("_draw", draw).where(F.col("_draw") < share[F.col("_lang")]).groupBy("_lang", "_draw").agg(F.min("_text").alias("_text"))
    drawn = drawn.select("_lang", "_draw", sparse("_text").alias("_s")).limit(2 * len(counts) * per_language + 1000)
    rows = drawn.select("_lang", "_draw", F.col("_s.v").alias("_v"), F.col("_s.long").alias("_long")).collect()
    rows.sort(key=lambda r: (r["_lang"], r["_draw"], bytes(r["_v"])))
    vectors: dict[str, list[Sparse]] = {}
    long: dict[str, list] = {}
    for r in rows:
        n = len(r["_v"]) // 6
        if n and len(vectors.setdefault(r["_lang"], [])) < per_language:
            vectors[r["_lang"]].append((np.frombuffer(r["_v"], np.uint16, n).astype(np.int64), np.frombuffer(r["_v"], np.float32, n, 2 * n)))
            long.setdefault(r["_lang"], []).append(np.frombuffer(r["_long"], np.int32))
    del rows
    sets = {lang: known_of(some, folded(LONG_SLOTS, len(long), 1024)) for lang, some in long.items()}
    del long
    model = fit(vectors, known=sets)
    del vectors
    release()
    return model


def predictor(spark: SparkSession, model: Model):
    """A function from a text column to struct(lang, score); `und` and 0 if the text is null or has no letter. The model is broadcast: WEIGHTS and BITS bound it."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.families, model.pairs, model.weights, model.bias, model.known))

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*sent.value)
        table = TokenTable(own.rows, max(1000, min(120_000, TABLE // (len(own.pairs) + len(own.judged) + 2))))
        for part in parts:
            out = []
            for text in part:
                words = words_of(text)
                out.append(own.decide(table.of(words).sum(0)) if words else (UNDETERMINED, 0.0))
            yield pd.DataFrame(out, columns=["lang", "score"])
        table.done()

    return predict
