"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); x_i is 1 where
a text has term i, else 0. Terms are words and their first letters, so that
inflected and compounded words share what is learned of their stem, and stems that come
back in several words. The
pairwise part lets two terms weigh together (an insult and whom it is aimed at) what neither
weighs alone. Its sum over all pairs costs one pass: half of (sum of v)^2 - sum of v^2.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm.tokens import TokenTable, bounded_batches, hash64, mix64

#: Hash slots of terms, factors of a term, and rows of each label that the model is fitted on at most (a bounded sample by hash of the id).
SLOTS, FACTORS, PER_LABEL = 1 << 19, 4, 3000
#: Training documents that a term has to be in, and standard errors by which its shares of the two labels have to differ, or how often it comes with another term; other terms weigh nothing.
LEAST_DOCS, LEAST_Z, PAIR_Z = 4, 3.0, 6.0
#: The most frequent terms, of which all pairs are looked at (the square of it bounds the table of pairs).
PAIR_TERMS = 1024

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The distinct words of a text, in lower case; null has none."""
    return list({*_WORD.findall(text.lower())}) if text else []


def stems_of(words: list[str]) -> np.ndarray:
    """Hashes of each word and of its first four, five and six letters."""
    return np.stack([hash64(words, 1), *(hash64((w[:n] for w in words), n) for n in (4, 5, 6))], 1)


def terms_of(stems: np.ndarray) -> np.ndarray:
    """The distinct slots of a text: its stems, and again those that two or more, and four or more, of its distinct words have."""
    stem, n = np.unique(stems, return_counts=True)
    return np.unique(mix64(np.concatenate([stem, stem[n > 1] + np.uint64(1), stem[n > 3] + np.uint64(2)])) & np.uint64(SLOTS - 1)).astype(np.int32)


class Machine:
    """w0, w[SLOTS] and v[SLOTS, FACTORS]; all of them bounded by the number of slots."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def logit(self, terms: np.ndarray) -> float:
        """terms: the distinct slots of a text."""
        v = self.v[terms]
        s = v.sum(0, dtype=np.float64)
        return float(self.bias + self.w[terms].sum(dtype=np.float64) + 0.5 * (s @ s - (v * v).sum(dtype=np.float64)))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-max(-60.0, min(60.0, x)))))


def screened(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Whether each slot is worth a weight and factors: its shares of the two labels differ, or it and another come together more often, against what their shares say, under one label than under the other."""
    held = np.zeros((2, SLOTS), np.float64)
    for t, y in zip(texts, labels, strict=True):
        held[y, t] += 1
    n, both = np.bincount(labels, minlength=2), held.sum(0)
    odd = both / n.sum()
    spread = 1 / n[0] + 1 / n[1]
    enough = both >= LEAST_DOCS
    live = enough & (np.abs(held[1] / n[1] - held[0] / n[0]) >= LEAST_Z * np.sqrt(odd * (1 - odd) * spread))
    often = np.sort(np.argsort(-both, kind="stable")[:PAIR_TERMS])
    often = often[enough[often] & (odd[often] < 1)]
    place = np.full(SLOTS, -1)
    place[often] = np.arange(len(often))
    cov = np.zeros((2, len(often), len(often)))
    for y in (0, 1):
        x = np.zeros((n[y], len(often)), np.float32)
        for row, t in zip(x, (t for t, label in zip(texts, labels, strict=True) if label == y), strict=True):
            at = place[t]
            row[at[at >= 0]] = 1
        share = x.mean(0, dtype=np.float64)
        cov[y] = x.T @ x / n[y] - np.outer(share, share)
    p = odd[often] * (1 - odd[often])
    z = np.abs(cov[1] - cov[0]) / np.sqrt(np.outer(p, p) * spread)
    np.fill_diagonal(z, 0)
    live[often[(z >= PAIR_Z).any(0)]] = True
    return live


def fit(texts: list[np.ndarray], labels: np.ndarray, share: float, epochs: int = 8, rate: float = 0.05, decay: float = 2e-3, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the slots of texts (one array each). share: of label 1 where the machine is to be used."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32)
    if not len(labels) or labels.min() == labels.max():
        p = min(max(float(labels.mean()) if len(labels) else share, 1e-3), 1 - 1e-3)
        return Machine(float(np.log(p / (1 - p))), w, v)
    live = screened(texts, labels)
    data = []
    for t in texts:
        data.append(np.unique(t[live[t]]))
    v[live] = rng.normal(0, 0.01, (int(live.sum()), FACTORS)).astype(np.float32)
    gw, gv, bias, gb = np.full(SLOTS, 1e-2, np.float32), np.full((SLOTS, FACTORS), 1e-2, np.float32), 0.0, 1e-2
    weight = 0.5 / np.where(labels == 1, labels.mean(), 1 - labels.mean())
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            t = data[i]
            vt = v[t]
            s = vt.sum(0)
            z = bias + float(w[t].sum()) + 0.5 * float(s @ s - (vt * vt).sum())
            g = (_sigmoid(z) - labels[i]) * weight[i]
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if abs(g) < 1e-3:
                continue
            dw = g + decay * w[t]
            dv = g * (s - vt) + decay * vt
            gw[t] += dw * dw
            gv[t] += dv * dv
            w[t] -= rate * dw / np.sqrt(gw[t])
            v[t] -= rate * dv / np.sqrt(gv[t])
    share = min(max(share, 1e-3), 1 - 1e-3)  # the rows were weighted as if labels were even
    return Machine(float(bias + np.log(share / (1 - share))), w, v)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on at most per_label rows of each label that are not held out, the least by hash of the id.

    Rows with a null id or label are not learned from; of several labels of an id the greatest
    counts, and of several texts the least by hash.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("_id")
    picked = [known.where(F.col("_y") == y).orderBy(order, "_id").limit(per_label) for y in (0, 1)]
    sample = picked[0].unionByName(picked[1])

    @F.pandas_udf("binary")
    def slots(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([terms_of(stems_of(words_of(x))).tobytes() for x in part], dtype=object)

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    own = texts.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = own.select("_id", "_y", slots("_text").alias("_slots")).collect()
    rows.sort(key=lambda r: (r["_id"], bytes(r["_slots"])))
    total = max(1, sum(counts.values()))
    return fit([np.frombuffer(r["_slots"], np.int32) for r in rows], np.array([r["_y"] for r in rows], np.int64), counts.get(1, 0) / total)


def scorer(spark: SparkSession, machine: Machine):
    """A function from a text column to its score, 0 to 1. The broadcast is the machine, as large as its slots."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Machine(*sent.value)
        table = TokenTable(stems_of)
        for part in parts:
            out = []
            for text in part:
                words = words_of(text)
                out.append(_sigmoid(own.logit(terms_of(table.of(words)) if words else np.zeros(0, np.int32))))
            yield pd.Series(out, dtype="float64")
        table.done()

    return score
