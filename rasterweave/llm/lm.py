"""Documents scored by cross-entropy difference between a target and a background model.

Both are class bigram models of words over one vocabulary, all words of all documents, which
grows with the corpus. They have the same order and smoothing. The background's counts, of the
whole corpus, are scaled to the target's total (what a random part of the corpus of the
target's size has on average), so that the models are matched without a sample being drawn.
A token's loss is -ln P(word | word before); a document's score is the mean of its tokens' loss
differences, target less background: below zero it is more like the target.

P(w | v) = P(c | d) P(w | c), where c and d are the classes of w and v, by hash;
P(c | d) = (n(dc) + M P(c)) / (n(d.) + M),  P(c) = (n(c) + 1) / (n + CLASSES),
P(w | c) = (n(w) + M q(w)) / (n(c) + M),  q(w) = the share of w in its class over all documents.

Class bigrams are a table of fixed size. Words are counted by shuffle: a chunk of documents
posts each of its words once, the sums go back to the chunks that posted it, and there a
document's loss is added up. A word that occurs once in the corpus need not be sent back.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterweave.llm.graph import stored
from rasterweave.llm.tokens import TokenTable, _Ids, bounded_batches, release

#: Classes of words (tables have (CLASSES + 1) x CLASSES entries), and weight of the lower order.
CLASSES, M = 512, 10.0
#: Words of a chunk.
CHUNK = 2_000_000
#: Target ids up to which they are broadcast (8 bytes each); beyond it the tables are joined by shuffle.
BROADCAST_IDS = 1_000_000

#: A character of a script without spaces (Thai, Lao, Burmese, Khmer, kana, Han) is a word.
ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_ALONE = re.compile(f"[{ALONE}]")
_WORD = re.compile(rf"[{ALONE}]|[^\x20\x09-\x0D{ALONE}]+")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, between ASCII white space; null has none."""
    if not text:
        return []
    low = text.lower()
    if low.isascii() or not _ALONE.search(low):
        return low.encode("utf-8", "replace").split()
    return [w.encode("utf-8", "replace") for w in _WORD.findall(low)]


def classes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((int.from_bytes(md5(w).digest()[:2], "big") for w in words), np.int32, len(words)) % CLASSES


def _cells(c: np.ndarray) -> np.ndarray:
    """Numbers of the class bigrams that end at each word; before the first stands a class of its own."""
    before = np.full(len(c), CLASSES, np.int64)
    before[1:] = c[:-1]
    return before * CLASSES + c


def bigrams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class bigram counts of all documents and of those whose column target is true. docs: text and target.

    Each task adds up its rows; the sums of tasks are added up by bigram, and the driver gets the table.
    """
    size = (CLASSES + 1) * CLASSES

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = TokenTable(classes), np.zeros((2, size), np.int64)
        for part in parts:
            held: tuple[list, list] = ([], [])
            for text, own in zip(part["text"], part["target"], strict=True):
                words = words_of(text)
                if words:
                    held[bool(own)].append(_cells(table.of(words)))
            for k in (0, 1):
                if held[k]:
                    total[k] += np.bincount(np.concatenate(held[k]), minlength=size)
        table.done()
        at = np.flatnonzero(total.any(0))
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[:, at].sum(0), "own": total[1, at]})

    sums = docs.select("text", "target").mapInPandas(count, "cell int, n bigint, own bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    rows = sums.toPandas()
    out = np.zeros((2, size))
    out[0, rows["cell"]] = rows["n"]
    out[1, rows["cell"]] = rows["own"]
    return out[0], out[1]


def losses(n: np.ndarray) -> np.ndarray:
    """-ln P(c | d) of every class bigram."""
    n2 = n.reshape(CLASSES + 1, CLASSES)
    n1 = n2.sum(0)
    p1 = (n1 + 1) / (n1.sum() + CLASSES)
    return -np.log((n2 + M * p1) / (n2.sum(1, keepdims=True) + M)).ravel()


def word_losses(n: np.ndarray, own: np.ndarray, of_class: np.ndarray, own_of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-ln P(w | c) of words under the target and under the background, of their counts in all documents and in the target's."""
    q = n / of_class
    return -np.log((own + M * q) / (own_of_class + M)), -np.log(q)


def _chunked(marked: DataFrame, sent, chunk: int) -> DataFrame:
    """One row for each chunk of documents: their ids and class losses, the words of each, and the chunk's words with their counts."""

    def close(held: list, ids: _Ids, number: int) -> pd.DataFrame:
        target, background = sent.value[:2]
        words = list(ids)
        c = classes(words)
        size = np.array([len(x) for _, x, _ in held])
        doc = np.repeat(np.arange(len(held)), size)
        seq = np.concatenate([x for _, x, _ in held]) if held else np.zeros(0, np.int64)
        mine = np.repeat(np.array([o for *_, o in held], bool), size)
        ends = np.concatenate([[0], np.cumsum(size)])
        cells = [_cells(c[x]) for _, x, _ in held]
        pairs, times = np.unique(doc * max(1, len(words)) + seq, return_counts=True)
        of, at = pairs // max(1, len(words)), pairs % max(1, len(words))
        step = np.diff(at, prepend=0)  # small numbers compress well; a new document's first step may be negative
        import xxhash

        keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        body = zlib.compress(np.bincount(of, minlength=len(held)).astype(np.int32).tobytes() + step.astype(np.int32).tobytes() + times.astype(np.int32).tobytes(), 1)
        n, own = np.bincount(seq, minlength=len(words)), np.bincount(seq[mine], minlength=len(words))
        return pd.DataFrame({
            "chunk": [(TaskContext.get().partitionId() << 32) | number], "doc_ids": [[d for d, *_ in held]], "own": [[bool(o) for *_, o in held]], "n_tokens": [np.diff(ends).tolist()],
            "target": [[float(target[x].sum()) for x in cells]], "background": [[float(background[x].sum()) for x in cells]], "body": [body],
            "keys": [keys.tobytes()], "classes": [c.astype(np.int16).tobytes()], "counts": [np.stack([n, own]).astype(np.int32).tobytes()],
        })

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, words, number = [], _Ids(), 0, 0
        for part in parts:
            for doc_id, text, own in zip(part["doc_id"], part["text"], part["target"], strict=True):
                found = words_of(text)
                held.append((None if pd.isna(doc_id) else doc_id, np.fromiter(map(ids.__getitem__, found), np.int64, len(found)), own))
                words += len(found)
                if words >= chunk or len(held) >= chunk // 8:
                    yield close(held, ids, number)
                    held, ids, words, number = [], _Ids(), 0, number + 1
        if held:
            yield close(held, ids, number)
        release()

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInPandas(run, f"chunk bigint, doc_ids array<{kind}>, own array<boolean>, n_tokens array<bigint>, target array<double>, background array<double>, body binary, keys binary, classes binary, counts binary")


def _posted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each word of a chunk: its key, the chunk, its place there, and its counts."""
    for part in parts:
        for chunk, keys, counts in zip(part["chunk"], part["keys"], part["counts"], strict=True):
            key = np.frombuffer(keys, np.int64)
            n, own = np.frombuffer(counts, np.int32).reshape(2, -1)
            for a in range(0, len(key), 50_000):
                b = min(len(key), a + 50_000)
                yield pd.DataFrame({"key": key[a:b], "chunk": np.full(b - a, chunk), "at": np.arange(a, b, dtype=np.int32), "n": n[a:b], "own": own[a:b]})


def score(spark: SparkSession, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background and score of every document, whole. targets: doc_id of the target's documents.

    A null or empty text has no tokens and null losses. Documents with a null id are scored
    and belong to the background alone; repeated rows count as often as they come. With no
    target the two models are alike and scores are 0. A word has one row for each chunk that
    has it, however often it occurs there. Words are told apart by hashes of 64 bits.
    """
    bounded_batches(spark)
    ids = targets.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    side = F.broadcast(ids) if targets.count() <= BROADCAST_IDS else ids
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marked = docs.join(side, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))
    n, own = bigrams(marked)
    scaled = n * (own.sum() / n.sum()) if own.sum() else n
    of_class = n.reshape(CLASSES + 1, CLASSES).sum(0), own.reshape(CLASSES + 1, CLASSES).sum(0)
    sent = spark.sparkContext.broadcast((losses(own if own.sum() else n), losses(scaled), *of_class))
    chunks = stored(_chunked(marked, sent, chunk), "chunks")
    posted = chunks.select("chunk", "keys", "counts").mapInPandas(_posted, "key bigint, chunk bigint, at int, n int, own int")
    same = Window.partitionBy("key")
    found = posted.select("chunk", "at", F.sum("n").over(same).alias("n"), F.sum("own").over(same).alias("own")).where("n > 1")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def add_up(rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        all_of, own_of = sent.value[2:]
        out = []
        for r in rows.itertuples():
            c = np.frombuffer(r.classes, np.int16).astype(np.int64)
            counts = np.frombuffer(r.counts, np.int32).reshape(2, -1).astype(np.float64)
            n, own = counts[0].copy(), counts[1].copy()  # right for the words that occur once
            n[sums["at"]], own[sums["at"]] = sums["n"], sums["own"]
            target, background = word_losses(n, own, all_of[c], own_of[c])
            flat = np.frombuffer(zlib.decompress(r.body), np.int32)
            each = flat[: len(r.doc_ids)]
            step, times = flat[len(each) :].reshape(2, -1)
            doc, at = np.repeat(np.arange(len(each)), each), np.cumsum(step)
            size = np.maximum(1, np.array(r.n_tokens))
            t = (np.bincount(doc, times * target[at], len(each)) + np.array(r.target)) / size
            b = (np.bincount(doc, times * background[at], len(each)) + np.array(r.background)) / size
            none = np.array(r.n_tokens) == 0
            t[none] = b[none] = np.nan
            out.append(pd.DataFrame({"doc_id": pd.Series(list(r.doc_ids), dtype=object), "n_tokens": r.n_tokens, "ce_target": t, "ce_background": b, "score": t - b}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_tokens", "ce_target", "ce_background", "score"])

    scored = chunks.drop("keys").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(add_up, f"doc_id {kind}, n_tokens bigint, ce_target double, ce_background double, score double")
    return scored.select("doc_id", "n_tokens", *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in ("ce_target", "ce_background", "score")])
