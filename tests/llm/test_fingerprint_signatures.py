"""Rows of op7 against signatures that are computed term by term, without Spark."""

import collections
import hashlib
import math
import random
import re
import struct

import pyarrow.parquet as pq
import xxhash

from rasterweave.llm import fingerprints
from rasterweave.llm.queries import op7_weighted_fingerprints

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(*values):
    """Spark's xxhash64: strings as bytes, ('int', v) in four bytes, other numbers in eight; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def sample(term, weight):
    """(bin, rank, digest) by the definition: gamma draws as sums of two exponentials."""
    u = [((x >> 32) + 0.5) / 2**32 for x in (h(term, ("int", k)) & MASK for k in (1, 2, 3))]
    v = [((x & 0xFFFFFFFF) + 0.5) / 2**32 for x in (h(term, ("int", k)) & MASK for k in (1, 2, 3))]
    r, c, b = -math.log(u[0] * v[0]), math.log(-math.log(u[1] * v[1])), u[2]
    t = math.floor(math.log(weight) / r + b)
    rank = c - r * (t - b) - r
    return h(term, ("int", 4)) % fingerprints.SLOTS, rank, h(term, t)


def signature(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    counts = collections.Counter(h(a, b) for a, b in zip(words, [*words[1:], None], strict=False))
    best = {}
    for term, n in counts.items():
        for j in range((n + fingerprints.PIECE - 1) // fingerprints.PIECE):
            found = sample(term if j == 0 else h(term, ("int", j)), min(n - fingerprints.PIECE * j, fingerprints.PIECE))
            if found[0] not in best or found[1] < best[found[0]][0]:
                best[found[0]] = found[1:]
    return {k: (k << 16) + (d & 0xFFFF) for k, (_, d) in best.items()}


def as_text(s):
    return "".join(f"{s[k]:06x}" for k in sorted(s))


def likeness(a, b):
    return sum(a.get(k) == v for k, v in b.items()) / len(a.keys() | b.keys()) if a or b else 1.0


def test_rows_of_the_query(spark, tmp_path):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    r = random.Random(2)
    rows = [(x["doc_id"], x["text"]) for x in rows if x["text"] is None or len(x["text"]) < 2500][:90]
    rows += [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "one"), (10**9 + 3, " ".join(r.choice(["a", "b"]) for _ in range(300))), (10**9 + 4, "same same " * 40), (10**9 + 5, "😀 ünï 中文 x")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in op7_weighted_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    rows.sort()
    for (doc, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, new, other = signature(text), signature(edited), signature(after)
        x = got[doc]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert x["fingerprint"] == as_text(own) and x["edited_fingerprint"] == as_text(new)
        assert abs(x["near_edited"] - likeness(own, new)) < 1e-12 and abs(x["near_next"] - likeness(own, other)) < 1e-12
