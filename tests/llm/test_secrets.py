"""The random field: formats it has not learned, silence, and the query's rows by brute force."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from rasterweave.llm import secrets_crf
from test_llm_operators import brute_base

SF = "/root/testdata/sf0.01"
LEADS = ["Bearer ", "key ", "my pass is ", "", "use ", "auth=", '"', "X-Auth: "]


@pytest.fixture(scope="module")
def texts():
    return [x or "" for x in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column("text").to_pylist()]


def tagged(text, crf):
    """All spans with every text decoded, and without the table of a worker."""
    out = brute_base(text)
    places = list(secrets_crf._TOKEN.finditer(text))
    if not places:
        return out
    tags = crf.viterbi(crf.scores(crf.rows([m[0] for m in places]), secrets_crf.file_slot(text)))
    found = []
    for m, tag in zip(places, tags, strict=True):
        if tag == secrets_crf.B:
            found.append([m.start(), m.end()])
        elif tag == secrets_crf.I:
            found[-1][1] = m.end()
    out += [(a, b, "crf") for a, b in found if not any(x < b and a < y for x, y, _ in out)]
    return sorted(out, key=lambda s: (s[0], secrets_crf.KINDS.index(s[2])))


@pytest.mark.parametrize("fold", range(3))
def test_formats_that_were_not_learned(texts, fold):
    """Fitted without a third of the formats, the field finds secrets of just these in other documents, and leaves the documents alone."""
    names = list(secrets_crf.FORMATS)
    held = names[fold::3]
    crf = secrets_crf.fit(secrets_crf.training_windows(texts[:300], formats=tuple(n for n in names if n not in held)))
    table = secrets_crf.TokenTable(crf.rows)
    r = random.Random(fold)
    hits, total, clean = dict.fromkeys(held, 0), dict.fromkeys(held, 0), 0
    for k, text in enumerate(texts[300:900]):
        name = held[k % len(held)]
        own = secrets_crf.FORMATS[name](r)
        before = f"{text[:300]} {r.choice(LEADS)}"
        planted = f"{before}{own} {text[300:600]}"
        a, b = len(before), len(before) + len(own)
        found = secrets_crf.spans(planted, crf, table)
        total[name] += 1
        hits[name] += sum(max(0, min(b, y) - max(a, x)) for x, y, _ in found) >= 0.8 * len(own)
        clean += any(kind == "crf" for _, _, kind in secrets_crf.spans(text, crf, table))
    share = {n: hits[n] / total[n] for n in held}
    assert sum(hits.values()) >= 0.9 * sum(total.values()), share
    assert clean <= 6, clean


def test_silence_counts_no_step_to_the_first_token():
    steps = np.array([[0.0, -0.94, -30], [0, -2, -1], [0, -2, -1]])
    crf = secrets_crf.CRF(np.zeros((secrets_crf.SLOTS, 3), np.float32), steps)
    s = np.array([[0, 0.5, -9.0]])
    assert crf.viterbi(s) == [secrets_crf.B] and not crf.silent(s)
    r = np.random.default_rng(1)
    quiet = 0
    for _ in range(3000):
        steps = r.normal(0, 1, (3, 3))
        steps[0, 2] = -30
        crf = secrets_crf.CRF(crf.weights, steps)
        s = r.normal(0, 1, (int(r.integers(1, 5)), 3)) + [2.5, 0, 0]
        quiet += crf.silent(s)
        assert not crf.silent(s) or not any(crf.viterbi(s))
    assert quiet > 100


def test_rows_of_the_query(spark, tmp_path):
    """Each column of op10 against decoding every text in full; nulls, empty, long and planted texts among them."""
    from rasterweave.llm.queries import op10_secret_crf

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(250)
    r = random.Random(3)
    own = [(10_000 + i, f"see {f(r)} and password=abcdef1 here") for i, f in enumerate(secrets_crf.FORMATS.values())] + [(20_000, None), (20_001, ""), (20_002, "word " * 40_000 + "ghp_" + "aB3" * 12)]
    more = spark.createDataFrame(own, "doc_id bigint, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    all_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    crf = secrets_crf.train(all_docs)
    got = {x["doc_id"]: x for x in op10_secret_crf(spark, str(tmp_path)).collect()}
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    extra = 0
    for x in all_docs.select("doc_id", "text").collect():
        want = tagged(x["text"] or "", crf)
        base = [s for s in want if s[2] != "crf"]
        extra += len(want) - len(base)
        row = got[x["doc_id"]]
        assert row["spans"] == line(want) and row["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
    assert extra >= 10
    assert op10_secret_crf(spark, str(_empty(spark, tmp_path))).count() == 0


def _empty(spark, at):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(at / "none" / "documents.parquet"))
    return at / "none"
