"""A large group of texts that share passages and are not alike: what its guests' visits copy."""

import random

from pyspark.sql import functions as F

from rasterweave.llm import jaccard
from tests_llm_brute import brute_components, sets_of


def mosaics(n, seed=5):
    """Texts of six passages, each in one of three variants: all shingles are elsewhere too, two texts have 5 of 7 passages in common at most. Some have an edited copy."""
    r = random.Random(seed)
    variants = [[" ".join(f"w{r.randrange(10**6)}" for _ in range(20)) for _ in range(3)] for _ in range(6)]
    picked = r.sample(range(3**6), n)
    texts = [" ".join(variants[p][k // 3**p % 3] for p in range(6)) for k in picked]
    return texts + [t.rsplit(" ", 1)[0] + " end" for t in r.sample(texts, n // 20)]


def test_copies_of_guests_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    texts = mosaics(600)
    rows = list(enumerate(texts))
    found = {}

    def stored(frame, name, put=jaccard.stored):
        found[name] = out = put(frame, name)
        if name in ("marked", "visits"):
            found[f"{name}_rows"] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark, docs, size=5, similarity=80, block=50).collect()}
    assert [got[k] for k, _ in rows] == brute_components(sets_of(rows, 5), 80)
    assert found["marked_rows"] > 500
    assert found["visits_rows"] <= 2 * (jaccard.VISITS + 1) * found["marked_rows"]


def test_a_chain_of_shared_passages_is_no_group(spark):
    """Texts with lines of their own that come once more elsewhere, and passages that all have: one group by segments, pairs by rarest hashes."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    common = [words(12) for _ in range(4)]
    own = [[w for line in (*common, words(60)) for w in line] for _ in range(120)]
    texts = [" ".join(t) for t in own] + [" ".join([*t[:-1], "end"]) for t in own]
    sets = [jaccard.shingles(t, jaccard.word_table(), 5) for t in texts]
    rows = spark.createDataFrame([(k + 1, len(s), s.tobytes()) for k, s in enumerate(sets)], "node bigint, n bigint, keys binary")
    chained = jaccard.stored(spark.createDataFrame([(k + 1, 1) for k in range(len(texts))], "node bigint, root bigint"), "components")
    parted = {x["node"]: x["root"] for x in jaccard._narrowed(rows, chained, 80, 50).collect()}
    assert len(set(parted.values())) == 120 and all(parted[k + 1] == parted[k + 121] for k in range(120))


def test_stored_tables_leave_no_shuffle_files(spark):
    import glob
    import os

    from rasterweave.llm.graph import stored

    files = lambda: set(glob.glob(f"{os.environ.get('SPARK_LOCAL_DIRS', '/tmp')}/blockmgr-*/*/shuffle_*.data"))
    before = files()
    out = stored(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "kept")
    assert files() <= before
    assert out.count() == 1000
