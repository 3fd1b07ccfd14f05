"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a weighted set: its terms are pairs of neighbouring words (lower case; the last word
is also a term alone), their weights the counts S. For each term there are, by hash, draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1). A term's sample is t = floor(ln S / r + b), and its rank is
ln a = ln c - r (t - b) - r. The least rank of a set of terms and its (term, t) are the same for
two texts with the probability of their generalised Jaccard similarity (sum of least weights
over sum of greatest).

One draw for each term and slot would cost slots x terms; instead each term falls into one
of SLOTS bins by hash, a weight over PIECE as several terms of PIECE at most (which leaves the
similarity as it is, and no bin to one heavy term), and each bin keeps its least-ranked sample. A bin that is empty in
both texts says nothing; the share of the others in which two texts agree estimates the
similarity. Everything is computed within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.graph import whole_id

#: Bins of a fingerprint; at most 128.
SLOTS = 128
#: Rows of a range of ids that one task orders, ranges up to which their first ids are broadcast (16 bytes each; beyond it they are joined by shuffle), and quantiles that lay them out.
RANGE_ROWS, BROADCAST_RANGES, QUANTILES = 2000, 65_536, 255
_DIGEST = 16
#: The greatest weight of a piece of a term.
PIECE = 2


def _product(h: Column, seed: int) -> Column:
    """The product of two uniform numbers in (0, 1) of 32 bits each."""
    x = F.xxhash64(h, F.lit(seed))
    return (F.shiftrightunsigned(x, 32).cast("double") + 0.5) * (x.bitwiseAND(F.lit((1 << 32) - 1)).cast("double") + 0.5) * 2.0**-64


def _draws(h: Column) -> tuple[Column, Column, Column]:
    """r, ln c and b of a term."""
    b = (F.shiftrightunsigned(F.xxhash64(h, F.lit(3)), 32).cast("double") + 0.5) * 2.0**-32
    return -F.log(_product(h, 1)), F.log(-F.log(_product(h, 2))), b


def _packed(h: Column, rank: Column, t: Column) -> Column:
    """bin (7 bits), rank (34 bits) and digest of (term, t) (22 bits) as one number that sorts by bin and rank. With draws of 32 bits and a weight of PIECE at most, ranks lie between -70 and 4."""
    high = F.shiftleft(F.pmod(F.xxhash64(h, F.lit(4)), F.lit(SLOTS)).cast("bigint"), 56)
    middle = F.shiftleft(((rank + 96.0) * float(1 << 27)).cast("bigint"), 22)
    return high.bitwiseOR(middle).bitwiseOR(F.xxhash64(h, t).bitwiseAND(F.lit((1 << 22) - 1)))


def _bound(make, **values: Column) -> Column:
    """make(x), x with each of values computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), make)[0]


def _sample(h: Column, weight: Column) -> Column:
    """The sample of a term, packed."""
    r, c, b = _draws(h)

    def value(x: Column) -> Column:
        t = F.floor(F.log(weight.cast("double")) / x["r"] + x["b"])
        return _bound(lambda y: _packed(h, x["c"] - x["r"] * (y["t"].cast("double") - x["b"]) - x["r"], y["t"]), t=t)

    return _bound(value, r=r, c=c, b=b)


def _single(h: Column) -> Column:
    """The same for a weight of 1, as most have, in fewer steps, for each is interpreted: t is 0, as ln 1 is 0 and b is below 1."""
    r, c, b = _draws(h)
    return F.transform(F.array(r), lambda x: _packed(h, c + x * b - x, F.lit(0).cast("bigint")))[0]


def with_signature(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with out: array<int> of (bin << 16 | digest), one for each bin with terms. Null and empty texts have none."""
    w, s, n, i, v = (f"_{x}_{out}" for x in "wsniv")
    none = F.array().cast("array<int>")
    rows = rows.withColumn(w, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), ""))
    rows = rows.withColumn(s, F.sort_array(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b)))).drop(w)
    rows = rows.withColumn(n, F.size(s))
    first = lambda k: (k == 0) | (F.get(F.col(s), k) != F.get(F.col(s), k - 1))
    rows = rows.withColumn(i, F.when(F.col(n) == 0, none).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), first)))
    rest = F.slice(i, F.lit(2), F.greatest(F.size(i), F.lit(1)))

    def pieces(a: Column, b: Column) -> Column:
        h, weight = F.get(F.col(s), a), F.coalesce(b, F.col(n)) - a
        part = lambda j: _sample(F.when(j == 0, h).otherwise(F.xxhash64(h, j)), F.least(weight - PIECE * j, F.lit(PIECE)))
        return F.when(weight == 1, F.array(_single(h))).when(weight <= PIECE, F.array(_sample(h, weight))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((weight - 1) / PIECE).cast("int")), part))

    rows = rows.withColumn(v, F.sort_array(F.flatten(F.zip_with(i, rest, pieces)))).drop(s, n, i)
    least = F.filter(F.col(v), lambda x, k: (k == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(v), k - 1), 56)))
    slot = lambda x: (F.shiftleft(F.shiftright(x, 56), _DIGEST) + x.bitwiseAND(F.lit((1 << _DIGEST) - 1))).cast("int")
    return rows.withColumn(out, F.transform(least, slot)).drop(v)


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins that are not empty in both in which two signatures agree; 1 for two without terms."""
    bins = lambda f: F.transform(f, lambda x: F.shiftright(x, _DIGEST))
    seen = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(seen == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(seen, F.lit(1)))


def as_string(signature: Column) -> Column:
    """Six hexadecimal digits for each filled bin, in order of bins."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def _tree(key: Column, bounds: list[int], low: int, high: int) -> Column:
    """The number of bounds up to key, by a balanced tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key < bounds[middle], _tree(key, bounds, low, middle)).otherwise(_tree(key, bounds, middle + 1, high))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_range, _at, _halo, doc_id, text, next_text): each row with the text of the next by id; after the last comes the first.

    Order: by id (nulls first), then text. Ids are dealt into ranges of about RANGE_ROWS rows,
    and the first row of each range also goes to the range before (_halo; drop these rows), so
    that one exchange by range brings every row and its next together. The first ids of
    ranges are broadcast if there are BROADCAST_RANGES at most.
    """
    docs = docs.select(whole_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    wanted = [k / (QUANTILES + 1) for k in range(1, QUANTILES + 1)]
    found = ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", wanted, 20_000).alias("q")).first()
    ranges = max(1, -(-found["n"] // RANGE_ROWS))
    every = max(1, (QUANTILES + 1) // ranges)
    bounds = sorted({*(found["q"] or [])[every - 1 :: every]})
    fine = max(1, ranges // (len(bounds) + 1))
    low, high = found["low"] or 0, found["high"] or 0
    key = F.col("doc_id")
    where = _tree(key, bounds, 0, len(bounds))
    if fine > 1:
        ends = [min([low, *bounds]), *bounds, high + 1]
        start, width = F.array(*map(F.lit, ends[:-1])), F.array(*[F.lit(max(1, b - a)) for a, b in zip(ends, ends[1:], strict=False)])
        inner = F.floor((key - F.get(start, where)).cast("double") * fine / F.get(width, where))
        where = where * fine + F.least(F.greatest(inner, F.lit(0)), F.lit(fine - 1))
    docs = docs.withColumn("_range", F.when(key.isNull(), -1).otherwise(where.cast("int")))
    order = Window.orderBy("_range")
    heads = docs.groupBy("_range").agg(F.min("doc_id").alias("_head"))
    last = F.max("_range").over(Window.partitionBy())
    before = F.lag("_range").over(order)
    heads = heads.select("_head", F.coalesce(before, last).alias("_before"), before.isNull().cast("int").alias("_wrap"))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("halo"), F.lit(0).alias("wrap"))
    halo = F.struct(F.col("_before").alias("r"), F.lit(1).alias("halo"), F.col("_wrap").alias("wrap"))
    side = F.broadcast(heads) if ranges <= BROADCAST_RANGES else heads
    joined = docs.join(side, F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    dealt = joined.select("doc_id", "text", F.explode(F.when(F.col("_before").isNotNull(), F.array(own, halo)).otherwise(F.array(own))).alias("_to"))
    dealt = dealt.select("doc_id", "text", F.col("_to.r").alias("_range"), F.col("_to.halo").alias("_halo"), F.col("_to.wrap").alias("_wrap"))
    within = Window.partitionBy("_range").orderBy("_halo", F.asc_nulls_first("doc_id"), "text")
    return dealt.select("_range", F.row_number().over(within).alias("_at"), "_halo", "doc_id", "text", F.lead("text").over(within).alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many
    of the next document. Null texts count as empty; repeated rows are kept; a lone row is its
    own next; an empty table gives no rows. Other columns of docs are ignored.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.select("_range", "_at", "_halo", "doc_id", "text", n.cast("bigint").alias("n_chars"), F.when(F.col("_halo") == 0, edited).otherwise("").alias("_edited"))
    rows = with_signature(rows, "text", "_own").drop("text")
    rows = with_signature(rows, "_edited", "_new")
    rows = rows.select("_range", "_at", "_halo", "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_own", "_new")
    rows = rows.withColumn("_next", F.lead("_own").over(Window.partitionBy("_range").orderBy("_at"))).where("_halo = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("_own")).alias("fingerprint"), as_string(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
