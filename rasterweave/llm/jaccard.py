"""N-gram Jaccard join: documents whose shingle sets have a similarity of at least 90 in 100.

1. Sets. A text becomes the sorted array of hashes (64 bits) of its distinct shingles. Equal
   sets are one node, however many rows have them.
2. Cover. A set that is similar to another one shares most of itself. First its least hashes
   are posted, as many as must hold a tenth of what similar sets have in common; a node goes
   on if that many of them are in other nodes too. Of those that go on, all hashes are posted,
   and a node stays if the threshold's share of them is elsewhere. Texts that share a line or
   a passage with others, and no more, leave here.
3. Groups. Sizes fall into bands. Two sets of a band that are similar enough differ in D
   shingles at most, so of D + 1 + E segments, into which hashes are dealt, E + 1 are the same
   in both; if one of the sets has E empty segments or fewer, a full one is among them. Sets
   with more are dealt again. Each node is posted under its full segments, and nodes that meet
   there make up a candidate group. Large groups are parted again, by the rarest hashes of their sets.
4. Tiles. A group that is small is one tile. A larger one is cut into blocks by size band and
   hash, each of about BLOCK shingles (or four sets, if they are large); a tile is a block and the leaders of its band and the
   band below, which connect the blocks. Then the group is cut into larger blocks, VISITS of
   them or of CHUNK shingles each, and nodes that are not in its largest component visit all of them. So a
   group of many near copies is neither compared pair by pair nor copied from block to block. Within a tile, bitmaps of hashed
   shingles bound the overlap from above by bit counts; pairs that pass, and are not yet
   connected, are intersected exactly as sorted arrays. A tile returns a spanning forest.
5. Components of the forests' links, by aggregations and joins.

No link is lost: a similar pair passes both covers, shares a segment, hence a group, and
meets in a tile unless it is connected already. Postings are combined within CHUNK postings
of a task, so that a hot key has one row for each chunk at most, however many nodes have it.
Nothing is collected to the driver; broadcasts are behind a check of their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterweave.llm.graph import components, discard, split_join, stored, whole_id
from rasterweave.llm.tokens import TokenTable, bounded_batches, fresh, mix64, release

#: Words of a shingle, similarity in hundredths, least ratio of a band's ends, shingles of a block, and candidate texts up to which their hashes are broadcast (8 bytes each).
SHINGLE, SIMILARITY, BAND, BLOCK, BROADCAST_TEXTS = 3, 90, 1.2, 20_000, 500_000
#: Ratio of the size bands of blocks, hundredths of common hashes that the first cover asks for, postings that a task combines at once, and dealings of a set into segments.
FINE, SHARED, CHUNK, DEALS = 1.05, 10, 2_000_000, 6
#: Blocks of the first tiles that make up a block that guests visit, at least; blocks of a group that a guest visits, as long as such a block has CHUNK shingles at most.
MEETING, VISITS = 10, 4


def _hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def word_table() -> TokenTable:
    return TokenTable(_hash_words)


def shingles(text: str | None, table: TokenTable, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles. A-Z are lower-cased, words lie between ASCII white space; fewer words than size are one shingle, none are none."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = table.of(words)
    with np.errstate(over="ignore"):
        if len(h) < size:
            key = np.uint64(len(h))
            for x in h:
                key = mix64(np.array([key * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
            return np.array([key], np.uint64)
        key = np.zeros(len(h) - size + 1, np.uint64)
        for i in range(size):
            key = key * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - size + 1 + i]
            key ^= key >> np.uint64(32)
    return np.unique(mix64(key))


def _share(n: int, hundredths: int) -> int:
    return -(-n * hundredths // 100)


def prefix(n: int, similarity: int) -> int:
    """Least hashes of a set of n that are posted first: two similar sets have in common, among these, SHARED hundredths of the smaller set."""
    return min(n, n - _share(n, similarity) + _share(n, SHARED))


def least_shared(n: int, similarity: int) -> int:
    """Of prefix(n) hashes, those that any similar set has among its own: a similar set can be smaller."""
    return max(1, _share(_share(n, similarity), SHARED))


class Bands:
    """Size bands and their numbers of segments."""

    def __init__(self, similarity: int = SIMILARITY):
        self.similarity = similarity
        self.ratio = max(BAND, 100 / similarity)  # so that an alike set is in the same band or in one beside it
        self.starts = [1]
        self.plans: dict[int, tuple[int, int]] = {}

    def _next(self) -> None:
        self.starts.append(max(self.starts[-1] + 1, math.ceil(self.starts[-1] * self.ratio)))

    def differ(self, total: int) -> int:
        """Elements in which two similar sets of total elements together can differ."""
        s = self.similarity
        return (100 - s) * total // (100 + s)

    def plan(self, band: int) -> tuple[int, int]:
        """(segments, empty ones that a set may have) of a band; (0, 0) if no two different sets of it are similar."""
        if band not in self.plans:
            d = self.differ(2 * (self.starts[band + 1] - 1))
            m, spare = d + 1, 0
            low = max(1, self.starts[band] * self.similarity // 100)
            for _ in range(50):
                empty = m * (1 - 1 / m) ** low if m > 1 else 0.0
                spare = int(empty + 2 * math.sqrt(empty))
                if d + 1 + spare <= m:
                    break
                m = d + 1 + spare
            self.plans[band] = (m, m - d - 1) if d else (0, 0)
        return self.plans[band]

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, its segments, its spare ones) under which a set of n elements is posted: its own and, if a similar set can be there, the next."""
        while self.starts[-1] <= n * 100 // self.similarity + 1:
            self._next()
        k = int(np.searchsorted(self.starts, n, "right")) - 1
        out = [k]
        if n * 100 >= self.starts[k + 1] * self.similarity:
            out.append(k + 1)
        while len(self.starts) <= out[-1] + 1:
            self._next()
        return [(b, *self.plan(b)) for b in out if self.plan(b)[0]]


def _sums(h: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the hashes of each of m segments, and their number."""
    at = (mix64(h + np.uint64(seed)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    n = np.bincount(at, minlength=m)
    out = np.zeros(m, np.uint64)
    full = np.flatnonzero(n)
    with np.errstate(over="ignore"):
        out[full] = np.add.reduceat(mix64(h[order] + np.uint64(77)), (np.cumsum(n) - n)[full])
    return out, n


def postings(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys that a set is posted under; sets too small to have another similar to them have none."""
    out = []
    with np.errstate(over="ignore"):
        for band, m, spare in bands.of(len(h)):
            for deal in range(DEALS):
                sums, n = _sums(h, m, 1 + deal)
                place = np.arange(m, dtype=np.uint64) + np.uint64((band << 34) + (deal << 31))
                out.append(mix64(mix64(place) + sums)[n > 0])
                if m - np.count_nonzero(n) <= spare:
                    break
            else:  # a similar set with as many empty segments in every dealing is here too
                out.append(mix64(np.array([(band << 34) + (7 << 31)], np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_of(h: np.ndarray) -> int:
    """A number of 63 bits that equal sets share; 0 for the empty set."""
    if not len(h):
        return 0
    with np.errstate(over="ignore"):
        x = mix64(np.array([mix64(h + np.uint64(5)).sum(dtype=np.uint64) + np.uint64(len(h))]))[0]
    return int(x >> np.uint64(1)) | 1


def sets_of(docs: DataFrame, size: int, similarity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, node, text_hash and keys (prefix, as bytes) of every document; a task gives the keys of a node once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, posted = word_table(), set()
        for part in parts:
            sizes, nodes, keys = [], [], []
            for text in part["_text"]:
                h = shingles(text, table, size)
                sizes.append(len(h))
                nodes.append(node_of(h))
                keys.append(None if nodes[-1] in posted or not len(h) else h[: prefix(len(h), similarity)].tobytes())
                posted.add(nodes[-1])
            if len(posted) > 500_000:
                posted.clear()
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": sizes, "node": nodes, "text_hash": part["text_hash"], "keys": keys})
        table.done()

    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("_text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    return rows.mapInPandas(run, "doc_id bigint, n_shingles bigint, node bigint, text_hash bigint, keys binary")


def _chunks(parts: Iterator[pd.DataFrame], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, sizes, postings' keys in order, the index of the node of each) of about CHUNK postings at a time. Rows: node, n, keys (bytes)."""

    def sort(held: dict) -> tuple:
        nodes, sizes = np.array(list(held), np.int64), np.array([n for n, _ in held.values()], np.int64)
        keys = np.concatenate([k for _, k in held.values()])
        who = np.repeat(np.arange(len(nodes)), [len(k) for _, k in held.values()])
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
        return nodes, sizes, keys[once], who[once]

    held: dict[int, tuple[int, np.ndarray]] = {}
    total = 0
    for part in parts:
        for node, n, raw in zip(part["node"], part["n"], part["keys"], strict=True):
            if node not in held:
                held[node] = (n, keys_of(np.frombuffer(raw, np.uint64)))
                total += len(held[node][1])
            if total >= CHUNK:
                yield sort(held)
                held, total = {}, 0
    if held:
        yield sort(held)


def _pieces(**columns: np.ndarray) -> Iterator[pd.DataFrame]:
    for at in range(0, len(next(iter(columns.values()))), 50_000):
        yield pd.DataFrame({k: v[at : at + 50_000] for k, v in columns.items()})


def covered(rows: DataFrame, least) -> DataFrame:
    """The nodes of which at least least(n) keys are also posted by another node. rows: node, n, keys (bytes); repeated nodes count once.

    A chunk counts what its nodes share among themselves, and posts a key once: with its node
    if that is the only one in the chunk. gain: what a set has above least(n); null in a posting.
    """

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for nodes, sizes, keys, who in _chunks(parts, lambda h: h):
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            n = np.diff(np.append(start, len(keys)))
            many = np.repeat(n > 1, n)
            gain = np.bincount(who[many], minlength=len(nodes)) - np.array([least(int(k)) for k in sizes])
            single = start[n == 1]
            key = np.concatenate([keys[single].view(np.int64), keys[start[n > 1]].view(np.int64), nodes])
            node = np.concatenate([nodes[who[single]], np.full(int((n > 1).sum()), -1), nodes])
            value = np.concatenate([np.full(len(key) - len(nodes), np.nan), gain])
            for piece in _pieces(key=key, node=node, gain=value):
                yield piece.astype({"gain": "Int32"})
        release()

    posted = rows.mapInPandas(emit, "key bigint, node bigint, gain int")
    own = Window.partitionBy("key")
    met = posted.withColumn("other", (F.min("node").over(own) != F.max("node").over(own)).cast("int"))
    return met.where("node >= 0").groupBy("node").agg(F.sum(F.coalesce("gain", "other")).alias("above")).where("above >= 0").select("node")


def _chained(rows: DataFrame, similarity: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the nodes that share a posting. rows: node, n, keys (bytes of all hashes; without a similarity, of the postings)."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(similarity) if similarity else None
        for nodes, _, keys, who in _chunks(parts, lambda h: postings(h, bands) if bands else h):
            if not len(keys):
                continue
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            first = np.repeat(who[start], np.diff(np.append(start, len(keys))))
            root = list(range(len(nodes)))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for a, b in np.unique(np.stack([first, who], 1)[first != who], axis=0).tolist():
                root[find(a)] = find(b)
            top = np.array([find(x) for x in range(len(nodes))])
            below = np.flatnonzero(top != np.arange(len(nodes)))
            key = np.concatenate([keys[start].view(np.int64), nodes[below]])
            node = np.concatenate([nodes[top[who[start]]], nodes[below]])
            yield from _pieces(key=key, node=node, to=np.concatenate([np.full(len(start), -1), nodes[top[below]]]))
        release()

    posted = rows.mapInPandas(emit, "key bigint, node bigint, to bigint")
    least = F.min(F.when(F.col("to") < 0, F.col("node"))).over(Window.partitionBy("key"))
    edges = posted.withColumn("b", F.when(F.col("to") < 0, least).otherwise(F.col("to")))
    return edges.where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: int, labels: np.ndarray | None = None, guests: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the links of a tile connect. labels: nodes that are connected already have the same one. guests: only a guest and a resident are compared; a guest meets a resident that is a guest elsewhere (guests: 1 guest, 0 resident, -1 such a resident) from one side only."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, sets = nodes[order], [sets[i] for i in order]
    guest = None if guests is None else guests[order]
    size = np.array([len(s) for s in sets], np.int64)
    width = 1 << max(8, min(14, int(4 * np.median(size)).bit_length()))
    bits = np.zeros((len(sets), width // 64), np.uint64)
    for k, s in enumerate(sets):
        at = s & np.uint64(width - 1)
        np.bitwise_or.at(bits[k], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    root = np.arange(len(sets)) if labels is None else np.unique(labels[order], return_inverse=True)[1]
    out = []
    for i in range(len(sets) - 1):
        top = int(np.searchsorted(size, size[i] * 100 // similarity, "right"))
        j = np.arange(i + 1, top)
        j = j[root[j] != root[i]]
        if guest is not None:
            j = j[(guest[j] == 1) != (guest[i] == 1)]
            j = j[(guest[j] + guest[i] != 0) | (np.where(guest[j] == 1, nodes[j] < nodes[i], nodes[i] < nodes[j]))]
        if not len(j):
            continue
        missing_i = np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64)
        missing_j = np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64)
        most = np.minimum(size[i] - missing_i, size[j] - missing_j)
        for k in j[(100 + similarity) * most >= similarity * (size[i] + size[j])].tolist():
            if root[k] == root[i]:
                continue
            a, b = sets[i], sets[k]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            if 100 * both >= similarity * (len(a) + len(b) - both):
                out.append((int(nodes[i]), int(nodes[k])))
                root[root == root[k]] = root[i]
    return out


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if there are BROADCAST_TEXTS at most. rows: stored, or cheap to count."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TEXTS else rows


def _candidates(spark: SparkSession, docs: DataFrame, sets: DataFrame, size: int, similarity: int, text_col: str) -> DataFrame:
    """node, n and keys (bytes of all its hashes) of the nodes that other nodes cover."""
    held = sets.where("keys IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "keys")
    first = stored(covered(held, lambda n: least_shared(n, similarity)), "covered")
    wanted = stored(sets.where("keys IS NOT NULL").join(first, "node").groupBy("node").agg(F.min("text_hash").alias("text_hash")), "wanted")
    discard(first)
    side = _few(wanted)
    texts = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("_text")).join(side, "text_hash")

    def arrays(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, given = word_table(), set()
        for part in parts:
            nodes, keys = [], []
            for node, text in zip(part["node"], part["_text"], strict=True):
                if node not in given:
                    given.add(node)
                    nodes.append(node)
                    keys.append(shingles(text, table, size).tobytes())
            if len(given) > 500_000:
                given.clear()
            yield pd.DataFrame({"node": nodes, "n": [len(k) // 8 for k in keys], "keys": keys})
        table.done()

    found = stored(texts.select("node", "_text").mapInPandas(arrays, "node bigint, n bigint, keys binary").dropDuplicates(["node"]), "arrays")
    second = stored(covered(found, lambda n: max(1, _share(n, similarity))), "covered")
    kept = stored(found.join(_few(second), "node"), "elements")
    for done in (found, wanted, second):
        discard(done)
    return kept


def _narrowed(elements: DataFrame, groups: DataFrame, similarity: int, block: int) -> DataFrame:
    """groups (node, root), but large ones are parted again: by the rarest hashes of each set, as the prefix filter has it.

    In one order of all hashes, two similar sets have one in common among the first
    n - (the threshold's share of n) + 1 of each. With the rarest first, that parts texts that
    are chained by passages which many texts have; such a chain would grow faster than the
    input, and its members that are like none would visit all of it. Nodes that share no such
    hash with another node are linked with none, and go.
    """
    held = stored(elements.select("node", "n").join(groups, "node"), "held")
    total = held.groupBy("root").agg((F.sum("n") > F.greatest(F.lit(block), 4 * F.max("n"))).alias("large"))
    large = stored(split_join(held, total.where("large"), "root").select("node", "root"), "large")
    if not large.head(1):
        discard(large)
        discard(held)
        return groups

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for node, n, root, keys in part[["node", "n", "root", "keys"]].itertuples(index=False):
                own = mix64(np.frombuffer(keys, np.uint64) ^ mix64(np.array([root], np.int64).view(np.uint64)))
                yield from _pieces(node=np.full(n, node), n=np.full(n, n), key=own.view(np.int64))

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"node": part["node"], "n": part["n"], "keys": [np.asarray(k, np.int64).tobytes() for k in part["keys"]]})

    pairs = stored(elements.select("node", "n", "keys").join(_few(large), "node").mapInPandas(spread, "node bigint, n bigint, key bigint"), "pairs")
    often = pairs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = split_join(pairs, often, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("keys"))
    # hashes of one set alone come first in the order, and count in the prefix without being posted
    length = F.size("keys") - F.ceil(F.col("n") * similarity / 100).cast("int") + 1
    posted = shared.where(length > 0).select("node", "n", F.slice("keys", F.lit(1), length)["key"].alias("keys"))
    prefixes = stored(posted.mapInPandas(first, "node bigint, n bigint, keys binary"), "prefixes")
    discard(pairs)
    parted = components(_chained(prefixes))
    small = split_join(held, total.where("NOT large"), "root").select("node", "root")
    found = stored(small.unionByName(parted), "groups")
    for done in (prefixes, parted, large, held, groups):
        discard(done)
    return found


def _linked(spark: SparkSession, docs: DataFrame, size: int, similarity: int, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, nodes, (node, root) of nodes with links)."""
    bounded_batches(spark)
    posted = stored(sets_of(docs, size, similarity, id_col, text_col), "posted")
    elements = _candidates(spark, docs, posted, size, similarity, text_col)
    sets = stored(posted.drop("keys"), "sets")
    discard(posted)
    nodes = sets.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    groups = components(_chained(elements, similarity))
    groups = _narrowed(elements, groups, similarity, block)

    # blocks of each group, by size band and hash
    fine = F.floor(F.log(F.col("n").cast("double")) / math.log(FINE)).cast("int")
    cand = stored(elements.select("node", "n").join(groups, "node").withColumn("band", fine), "candidates")
    discard(groups)
    bands = cand.groupBy("root", "band").agg(F.sum("n").alias("elements"), F.max("n").alias("widest"), F.min_by("node", F.xxhash64("node")).alias("leader"))
    bands = bands.withColumn("blocks", F.ceil(F.col("elements") / F.greatest(F.lit(block), 4 * F.col("widest"))).cast("int"))
    plans = bands.groupBy("root").agg(F.sum("elements").alias("elements"), F.max("widest").alias("widest"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    placed = split_join(cand, plans, "root").withColumn("large", F.col("elements") > F.greatest(F.lit(block), 4 * F.col("widest")))
    at = F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("band"))).cast("int")).otherwise(-1)
    placed = stored(placed.select("node", "n", "root", "large", "elements", "widest", "blocks", "band", F.when(F.col("large"), F.col("band")).otherwise(-1).alias("x"), at.alias("y")), "placed")
    every = lambda b: F.transform(F.sequence(F.lit(0), F.element_at("blocks", b) - 1), lambda k: F.struct(b.alias("x"), k.cast("int").alias("y")))
    has = lambda b: F.array_contains(F.map_keys("blocks"), b)
    is_leader = placed.where("large").join(bands.select(F.col("leader").alias("node")), "node")
    ahead = F.concat(every(F.col("band")), F.when(has(F.col("band") + 1), every(F.col("band") + 1)).otherwise(F.array().cast("array<struct<x:int,y:int>>")))
    leaders = is_leader.select("node", "root", F.explode(ahead).alias("t"), F.struct("x", "y").alias("own")).where("t <> own").select("node", "root", "t.x", "t.y")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("node")
        found = _forest(part["node"].to_numpy(), [np.frombuffer(e, np.uint64) for e in part["keys"]], similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    tiles = elements.select("node", "keys").join(_few(placed.select("node", "root", "x", "y").unionByName(leaders)), "node")
    links = stored(tiles.groupBy("root", "x", "y").applyInPandas(compare, "a bigint, b bigint"), "links")
    linked = components(links)
    big = placed.where("large")
    if not big.head(1):
        return sets, nodes, linked

    # nodes of large groups that are not in their group's largest component visit the blocks of the group
    labelled = big.join(linked.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled, "labelled")
    sums = labelled.groupBy("root", "label").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
    # a guest is copied to each block and a host to each pack: with blocks of a fixed size their copies would grow with the square of the group
    room = F.greatest(F.greatest(F.lit(block), 4 * F.col("widest")) * MEETING, F.least(F.lit(CHUNK), F.ceil(F.col("elements") / VISITS)))
    most = split_join(labelled, sums, "root").select("node", "n", "root", "label", (F.col("label") != F.col("most")).alias("guest"), room.alias("room"), F.ceil(F.col("elements") / room).cast("int").alias("z"))
    marked = stored(most, "marked")
    discard(labelled)
    packs = marked.where("guest").groupBy("root").agg(F.ceil(F.sum("n") / F.max("room")).cast("int").alias("packs"))
    some = split_join(marked, packs, "root")
    deal = lambda what, n: F.pmod(F.xxhash64(F.lit(what), "node"), F.col(n)).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visits = some.where("guest").select("node", "root", "label", F.lit(1).alias("guest"), deal("pack", "packs").alias("pack"), count("z").alias("z"))
    hosts = some.select("node", "root", "label", F.when(F.col("guest"), -1).otherwise(0).alias("guest"), count("packs").alias("pack"), deal("host", "z").alias("z"))
    visits = stored(hosts.unionByName(visits), "visits")
    if visits.head(1):
        pairs = elements.select("node", "keys").join(_few(visits), "node")

        def meet(part: pd.DataFrame) -> pd.DataFrame:
            found = _forest(part["node"].to_numpy(), [np.frombuffer(e, np.uint64) for e in part["keys"]], similarity, part["label"].to_numpy(), part["guest"].to_numpy())
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        more = stored(pairs.groupBy("root", "z", "pack").applyInPandas(meet, "a bigint, b bigint"), "more")
        if more.head(1):
            discard(linked)
            linked = components(links.union(more))
        discard(more)
    for done in (visits, marked, placed, links, cand):
        discard(done)
    return sets, nodes, linked


def join(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the least doc_id that links reach, the row's own included. Null, empty and
    blank texts have the empty set: they are linked with nothing, not even one another. A null
    doc_id stays null in its row and is passed over in the least; repeated rows are linked.
    Extra columns of docs are ignored; an empty table gives no rows.
    """
    sets, nodes, linked = _linked(spark, docs, size, similarity, id_col, text_col, block)
    least = nodes.select("node", "least")
    per_root = linked.join(least, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = split_join(least.join(linked, "node", "left"), per_root, "root", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return split_join(sets.select("doc_id", "n_shingles", "node"), of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs, but of each group of linked documents only the one with the least id (nulls last), with the columns of docs.

    Texts without shingles stay. Of rows that repeat an id and a text, one stays.
    """
    sets, _, linked = _linked(spark, docs, size, similarity, id_col, text_col, block)
    named = split_join(sets.where("node <> 0").select("doc_id", "text_hash", "node"), linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    first = named.groupBy("root").agg(F.min(place).alias("kept"), F.count("*").alias("c")).where("c > 1").select("root", "kept")
    many = split_join(named, first, "root")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    own, text, what = (fresh(docs, n) for n in ("_id", "_hash", "_what"))
    drop = many.where(~is_kept).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text)).distinct().withColumn(what, F.lit(0))
    again = many.where(is_kept).groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(text)).agg(F.count("*").alias("_c")).where("_c > 1").select(own, text, F.lit(1).alias(what))
    marks = stored(drop.unionByName(again), "marks")
    side = F.broadcast(marks) if marks.count() <= BROADCAST_TEXTS else marks
    hashed = fresh(docs, "_text_hash")
    rows = docs.withColumn(hashed, F.xxhash64(F.col(f"`{text_col}`")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = rows.join(side, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(text)), "left")
    single = joined.where(F.col(what).isNull()).select(columns)
    if not marks.where(F.col(what) == 1).head(1):
        return single
    return single.unionByName(joined.where(F.col(what) == 1).dropDuplicates([id_col, hashed]).select(columns))
