"""Chunk catalogues and viewports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions import geometry as G

#: Tasks for each core, at least, over which headers are dealt before they become chunks, and headers of a task.
DEALT, DEALT_HEADERS = 4, 1500


def levels(headers: DataFrame) -> DataFrame:
    """headers (id, w, h, mode one/mipmap/ripmap, up) with a row for each level: lx, ly, lw, lh."""
    both = F.greatest("w", "h")
    count = lambda n: G.level_count(n, F.col("up")).cast("int")
    nx = F.when(F.col("mode") == "one", 1).when(F.col("mode") == "mipmap", count(both)).otherwise(count(F.col("w")))
    ny = F.when(F.col("mode") == "ripmap", count(F.col("h"))).otherwise(1)
    span = lambda n: F.sequence(F.lit(0), n - 1)
    out = headers.withColumn("lx", F.explode(span(nx))).withColumn("ly", F.explode(span(ny)))
    out = out.withColumn("ly", F.when(F.col("mode") == "ripmap", F.col("ly")).otherwise(F.col("lx")))
    return out.withColumn("lw", G.level_size(F.col("w"), F.col("lx"), F.col("up"))).withColumn("lh", G.level_size(F.col("h"), F.col("ly"), F.col("up")))


def level_tiles(headers: DataFrame) -> DataFrame:
    """levels with nx and ny tiles and first: the chunk index of the level's first tile. Levels come in order of ly, lx."""
    out = levels(headers).withColumn("nx", G.tiles(F.col("lw"), F.col("tw"))).withColumn("ny", G.tiles(F.col("lh"), F.col("th")))
    before = Window.partitionBy("id").orderBy("ly", "lx").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("first", F.coalesce(F.sum(F.col("nx") * F.col("ny")).over(before), F.lit(0)))


def chunk_count(w: Column, h: Column, compression: Column) -> Column:
    """Chunks of a scanline image."""
    lines = G.lines_per_chunk(compression)
    return F.floor((h + lines - 1) / lines).cast("bigint")


def catalogue(headers: DataFrame, sample_bytes: int = 4, head: int = 20) -> DataFrame:
    """(id, idx, lx, ly, tx, ty, x0, y0, x1, y1, offset, length): every tile of every level, stored raw one after another behind a head of fixed length.

    A tile's offset has a closed form, so chunks are neither dealt nor sorted. Headers are dealt
    by id over tasks by their number before they become chunks: a few bytes of headers are
    hundreds of chunks each, and what counts partitions by bytes would put all into a few tasks.
    """
    spark = headers.sparkSession
    tasks = max(DEALT * spark.sparkContext.defaultParallelism, -(-headers.count() // DEALT_HEADERS))
    t = level_tiles(headers.repartition(tasks, "id"))
    before = Window.partitionBy("id").orderBy("ly", "lx").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.col("nx") * F.col("ny") * head + F.col("lw") * F.col("lh") * sample_bytes).over(before), F.lit(0)))
    t = t.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ny") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") - 1)))
    x0, x1 = G.tile_span(F.lit(0), F.col("lw") - 1, F.col("tw"), F.col("tx"))
    y0, y1 = G.tile_span(F.lit(0), F.col("lh") - 1, F.col("th"), F.col("ty"))
    # before a tile: the levels before, whole rows of tiles, and tiles of its own row, which are all of full width
    rows, lines = F.col("ty") * (F.col("lw") * F.col("th") * sample_bytes + F.col("nx") * head), y1 - y0 + 1
    offset = F.col("at") + rows + F.col("tx") * (F.col("tw") * lines * sample_bytes + head)
    t = t.select("id", (F.col("first") + F.col("ty") * F.col("nx") + F.col("tx")).alias("idx"), "lx", "ly", "tx", "ty", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), offset.alias("offset"))
    size = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) * sample_bytes + head
    return t.withColumn("length", size)


def for_scanlines(chunks: DataFrame, first: int, last: int) -> DataFrame:
    """Chunks with lines of [first, last]; swapped ends are accepted."""
    low, high = min(first, last), max(first, last)
    return chunks.where((F.col("y1") >= low) & (F.col("y0") <= high))


def for_region(chunks: DataFrame, x0: int, y0: int, x1: int, y1: int, lx: int = 0, ly: int = 0) -> DataFrame:
    """Chunks of one level that the half-open region [x0, x1) x [y0, y1) touches."""
    return chunks.where((F.col("lx") == lx) & (F.col("ly") == ly) & (F.col("x0") < x1) & (F.col("x1") >= x0) & (F.col("y0") < y1) & (F.col("y1") >= y0))


def viewport(pixels: DataFrame, window: tuple[int, int, int, int], request: tuple[int, int, int, int]) -> DataFrame:
    """The pixels of request, clipped to window; both are inclusive boxes (x0, y0, x1, y1).

    The bounds are literals, so that Parquet sorted by y (and x) is read by row groups that
    overlap. A request beside the window is an error.
    """
    x0, y0, x1, y1 = max(window[0], request[0]), max(window[1], request[1]), min(window[2], request[2]), min(window[3], request[3])
    if x0 > x1 or y0 > y1:
        raise ValueError("the region lies outside the data window")
    return pixels.where(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
