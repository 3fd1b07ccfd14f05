"""Manifests from hashed ids to names."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.hashing import float_safe, murmur32, murmur64

SCHEMES = ("murmur32", "murmur64", "float32")
#: Ranks of id and coverage that a channel set has.
RANKS = 3


def hashed(values: Sequence[Column], scheme: str = "murmur32") -> Column:
    """The id of values, joined with NUL."""
    joined = F.concat_ws("\u0000", *values)
    if scheme not in SCHEMES:
        raise ValueError(f"no scheme {scheme}")
    return murmur64(joined) if scheme == "murmur64" else float_safe(murmur32(joined)) if scheme == "float32" else murmur32(joined)


def insert(rows: DataFrame, columns: Sequence[str], scheme: str = "murmur32") -> DataFrame:
    """(id, names) of the distinct values of columns; ids that several values share have all of them, in order."""
    values = rows.select(*columns).distinct()
    return values.select(hashed([F.col(c) for c in columns], scheme).alias("id"), F.array(*columns).alias("names")).groupBy("id").agg(F.array_sort(F.collect_list("names")).alias("names"))


def lookup(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """ids with the names of each; null where the manifest has none. The optimiser broadcasts a manifest that is small."""
    return ids.join(manifest, "id", "left")


def group_of(groups: DataFrame, channel: str) -> DataFrame:
    """The first group (idx, channels) that has a channel."""
    return groups.where(F.array_contains("channels", channel)).orderBy("idx").limit(1)


def channel_set(name: str) -> list[str]:
    """Names of the channels that hold ids and coverages."""
    return [f"{name}{rank:02d}.{c}" for rank in range(RANKS) for c in "RGBA"]


def read_json(manifests: DataFrame) -> DataFrame:
    """(name, value, id) of manifests that are JSON objects of name to eight hexadecimal digits."""
    entries = F.explode(F.from_json("json", "map<string,string>"))
    return manifests.select("manifest", entries.alias("name", "hex")).select("manifest", "name", F.conv("hex", 16, 10).cast("bigint").alias("id"))


def write_json(entries: DataFrame) -> DataFrame:
    """(manifest, json): names in order, ids as eight hexadecimal digits."""
    pair = F.struct("name", F.lower(F.lpad(F.hex("id"), 8, "0")).alias("hex"))
    return entries.groupBy("manifest").agg(F.array_sort(F.collect_list(pair)).alias("p")).select("manifest", F.to_json(F.map_from_entries("p")).alias("json"))


def encode(entries: Mapping[int, Sequence[str]]) -> bytes:
    """Entries by id, as counted strings, compressed."""
    out = [struct.pack("<I", len(entries))]
    for key in sorted(entries):
        names = [n.encode() for n in entries[key]]
        out.append(struct.pack("<QI", key & (1 << 64) - 1, len(names)))
        out += [struct.pack("<I", len(n)) + n for n in names]
    raw = b"".join(out)
    return struct.pack("<I", len(raw)) + zlib.compress(raw)


def decode(blob: bytes) -> dict[int, list[str]]:
    """The inverse of encode; damaged bytes are a ValueError."""
    try:
        size = struct.unpack_from("<I", blob)[0]
        raw = zlib.decompress(blob[4:], bufsize=max(1, size))
        if len(raw) != size:
            raise ValueError("length")
        (n,) = struct.unpack_from("<I", raw)
        at, out = 4, {}
        for _ in range(n):
            key, count = struct.unpack_from("<QI", raw, at)
            at += 12
            names = []
            for _ in range(count):
                (k,) = struct.unpack_from("<I", raw, at)
                if at + 4 + k > len(raw):
                    raise ValueError("string")
                names.append(raw[at + 4 : at + 4 + k].decode())
                at += 4 + k
            out[key] = names
        return out
    except (struct.error, zlib.error, UnicodeDecodeError) as e:
        raise ValueError("damaged manifest") from e


def write_binary(entries: DataFrame) -> DataFrame:
    """(manifest, blob): the entries (manifest, name, id) of each manifest by encode(); a manifest is put together in one task."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list[str]] = {}
        for i, name in sorted(zip(frame["id"], frame["name"], strict=True)):
            by.setdefault(int(i), []).append(name)
        return pd.DataFrame([(key[0], encode(by))], columns=["manifest", "blob"])

    kind = entries.schema["manifest"].dataType.simpleString()
    return entries.select("manifest", "name", "id").groupBy("manifest").applyInPandas(run, f"manifest {kind}, blob binary")


def read_binary(manifests: DataFrame) -> DataFrame:
    """(manifest, name, id) of blobs by decode(); ids of 64 bits are signed. Damaged bytes are an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for key, blob in zip(frame["manifest"], frame["blob"], strict=True):
                rows = [(key, name, i - (1 << 64) if i >> 63 else i) for i, names in decode(bytes(blob)).items() for name in names]
                yield pd.DataFrame(rows, columns=["manifest", "name", "id"])

    kind = manifests.schema["manifest"].dataType.simpleString()
    return manifests.select("manifest", "blob").mapInPandas(run, f"manifest {kind}, name string, id bigint")
