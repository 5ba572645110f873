"""Sharding of key-value stores: choosing the parameters, hashing keys to shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.plans.metadata import SHARD_HASHES, SHARDING_KIND

# What the interchange format's writer aims at.
MINISHARD_TARGET = 1000
SHARD_TARGET_BYTES = 50_000_000


@dataclass(frozen=True)
class ShardSpec:
    preshift_bits: int
    hash: str
    minishard_bits: int
    shard_bits: int
    minishard_index_encoding: str = "gzip"
    data_encoding: str = "gzip"

    def to_json(self) -> dict:
        return {"@type": SHARDING_KIND} | {k: getattr(self, k) for k in ("preshift_bits", "hash", "minishard_bits", "shard_bits", "minishard_index_encoding", "data_encoding")}

    @classmethod
    def from_json(cls, doc: dict) -> ShardSpec:
        return cls(doc["preshift_bits"], plain_hash(doc["hash"]), doc["minishard_bits"], doc["shard_bits"], doc.get("minishard_index_encoding", "raw"), doc.get("data_encoding", "raw"))


def plain_hash(name: str) -> str:
    name = "identity" if name == "identity_hash" else name
    if name not in SHARD_HASHES:
        raise ValueError(f"unknown hash {name!r}")
    return name


def _bits(count: int, most: int) -> int:
    """Least number of bits whose buckets hold at most ``most`` of ``count`` each."""
    return max(0, (count // (most + 1)).bit_length()) if count > most else 0


def choose_spec(count: int, size: int, hash: str = "murmurhash3_x86_128", gzip: bool = True) -> ShardSpec | None:
    """Parameters for ``count`` entries of ``size`` bytes together; None where sharding has no use."""
    hash = plain_hash(hash)
    if count == 1:
        return None
    total, shard = _bits(count, MINISHARD_TARGET), _bits(size, SHARD_TARGET_BYTES)
    coding = "gzip" if gzip else "raw"
    return ShardSpec(MINISHARD_TARGET.bit_length(), hash, total - min(total, shard), shard, coding, coding)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint32(n) | x >> np.uint32(32 - n)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return x ^ x >> np.uint32(16)


def murmur_low64(x: np.ndarray) -> np.ndarray:
    """First 8 bytes of MurmurHash3_x86_128 (seed 0) over each number's eight little-endian bytes, as
    uint64. The input is shorter than a block, so only the tail and the finish apply."""
    x = x.astype(np.uint64)
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    size = np.uint32(8)
    lanes = [
        _turn(low * np.uint32(0x239B961B), 15) * np.uint32(0xAB0E9789) ^ size,
        _turn(high * np.uint32(0xAB0E9789), 16) * np.uint32(0x38B34AE5) ^ size,
        np.full(len(x), size),
        np.full(len(x), size),
    ]

    def spread(lanes: list[np.ndarray]) -> list[np.ndarray]:
        first = lanes[0] + lanes[1] + lanes[2] + lanes[3]
        return [first, *[h + first for h in lanes[1:]]]

    lanes = spread([_finish(h) for h in spread(lanes)])
    return lanes[0].astype(np.uint64) | lanes[1].astype(np.uint64) << np.uint64(32)


def shard_and_minishard(keys: np.ndarray, spec: ShardSpec) -> tuple[np.ndarray, np.ndarray]:
    hashed = keys.astype(np.int64).view(np.uint64) >> np.uint64(spec.preshift_bits) if spec.preshift_bits < 64 else np.zeros(len(keys), np.uint64)
    if spec.hash != "identity":
        hashed = murmur_low64(hashed)
    part = lambda at, n: (hashed >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) if n else np.zeros(len(keys), np.int64)
    return part(spec.minishard_bits, spec.shard_bits), part(0, spec.minishard_bits)


def shard_column(key: Column, spec: ShardSpec) -> Column:
    """``struct<shard, minishard>`` of a bigint key column."""

    def run(keys: pd.Series) -> pd.DataFrame:
        shard, minishard = shard_and_minishard(keys.to_numpy(), spec)
        return pd.DataFrame({"shard": shard, "minishard": minishard})

    return F.pandas_udf(run, T.StructType([T.StructField("shard", T.LongType()), T.StructField("minishard", T.LongType())]))(key)
