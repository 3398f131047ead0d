"""Sharding: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import documents, row_numbers, text_of

SEED = 20_260_101
ROUNDS = 6
SHARDS = 16


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift), keyed by addition."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int(k) for k in np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, rounds)]


def feistel(x: np.ndarray, half_bits: int, keys: list[int]) -> np.ndarray:
    """A permutation of the numbers below 4 ** half_bits."""
    half, mask = np.uint64(half_bits), np.uint64((1 << half_bits) - 1)
    left, right = x >> half, x & mask
    for key in keys:
        left, right = right, left ^ (_mixed(right, key) & mask)
    return (left << half) | right


def permuted(rows: np.ndarray, total: int, seed: int = SEED) -> np.ndarray:
    """Where each row number below total goes, in a permutation of the numbers below total.

    The network permutes the next power of four; a value at or over total walks on along its cycle, which
    must come back below total, so every row ends on a slot of its own.
    """
    rows, keys = rows.astype(np.uint64), round_keys(seed)
    half_bits = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    out = feistel(rows, half_bits, keys)
    astray = np.flatnonzero(out >= np.uint64(total))
    while len(astray):
        out[astray] = feistel(out[astray], half_bits, keys)
        astray = astray[out[astray] >= np.uint64(total)]
    return out.astype(np.int64)


def sharded(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (from 0 in each shard) to every row.

    Rows are numbered in ascending order, nulls last; counts of shards differ by one at most. Rows equal in every
    column of `order` may change places with each other. Columns of those two names are replaced. An empty table gives an
    empty result.
    """

    @F.pandas_udf("long")
    def place(row: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(), int(total.iloc[0]), seed)) if len(row) else row

    numbered = row_numbers(df, order).withColumn("_mx_to", place("_mx_row_no", "_mx_total"))
    return numbered.withColumns({"shard": (F.col("_mx_to") % shards).cast("int"), "slot": F.floor(F.col("_mx_to") / shards).cast("long")}).drop("_mx_to", "_mx_row_no", "_mx_total")


def locate(row: int, total: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row number, without any table."""
    to = int(permuted(np.array([row]), total, seed)[0])
    return to % shards, to // shards


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: the permuted row number modulo 16. Null text counts as empty; null doc_id comes last in order."""
    text = text_of("text")
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharded(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _rounds_sql(keys: list[int]) -> str:
    """The network over the whole domain, a round in three steps (64-bit products by way of 128 bits)."""
    modulus, out = 1 << 64, []
    for i, key in enumerate(keys):
        out.append(f"a{i} AS (SELECT x, l, r, ((((r::UHUGEINT + {key}) % {modulus}) * {0x9E3779B97F4A7C15}) % {modulus})::UBIGINT AS a FROM k{i})")
        out.append(f"b{i} AS (SELECT x, l, r, ((xor(a, a >> 32)::UHUGEINT * {0xD6E8FEB86659FD93}) % {modulus})::UBIGINT AS a FROM a{i})")
        out.append(f"k{i + 1} AS (SELECT x, r AS l, xor(l, xor(a, a >> 29) & mask) AS r FROM b{i}, c)")
    return ", ".join(out)


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


#: For tables in which no two rows have equal doc_id and size. DuckDB has no CRC, so it goes over the bytes.
OP10_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text FROM documents
), numbered AS (
  SELECT doc_id, size, text, row_number() OVER (ORDER BY doc_id NULLS LAST, size) - 1 AS pos, count(*) OVER () AS n FROM docs
), h AS (
  SELECT max(n) AS n, greatest(1, (length(ltrim(bin(greatest(max(n) - 1, 1)::BIGINT), '0')) + 1) // 2)::INTEGER AS half FROM numbered
), c AS (
  SELECT n, half, ((1::UBIGINT << half) - 1)::UBIGINT AS mask FROM h
), k0 AS (
  SELECT range::UBIGINT AS x, range::UBIGINT >> half AS l, range::UBIGINT & mask AS r FROM c, range((1::BIGINT << (2 * half)))
), {_rounds_sql(round_keys(SEED))}, f AS (
  SELECT x, (l << half) | r AS y FROM k{ROUNDS}, c
), walk AS (
  SELECT x AS start, y FROM f, c WHERE x < n UNION ALL SELECT start, f.y FROM walk JOIN f ON walk.y = f.x, c WHERE walk.y >= n
), placed AS (
  SELECT start, y FROM walk, c WHERE y < n
), crcs AS (
  SELECT {_crc_table()}::BIGINT[] AS steps
)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(text), '..'), lambda b: ('0x' || b)::BIGINT),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32,
  (y % {SHARDS})::INTEGER AS shard, (y // {SHARDS})::BIGINT AS slot, 'rows' AS law, NULL::INTEGER AS grown_shard
FROM numbered JOIN placed ON pos = start, crcs
"""
