"""Shards by Hilbert-curve order of several metadata dimensions (DataFrame only).

Each dimension is quantised at approximate quantiles, the levels are looked up as
a place on the Hilbert curve, rows are ranked along the curve, and the ranking is
cut into runs of equal row counts. Rows near each other in all dimensions share a
shard, so the minima and maxima of its files prune well on any of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_table, stored


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims) of ``bits`` bits each:
    exclusive-or undoing of excess rotations, then a Gray decoding."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def as_number(df: DataFrame, name: str) -> Column:
    """A value's place in its own order, as a number: strings by their first seven
    bytes, others as doubles; null first."""
    if df.schema[name].dataType.typeName() == "string":
        head = F.hex(F.substring(F.col(name).cast("binary"), 1, 7))
        return F.coalesce(F.conv(F.rpad(head, 14, "0"), 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(F.nullif(F.col(name).cast("double"), F.lit(float("nan"))), F.lit(-1e308))


def hilbert_shards(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("source", "lang", "size"), bits: int = 5) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, and ``dims``; others are ignored) in a shard.

    Returns (doc_id, size, text_crc32, curve, shard, slot). ``size`` is the text's
    UTF-8 bytes plus 8 (null text: 8, and the checksum of no bytes). Ranks are exact:
    shards' row counts differ by one at most, slots are gapless from 0. Ties on the
    curve go by a hash of doc_id and text, so repeated rows are interchangeable. An
    empty table gives no rows. dims * bits is 18 at most, which bounds the curve's
    table and the cells whose counts one task adds up.
    """
    if len(dims) * bits > 18:
        raise ValueError("dims * bits must be 18 at most")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.withColumn("size", (F.octet_length(text) + 8).cast("long")).withColumn("text_crc32", F.crc32(text))
    names = [f"dim{i}" for i in range(len(dims))]
    rows = rows.select("doc_id", "size", "text_crc32", *(as_number(rows, d).alias(n) for d, n in zip(dims, names)))
    rows = stored(rows.withColumn("tie", F.xxhash64("doc_id", "text_crc32", "size")), "shard-rows")
    levels = 1 << bits
    cuts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(n, [i / levels for i in range(1, levels)], 10000).alias(n) for n in names)).first()
    total = cuts["n"]
    for n in names:
        bounds = sorted(set(cuts[n] or []))
        level = sum(((F.col(n) > F.lit(b)).cast("int") for b in bounds), F.lit(0))
        rows = rows.withColumn(n, level)
    grid = np.stack(np.meshgrid(*[np.arange(levels)] * len(dims), indexing="ij"), -1).reshape(-1, len(dims))
    table = {n: pa.array(grid[:, i], pa.int32()) for i, n in enumerate(names)} | {"curve": pa.array(hilbert_index(grid, bits), pa.int64())}
    rows = rows.join(F.broadcast(local_table(docs.sparkSession, pa.table(table))), names).drop(*names)

    fine = max(0, (total >> 16).bit_length())
    rows = rows.withColumn("part", F.shiftrightunsigned("tie", 64 - fine) if fine else F.lit(0).cast("long"))
    counts = rows.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    prior = (Window.unboundedPreceding, -1)
    cells = counts.groupBy("curve").agg(F.sum("n").alias("n"))
    cells = cells.select("curve", F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(*prior)), F.lit(0)).alias("cell_base"))
    parts = counts.withColumn("part_base", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(*prior)), F.lit(0)))
    base = parts.join(F.broadcast(cells), "curve").select("curve", "part", (F.col("cell_base") + F.col("part_base")).alias("base"))
    inside = Window.partitionBy("curve", "part").orderBy("tie", "doc_id", "size", "text_crc32")
    ranked = rows.join(base, ["curve", "part"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    ranked = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - first).alias("slot"))
