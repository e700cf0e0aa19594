"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame only).

Golden-ratio points are mapped through the cumulative shares of the sources, the
slots of each source are ranked, and slot ``j`` of a source takes the ``j``-th
equal-token block of that source's shuffled, endlessly repeated word stream. What a
slot takes of which document are its pieces; all else is derived from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, local_table, stored

#: The golden ratio's fraction in 31 bits, made odd: a Weyl sequence without overflow.
GOLDEN = 1327217885
SPAN = 1 << 31
_BINS = 1024
_CHUNK = 1 << 16
_SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """``pieces``: what each slot takes (slot, at, doc_id, source, fingerprint, copy,
    size, pass, words), in order of slot and then of ``at``, its first word's place in
    the block. ``taken``: a row for each document (doc_id, source, size, source_size,
    target, taken, slots, first_slot), summed from the pieces; ``sources``: the driver's
    table of sources and targets."""

    pieces: DataFrame
    taken: DataFrame
    sources: list[dict]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Share ``share * sum(sizes)`` by weight; a source stops at ``cap`` times its
    size and its excess is shared again by weight until none is above."""
    total, left = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while left:
        unit = total / (sum(weights[i] for i in left) or 1)
        full = {i for i in left if unit * weights[i] > cap * sizes[i]}
        if not full:
            for i in left:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            total -= out[i]
        left -= full
    return out


def fingerprint(columns: list[str]) -> Column:
    """What tells rows of one doc_id and source apart: the text and other ``columns``."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns]
    return F.md5(F.concat_ws("\x00", F.coalesce("text", F.lit("")), *rest))


def _copies(docs: DataFrame, identity: list[str]) -> DataFrame:
    """A row for each document, without its text: rows that are alike in doc_id, source
    and fingerprint are counted first and numbered by ``copy`` from 1. A large group of
    them is dealt by runs of numbers, so no task makes all of it."""
    groups = docs.groupBy("doc_id", "source", fingerprint(identity).alias("fingerprint")).agg(F.max(word_count(F.col("text"))).alias("size"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "mix-groups")
    key = ["doc_id", "source", "fingerprint", "size"]
    few = groups.filter(F.col("n") <= _CHUNK).select(*key, F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    many = groups.filter(F.col("n") > _CHUNK).select(*key, "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {_CHUNK})")).alias("run")).repartition("fingerprint", "run")
    many = many.select(*key, F.explode(F.expr(f"sequence(run * {_CHUNK} + 1, least(n, (run + 1) * {_CHUNK}))")).alias("copy"))
    draw = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "fingerprint", F.col("copy").cast("string")))
    return few.unionByName(many).withColumn("draw", draw)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 1024,
    max_sources: int = 1_000_000,
    identity: list[str] = [],  # noqa: B006
) -> Mix:
    """Plan the mix of ``docs`` (doc_id, source, text, ``identity``; others are ignored).

    Sources by code point, null last, take ``weights`` in turn. Every source gives
    ``round(target)`` words: whole passes over its shuffled stream, then a part.
    Null text and text without words have size 0 and take part with 0 taken words and
    no slot. Repeated rows count as documents of their own, in some order; so do rows
    without a doc_id. A text of any length is cut at block ends. An empty table gives
    no rows. The sources are configuration, so their table (not the documents) is held
    by the driver; more than ``max_sources`` of them is an error, never a silent cap.
    """
    spark = docs.sparkSession
    sized = stored(_copies(docs, identity), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources: raise max_sources to mix so many")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    shares = capped_targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, cap)
    sources, total_slots = [], 0
    for sid, (r, target) in enumerate(zip(found, shares)):
        size, limit = int(r["size"]), int(target + 0.5)
        blocks = -(-size // block_words)
        passes, rest = divmod(limit, size) if size else (0, 0)
        need = passes * blocks + -(-rest // block_words)
        sources.append({"source": r["source"], "sid": sid, "source_size": size, "target": float(target), "limit_words": limit, "blocks": blocks, "need": need})
        total_slots += need
    table = _source_table(spark, sources)
    slots = _schedule(spark, table, sources, total_slots, block_words)

    # each document's place in its source's shuffled stream: sums of hash ranges, then within one
    ranges, rows = 1, sum(r["n"] for r in found)
    while ranges < max(rows / 4096, min(rows / 64, 65536)):
        ranges *= 2
    named = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["source"])).drop(table["source"])
    placed = named.withColumn("range", F.shiftright(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * ranges, 32))
    base = placed.groupBy("sid", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("sid", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "range").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(base, ["sid", "range"]).withColumn("start", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    key = ["doc_id", "source", "fingerprint", "copy", "size"]
    spread = placed.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")))
    )
    b = F.lit(block_words)
    spread = spread.select(
        "sid", "block", *key,
        F.greatest(F.col("start") - F.col("block") * b, F.lit(0)).alias("lo"),
        F.least(F.col("start") + F.col("size") - F.col("block") * b, b).alias("hi"),
    )
    pieces = spread.join(slots, ["sid", "block"]).withColumn("words", F.least("hi", "room") - F.col("lo")).filter("words > 0")
    pieces = stored(pieces.select("slot", F.col("lo").alias("at"), *key, "pass", "words"), "mix-pieces")
    got = pieces.groupBy(*key).agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("slots"), F.min("slot").alias("first_slot"))
    names, own = {c: f"_{c}" for c in key}, named.select(*key, "source_size", "target")
    got = got.withColumnsRenamed(names)
    same = [own[c].eqNullSafe(got[n]) for c, n in names.items()]
    taken = own.join(got, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), "first_slot"
    )
    return Mix(pieces, taken, sources)


def _source_table(spark, sources: list[dict]) -> DataFrame:
    types = {"source": pa.string(), "sid": pa.int32(), "source_size": pa.int64(), "target": pa.float64(), "limit_words": pa.int64(), "blocks": pa.int64(), "need": pa.int64()}
    return local_table(spark, pa.table({k: pa.array([s[k] for s in sources], t) for k, t in types.items()}))


def _schedule(spark, table: DataFrame, sources: list[dict], n: int, block_words: int) -> DataFrame:
    """Slots 0 to n - 1 by golden-ratio points; surplus slots of a source are left
    out and missing ones follow at the end, so each source has exactly its need."""
    bins, lo, cum = [], 0, 0
    for s in sources:
        cum += s["need"]
        hi = cum * SPAN // n if n else 0
        if hi > lo:
            bins += [(b, s["sid"], lo, hi) for b in range(lo * _BINS // SPAN, (hi - 1) * _BINS // SPAN + 1)]
        lo = max(lo, hi)
    cuts = local_table(
        spark,
        pa.table({k: pa.array([r[i] for r in bins], t) for i, (k, t) in enumerate((("bin", pa.int64()), ("sid", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())))}),
    )
    point = (F.col("slot") % SPAN) * GOLDEN % SPAN
    drawn = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"))
    drawn = drawn.withColumn("bin", F.expr(f"point * {_BINS} div {SPAN}")).join(F.broadcast(cuts), "bin").filter("lo <= point and point < hi")
    drawn = drawn.select("slot", "sid", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = drawn.join(counts.drop("n"), ["sid", "chunk"]).select(
        "slot", "sid", (F.col("base") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).alias("rank")
    )
    # what the points left short follows at the end, one number a slot: source after source
    had = {r["sid"]: r["had"] for r in counts.groupBy("sid").agg(F.sum("n").alias("had")).collect()}
    late, at = [], n
    for s in sources:
        short = s["need"] - had.get(s["sid"], 0)
        if short > 0:
            late.append((s["sid"], had.get(s["sid"], 0), s["need"] - 1, at))
            at += short
    late = local_table(spark, pa.table({k: pa.array([r[i] for r in late], t) for i, (k, t) in enumerate((("sid", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("base", pa.int64())))}))
    late = late.select("sid", "low", "base", F.explode(F.sequence("low", "high")).alias("rank")).select((F.col("base") + F.col("rank") - F.col("low")).alias("slot"), "sid", "rank")
    slots = ranked.unionByName(late).join(F.broadcast(table.drop("source", "target")), "sid").filter("rank < need")
    done = F.expr(f"(rank div blocks) * source_size + (rank % blocks) * {block_words}")
    return slots.select("slot", "sid", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("pass"), (F.col("limit_words") - done).alias("room"))


def mixed_documents(docs: DataFrame, plan: Mix, columns: list[str]) -> DataFrame:
    """The mix as documents, in the order of the schedule: one row for each whole pass
    over a document, and one with its first words (white space and all) where its
    source's last pass ends inside it. A row's place is that of its first piece's slot.
    A document of which nothing is taken is left out. ``plan`` is of the same ``docs``
    with ``columns`` as its identity, so rows that are alike in all of them are one
    document here and as many in the plan. ``n_chars`` follows the text."""
    key = ["doc_id", "source", "fingerprint"]
    first = F.min(F.struct("slot", "at"))
    got = plan.pieces.groupBy(*key, "copy", "size", "pass").agg(F.sum("words").alias("_words"), first.alias("_place"))
    got = got.withColumnsRenamed({c: f"_{c}" for c in [*key, "size"]})
    rows = docs.withColumn("fingerprint", fingerprint(columns)).dropDuplicates(key)
    rows = rows.join(got, [rows[c].eqNullSafe(got[f"_{c}"]) for c in key])
    # words with the white space before them, so a cut text keeps its own
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_SPACED_WORD), F.lit(0)), 1, F.col("_words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(part))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.orderBy("_place.slot", "_place.at").select(*columns)
