"""N-gram Jaccard join through count-vector R-trees.

A document is the set of its distinct word shingles. Documents with the same set
form a class, and classes are joined:

* Routing. Shingles have one global order, rarest group first; a class is indexed
  under each shingle of its prefix, which holds the first shared shingle of every
  similar pair. Each prefix shingle is thus one small tree.
* Tree. The shingles of a class are hashed into ``GROUPS`` groups, and its group
  counts are a point. The rows of a tree are packed by size into leaves with their
  largest counts and least sizes. The sum of coordinate minima bounds the overlap,
  of two leaves and then of two points; what stays under the needed overlap goes.
* Verification. Surviving pairs are checked on their whole shingle sets.

Pairs are searched in two rounds, so that a large group of near copies gives about
as many pairs as it has members. The first round links neighbours in a tree, and
all points of a leaf run to its medoid; verified links become components. The
second round takes every remaining pair of points whose components differ, with no
cap, so each component ends up with exactly the documents that links can reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, shingle_set, stored, word_hashes

GROUPS = 32
_SKETCH_BITS = 18  # groups whose frequencies order the shingles
_SEEN_BITS = 25  # bitmap of the classes that need their sets
_LEAF = 32
_RUN = 4096  # points of one tree that are worked on together
_LONG = (1 << 63) - 1


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """Counts by hash group; a count too large for 16 bits is kept as the largest."""
    counts = np.bincount((shingles >> np.uint64(59)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 65535).astype(np.uint16)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of coordinate minima; no bound where a count was too large to keep."""
    low = np.minimum(a, b)
    return np.where((low == 65535).any(-1), _LONG, low.sum(-1, dtype=np.int64))


class Threshold:
    """Jaccard similarity of at least ``percent`` / 100, in integers."""

    def __init__(self, percent: int):
        self.percent = percent

    def need(self, a, b):
        """The least intersection of similar sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def _sets(docs: DataFrame, k: int):
    def of(batch, column: int) -> Iterator[np.ndarray]:
        for text in byte_views(batch.column(column)):
            yield shingle_set(word_hashes(text), k) if text is not None else np.zeros(0, np.uint64)

    return of


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**_SEEN_BITS bits over class ids: a fixed 4 MB, or-ed together by
    chunks on executors. It may hold more classes than asked for, never fewer."""
    bits, chunk = 1 << _SEEN_BITS, 1 << 17

    def run(batches):
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[np.asarray(batch.column(0)) & (bits - 1)] = True
        packed = np.packbits(seen)
        for c in range(0, len(packed), chunk):
            if packed[c : c + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([packed[c : c + chunk].tobytes()], pa.binary())], names=["c", "b"])

    def merge(table):
        out = np.zeros(chunk, np.uint8)
        for b in table.column("b"):
            out |= np.frombuffer(b.as_buffer(), np.uint8)
        return pa.table({"c": pa.array([table.column("c")[0].as_py()], pa.int64()), "b": pa.array([out.tobytes()], pa.binary())})

    rows = ids.mapInArrow(run, "c long, b binary").groupBy("c").applyInArrow(merge, "c long, b binary").collect()
    packed = np.zeros(bits // 8, np.uint8)
    for r in rows:
        packed[r["c"] : r["c"] + chunk] = np.frombuffer(r["b"], np.uint8)
    return packed


def _frequencies(parts: DataFrame) -> np.ndarray:
    """How often shingles of each of 2**_SKETCH_BITS hash groups occur: one fixed-size
    table, whatever the corpus; it only orders shingles, so collisions cost nothing
    but speed."""
    size = 1 << _SKETCH_BITS

    def merge(table):
        total = np.zeros(size >> 4, np.int64)
        for b in table.column("b"):
            total += np.frombuffer(b.as_buffer(), np.int32)
        return pa.table({"c": pa.array([table.column("c")[0].as_py()], pa.int64()), "b": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, np.int64)
    for r in parts.groupBy("c").applyInArrow(merge, "c long, b binary").collect():
        out[r["c"] : r["c"] + (size >> 4)] = np.frombuffer(r["b"], np.int64)
    return out


def _scan(docs: DataFrame, k: int, kind: str) -> DataFrame:
    """First pass: class, set size and point of every document, and each task's part of
    the frequency table."""
    of, size = _sets(docs, k), 1 << _SKETCH_BITS

    def run(batches):
        total, blank = np.zeros(size, np.int64), None
        for batch in batches:
            n, cid, points = [], [], []
            for s in of(batch, 1):
                n.append(len(s))
                cid.append(class_of(s) if len(s) else None)
                points.append(group_counts(s).tobytes() if len(s) else None)
                np.add.at(total, (s >> np.uint64(20)).astype(np.int64) & (size - 1), 1) if len(s) < 1024 else np.add(
                    total, np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size), out=total
                )
            blank = batch.column(0).type
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(points, pa.binary()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())],
                names=["doc_id", "n", "cid", "point", "c", "b"],
            )
        if blank is not None:
            step = size >> 4
            at = list(range(0, size, step))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(16, blank), pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64()), pa.nulls(16, pa.binary()), pa.array(at, pa.int64()), pa.array([np.minimum(total[a : a + step], 2**31 - 1).astype(np.int32).tobytes() for a in at], pa.binary())],
                names=["doc_id", "n", "cid", "point", "c", "b"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, cid long, point binary, c long, b binary")


def _index_rows(docs: DataFrame, k: int, limit: Threshold, frequencies) -> DataFrame:
    """Second pass: for each class (once a task) a row for each prefix shingle. ``place``
    packs the set's size (upper half) and the shingle's place in the prefix: most rows
    are alone in their tree, so they are dealt without their points."""
    of = _sets(docs, k)

    def run(batches):
        often, done = frequencies.value, set()
        for batch in batches:
            keys, cids, sizes = [], [], []

            def flush():
                counts = [len(x) for x in keys]
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.repeat(np.array(cids, np.int64), counts)),
                        pa.array((np.repeat(np.array(sizes, np.int64), counts) << 32) + np.concatenate([np.arange(c, dtype=np.int64) for c in counts])),
                    ],
                    names=["key", "cid", "place"],
                )
                for x in (keys, cids, sizes):
                    x.clear()
                return out

            held = 0
            for s in of(batch, 0):
                if not len(s) or (cid := class_of(s)) in done:
                    continue
                done.add(cid)
                order = np.argsort(often[(s >> np.uint64(20)).astype(np.int64) & ((1 << _SKETCH_BITS) - 1)], kind="stable")
                keys.append(s[order[: limit.prefix(len(s))]])
                cids.append(cid)
                sizes.append(len(s))
                held += len(keys[-1])
                if held > 20_000:
                    yield flush()
                    held = 0
            if keys:
                yield flush()

    return docs.select("text").mapInArrow(run, "key long, cid long, place long")


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, GROUPS)


def _may_link(limit: Threshold, n, at, points, i, j) -> np.ndarray:
    """Whether rows i and j of one tree can be similar: by size, by place in the
    prefix order, and by the sum of coordinate minima where points are given."""
    need = limit.need(n[i], n[j])
    ok = (np.minimum(n[i], n[j]) >= need) & (1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1 >= need)
    at_all = np.flatnonzero(ok)
    if points is not None and len(at_all):
        ok[at_all] = overlap_bound(points[i[at_all]], points[j[at_all]]) >= need[at_all]
    return ok


def _near_pairs(rows: DataFrame, limit: Threshold) -> DataFrame:
    """Round one over rows sorted by (key, n, cid) in stored files: neighbours in a tree,
    and members with their run's medoid. Holds one batch at a time (plus the row before
    it), so a tree of any size streams through. Where a reader cuts a tree in two, the
    pairs across the cut are left to round two."""

    def run(batches):
        last = None
        for batch in batches:
            key, cid, n, at = (np.asarray(batch.column(c)) for c in range(4))
            same = key[1:] == key[:-1]
            paired = np.zeros(len(key), bool)
            paired[1:] |= same
            paired[:-1] |= same
            pick = np.flatnonzero(paired)
            edge = last is not None and len(key) and last[0][0] == key[0]
            if edge:
                pick = np.union1d(pick, [0])
            tail = tuple(x[-1:] for x in (key, cid, n, at)) + (_points(batch.column(4).slice(len(key) - 1)),) if len(key) else last
            if len(pick):
                points = _points(batch.column(4).take(pa.array(pick)))
                key, cid, n, at = key[pick], cid[pick], n[pick], at[pick]
                if edge:
                    key, cid, n, at, points = (np.concatenate(x) for x in zip(last, (key, cid, n, at, points)))
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                ends = np.append(starts[1:], len(key))
                i = [np.flatnonzero(key[1:] == key[:-1])]
                j = [i[0] + 1]
                for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                    for lo in range(s, e, _RUN):
                        run_ = np.arange(lo, min(e, lo + _RUN))
                        middle = np.median(points[run_], axis=0)
                        hub = run_[np.abs(points[run_] - middle).sum(1).argmin()]
                        rest = run_[run_ != hub]
                        i.append(rest)
                        j.append(np.full(len(rest), hub))
                i, j = np.concatenate(i), np.concatenate(j)
                ok = cid[i] != cid[j]
                i, j = i[ok], j[ok]
                ok = _may_link(limit, n, at, points, i, j)
                a, b = np.minimum(cid[i], cid[j])[ok], np.maximum(cid[i], cid[j])[ok]
                if len(a):
                    ab = np.unique(np.stack([a, b], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])
            last = tail

    return rows.mapInArrow(run, "a long, b long").distinct()


def _far_pairs(rows: DataFrame, limit: Threshold) -> DataFrame:
    """Round two: in each cell (key, one block against another) every pair of points
    from different components that the tree's bounds leave."""

    def leaves(n, points):
        cuts = np.arange(0, len(n), _LEAF)
        return cuts, np.maximum.reduceat(points, cuts, axis=0), np.minimum.reduceat(n, cuts), np.maximum.reduceat(n, cuts)

    def search(cid, n, at, comp, block, points):
        cross = bool(block.min() != block.max())
        cuts, top, least, most = leaves(n, points)
        for x in range(len(cuts)):
            # sizes rise from leaf to leaf: of the later ones, those small enough and that the bound leaves
            later = np.arange(x, len(cuts))
            later = later[least[later] * limit.percent <= 100 * most[x]]
            later = later[overlap_bound(top[later], top[x]) >= limit.need(least[x], least[later])]
            mine = np.arange(cuts[x], min(len(n), cuts[x] + _LEAF))
            for y in later:
                others = np.arange(cuts[y], min(len(n), cuts[y] + _LEAF))
                i, j = (z.ravel() for z in np.meshgrid(mine, others, indexing="ij"))
                ok = (comp[i] != comp[j]) & (i < j)
                if cross:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                if len(i):
                    ok = _may_link(limit, n, at, points, i, j)
                    yield cid[i][ok], cid[j][ok]

    def run(batches):
        """Whole cells at a time: they are bounded, as the blocks are."""

        def cells(batch, starts, ends):
            cid, n, at, comp, block = (np.asarray(batch.column(c)) for c in ("cid", "n", "at", "comp", "block"))
            two = starts[ends - starts == 2]
            i, j = two, two + 1
            ok = (comp[i] != comp[j]) & ((batch_lo(batch)[i] == batch_hi(batch)[i]) | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            found = []
            if len(i):
                points = _points(batch.column("point"))
                ok = _may_link(limit, n, at, points, i, j)
                found.append((cid[i[ok]], cid[j[ok]]))
            for s, e in zip(starts, ends):
                if e - s > 2 and (comp[s:e] != comp[s]).any():
                    points = _points(batch.column("point").slice(s, e - s))
                    found += search(cid[s:e], n[s:e], at[s:e], comp[s:e], block[s:e], points)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        batch_lo = lambda b: np.asarray(b.column("lo"))
        batch_hi = lambda b: np.asarray(b.column("hi"))
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cell = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "lo", "hi")], 1)
            starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(1))))
            if (made := cells(batch, starts[:-1], starts[1:])) is not None:
                yield made
            rest = batch.slice(int(starts[-1]))
        if rest is not None and (made := cells(rest, np.array([0]), np.array([rest.num_rows]))) is not None:
            yield made

    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    sizes = sizes.filter("x != y").select("key", F.expr(f"cast((m + {_RUN - 1}) div {_RUN} as int)").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.expr("cast(pmod(cid, blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = dealt.select("key", "lo", "hi", "block", "cid", "n", "at", "comp", "point")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "cid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _shingle_sets(docs: DataFrame, k: int, wanted) -> DataFrame:
    """Third pass: the whole sets of the classes in the bitmap, once a class."""
    of = _sets(docs, k)

    def run(batches):
        packed, done = wanted.value, set()
        for batch in batches:
            cids, sets = [], []
            for s in of(batch, 0):
                if not len(s) or (cid := class_of(s)) in done:
                    continue
                bit = cid & ((1 << _SEEN_BITS) - 1)
                if packed[bit >> 3] >> (7 - (bit & 7)) & 1:
                    done.add(cid)
                    cids.append(cid)
                    sets.append(s.view(np.int64))
            if cids:
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "shingles"])

    return docs.select("text").mapInArrow(run, "cid long, shingles array<long>").dropDuplicates(["cid"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``linked``: whether their whole sets are similar."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", (both * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).alias("linked"))


def _checked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Stored pairs, verified; only the sets of classes in a pair are made."""
    spark = pairs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    wanted = spark.sparkContext.broadcast(_bitmap(ids))
    # both joins read the one exchange by class, so sets are dealt once
    return stored(_verified(pairs, _shingle_sets(docs, k, wanted), percent), "ngram-checked")


def _forest(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars of its own components: fewer edges, same components."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        members = [(x, root(x)) for x in list(parent)]
        members = [m for m in members if m[0] != m[1]]
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in members], pa.int64()), pa.array([m[1] for m in members], pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp) of every endpoint of ``edges`` (a, b): comp is the least reachable
    id. Large-star and small-star rounds over stored edge tables; the number of rounds
    grows with the logarithm of a component's diameter."""
    edges = stored(_forest(edges).filter("a != b"), "component-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = large.filter("a != b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
        after = stored(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "component-edges")
        # stars remain: every member points at a root that points at nothing
        open_ends = after.select("b").join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        edges = after
        if not open_ends and not after.groupBy("a").count().filter("count > 1").limit(1).count():
            break
    out = edges.select(F.col("a").alias("cid"), F.col("b").alias("comp"))
    return stored(out.unionByName(edges.select(F.col("b").alias("cid"), F.col("b").alias("comp")).distinct()), "components")


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are ignored) with the size of
    its shingle set and its component.

    Returns (doc_id, n_shingles, component_id). Words are runs of characters other
    than code points 9 to 13 and 32, with A-Z in lower case; a set holds the distinct
    ``k``-word shingles, of fewer words the whole sequence. Two documents link when
    100 * intersection >= ``percent`` * union; component_id is the least doc_id that
    links reach. Null text and text without words have no shingles and no links:
    component_id is their own doc_id. Null doc_ids take part and rank last; a
    component of none but nulls has a null id. Repeated rows are linked copies. An
    empty table gives no rows. Shingles are 64-bit hashes.
    """
    spark = docs.sparkSession
    limit = Threshold(percent)
    docs = docs.select("doc_id", "text")
    scan = stored(_scan(docs, k, dict(docs.dtypes)["doc_id"]), "ngram-scan")
    rows = scan.filter("c is null").select("doc_id", "n", "cid")
    frequencies = spark.sparkContext.broadcast(_frequencies(scan.filter("c is not null").select("c", "b")))
    points = scan.filter("cid is not null").select("cid", "point").dropDuplicates(["cid"])
    index = _index_rows(docs, k, limit, frequencies).repartition("key").sortWithinPartitions("key", "place", "cid")
    shared = _trees(index, limit).join(points, "cid").select("key", "cid", "n", "at", "point")
    shared = stored(_trees(shared.repartition("key").sortWithinPartitions("key", "n", "at", "cid"), limit), "ngram-trees")
    near = stored(_near_pairs(shared, limit), "ngram-near")
    first = _checked(near, docs, k, percent)
    comps = components(first.filter("linked"))
    named = shared.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    far = stored(_far_pairs(named, limit).join(first.select("a", "b"), ["a", "b"], "left_anti"), "ngram-far")
    if not far.isEmpty():
        second = _checked(far, docs, k, percent)
        comps = components(first.unionByName(second).filter("linked"))
    least = rows.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("low"))
    least = least.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = least.join(least.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("cid", "component_id")
    found = _by_class(rows.filter("cid is not null"), least)
    alone = rows.filter("cid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def _trees(index: DataFrame, limit: Threshold) -> DataFrame:
    """Rows of trees in which some other row may link with them; a class's repeats from
    other tasks are left out. Rows come dealt and sorted by key, size, place and class:
    from the index with ``place``, or with their points, which bound the overlap too.
    Trees of over ``_LEAF`` rows pass whole, in pieces, so what is carried on is bounded."""
    bounded = "point" in index.columns

    def some(batch, whole: set):
        """The rows to keep of complete trees; ``whole``: keys of trees that pass as they are."""
        key, cid, n, at = (np.asarray(batch.column(c)) for c in range(4))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        size_of = np.repeat(sizes, sizes)
        keep = size_of > _LEAF
        for k in whole:
            keep |= key == k
        pick = np.flatnonzero((size_of > 1) & ~keep)
        if len(pick):
            k, c, m, t = key[pick], cid[pick], n[pick], at[pick]
            points = _points(batch.column(4).take(pa.array(pick))) if bounded else None
            for step in range(1, int(size_of[pick].max())):
                i = np.flatnonzero(k[step:] == k[:-step])
                i = i[_may_link(limit, m, t, points, i, i + step)]
                keep[pick[i]] = keep[pick[i + step]] = True
        return batch.take(pa.array(np.flatnonzero(keep))) if keep.any() else None

    def run(batches):
        rest, whole = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            if not bounded:
                place = np.asarray(batch.column(2))
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place >> 32), pa.array(place & 0xFFFFFFFF)], names=["key", "cid", "n", "at"])
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key, cid = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])))
            if not new.all():
                batch = batch.take(pa.array(np.flatnonzero(new)))
                key = key[new]
            cut = int(np.flatnonzero(key == key[-1])[0])
            if len(key) - cut > _LEAF or key[-1] in whole:
                whole.add(int(key[-1]))
                out, rest, whole = some(batch, whole), None, {int(key[-1])}
            else:
                out, rest = (some(batch.slice(0, cut), whole) if cut else None), batch.slice(cut)
            if out is not None:
                yield out
        if rest is not None and (out := some(rest, whole)) is not None:
            yield out

    if bounded:
        return index.select("key", "cid", "n", "at", "point").mapInArrow(run, "key long, cid long, n long, at long, point binary")
    return index.select("key", "cid", "place").mapInArrow(run, "key long, cid long, n long, at long")


def _by_class(rows: DataFrame, least: DataFrame, share: int = 1000) -> DataFrame:
    """Rows with their class's component. Classes with over 1 / ``share`` of the rows
    number fewer than ``share`` and are broadcast; the others are merged by class."""
    total = F.lit(rows.count())
    hot = rows.groupBy("cid").count().filter(F.col("count") * share > total).select("cid")
    # component ids may be null, so a hot class is known by its mark
    hot = least.join(F.broadcast(hot), "cid").withColumn("hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), "cid", "left")
    done = marked.filter("hot").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = marked.filter("hot is null").select("doc_id", "n", "cid").join(least, "cid")
    return done.unionByName(rest.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))
