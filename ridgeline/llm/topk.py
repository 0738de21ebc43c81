"""Exact top-k by inner product, by three phases with a uniform threshold.

A vector's dimensions are cut into LISTS groups; each group is one score list of
partial products. Phase 1 opens the first list alone: each block of candidates gives,
for each query, its best entries of that list, and scores only those exactly. The
k-th best exact score of a query over all blocks is a safe cutoff t. Phase 2 sends t to
every block, which opens its lists one after another: an entry stays in as long as its
known partials, with the most that the lists not yet opened can add (by Cauchy and
Schwarz the product of the norms), reach t. A block whose greatest norms can't
reach t for a query is not opened for it. Phase 3 resolves the few entries left
exactly and ranks them. While many entries are in, lists are opened for all of a block's
entries at once, as many as the block before needed; then for those left alone. Bounds are
floats and lower the cutoff by all that rounding can amount to; scores are integers.

Equal vectors have equal scores and are one: as a candidate with its k + 1 smallest ids,
among which are the k best for any query, and as a query for all ids that ask with it. A
query vector gets its k + 1 best ids, its own among them, which each query then leaves out.
Vectors are dealt to blocks by their hash. A group of candidate blocks is held by one task,
which takes the queries' blocks one by one behind it, and raises t by what it finds; no
vector is broadcast. What is shuffled is the vectors once, to find the different ones, then
the candidates once and the queries once per group, in the narrowest integers that hold
them; a group has at most GROUP blocks and GROUP_COMPONENTS components.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without vec_id; missing trailing components
count as 0; ties go to the smaller vec_id; rows of one vec_id are one query and
one candidate, whose score is the best over their vectors; an empty table gives no
rows; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_groups, input_columns, save

LISTS = 8
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096
#: Components of a block; wide vectors make blocks of fewer rows.
BLOCK_COMPONENTS = 1 << 20
#: Most blocks and components of a group of candidates, which one task holds; small tables are cut into GROUPS groups at least.
GROUP, GROUP_COMPONENTS, GROUPS = 64, 1 << 24, 48
#: Rows of queries scored at once, at most.
ROWS_AT_ONCE = 512
#: Share of the entries still in from which on a list is evaluated for all of them.
DENSE = 0.02
#: Columns of which phase 1 looks at the best one alone.
TILE = 64
#: Entries of phase 1 that are ranked at once.
MERGED = 1 << 15
_NONE = -(1 << 62)


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id and floor(factor * component) of the vectors that take part."""
    rows = input_columns(vectors, "vec_id", "embedding").where("vec_id is not null and size(embedding) > 0")
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(factor)).cast("long"))
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.coalesce(usable, F.lit(False))).select("vec_id", x.alias("v"))


def _blocks(vectors: DataFrame, count: int, name: str) -> DataFrame:
    """(block, width, bytes, counts, ids, values) of vectors (h, v, ids) in `count` blocks, as binaries: ids of each vector, all ids, integers of so many bytes."""
    dealt = vectors.select("ids", "v", F.pmod("h", F.lit(count)).cast("long").alias("block")).repartition("block").sortWithinPartitions("block")

    def build(batches):
        for (block,), t in arrow_groups(batches, ["block"]):
            ids, rows = t.column("ids").combine_chunks(), t.column("v").combine_chunks()
            off = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            sizes, flat = np.diff(off), rows.flatten().to_numpy()
            kind = next(d for d in ("<i2", "<i4", "<i8") if np.iinfo(d).min <= flat.min() and flat.max() <= np.iinfo(d).max)
            m = np.zeros((len(ids), int(sizes.max())), dtype=kind)
            m[np.repeat(np.arange(len(ids)), sizes), np.arange(off[-1]) - np.repeat(off[:-1], sizes)] = flat
            binaries = np.diff(ids.offsets.to_numpy()).astype("<i4"), ids.flatten().to_numpy().astype("<i8"), m
            columns = [pa.array([block]), pa.array([m.shape[1]], pa.int32()), pa.array([m.itemsize], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in binaries)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "width", "bytes", "counts", "ids", "values"])

    return save(dealt.mapInArrow(build, "block long, width int, bytes int, counts binary, ids binary, values binary"), name)


class Block:
    """Vectors, their norms from each list on, and their ids; vector i has those from off[i] to off[i + 1]."""

    def __init__(self, m: np.ndarray, ids: np.ndarray, edges: np.ndarray, counts: np.ndarray | None = None):
        self.m, self.ids, self.edges = m, ids, edges
        self.off = np.concatenate([[0], np.cumsum(counts)]) if counts is not None else np.arange(len(m) + 1)
        self.rest = np.sqrt([(m[:, x:].astype(np.float64) ** 2).sum(axis=1) for x in edges]) * (1 + 1e-9) + 1e-6
        self._wide: tuple = ()

    def rows(self, x: int, y: int) -> Block:
        """Vectors x to y, sharing what is known of them."""
        part = object.__new__(Block)
        part.m, part.ids, part.off, part.edges, part.rest, part._wide = self.m[x:y], self.ids, self.off[x : y + 1], self.edges, self.rest[:, x:y], ()
        return part

    def named(self, rows: np.ndarray, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of vectors `at` as entries of their ids."""
        n = self.off[at + 1] - self.off[at]
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(rows, n), self.ids[np.repeat(self.off[at], n) + i], np.repeat(score, n)

    def opened(self, lists: int, kind: type) -> np.ndarray:
        """The first lists and, last, the norm of what is left."""
        if not self._wide or self._wide[0] != (lists, kind):
            self._wide = (lists, kind), np.hstack([self.m[:, : self.edges[lists]].astype(kind), self.rest[lists][:, None].astype(kind)])
        return self._wide[1]


def _kind(q: Block, c: Block) -> tuple[type, float]:
    """Floats for bounds of q's and c's products, and more than rounding can change them by."""
    most = float(q.rest[0].max(initial=0)) * float(c.rest[0].max(initial=0))
    kind = np.float32 if most < 2.0**24 else np.float64
    return kind, (q.m.shape[1] + 16) * float(np.finfo(kind).eps) * most


def _exact(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", q[rows[s : s + 65536]].astype(np.int64), c[cols[s : s + 65536]].astype(np.int64)) for s in range(0, len(rows), 65536)] or [np.zeros(0, np.int64)])


def _first_list(q: Block, c: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best entries by the first list, looked for among the best of every TILE columns."""
    kind, _ = _kind(q, c)
    first = q.opened(1, kind)[:, :-1] @ c.opened(1, kind)[:, :-1].T
    n, tile = first.shape[1], max(1, min(TILE, first.shape[1] // (4 * k)))
    cut = np.full((len(first), -(-n // tile) * tile), -np.inf, kind) if n % tile else first
    cut[:, :n] = first
    cut = cut.reshape(len(first), tile, -1)  # a tile's columns lie apart, so that maxima are taken over whole rows
    best = cut.max(axis=1)
    tiles = np.argpartition(best, -k, axis=1)[:, -k:] if best.shape[1] > k else np.broadcast_to(np.arange(best.shape[1]), best.shape)
    rows = np.repeat(np.arange(len(first)), tiles.shape[1])
    found = cut[rows, :, tiles.ravel()]
    cols = found.argmax(axis=1) * best.shape[1] + tiles.ravel()
    fine = found.max(axis=1) > -np.inf
    return rows[fine], cols[fine]


def _reach(q: Block, c: Block, limits: np.ndarray, other: np.ndarray | None, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """As survivors; opens `lists` lists at once to begin with, and returns how many to begin with next time."""
    none = np.zeros(0, np.int64)
    limits = limits.astype(np.float64)
    rows = np.flatnonzero(q.rest[0] * c.rest[0].max(initial=0) >= limits)
    if not len(rows) or not len(c.m):
        return none, none, none, 0, lists
    (kind, slack), own, last = _kind(q, c), rows, len(q.edges) - 1
    limits = limits - slack - np.abs(limits) * 1e-6 - 1
    while True:
        wide = q.opened(lists, kind)
        bound = (wide if len(own) == len(wide) else wide[own]) @ c.opened(lists, kind).T
        alive = bound >= limits[own, None].astype(kind)
        if other is not None:
            alive &= other[own]
        share = np.count_nonzero(alive) / alive.size
        if share < DENSE or lists == last:
            break
        lists += 1
    # the place of each entry in one row is found faster than two coordinates
    at = np.flatnonzero(alive)
    rows, cols = own[at // len(c.m)], at % len(c.m)
    bound = bound.ravel()[at].astype(np.float64)
    for j in range(lists, last):
        x, y = q.edges[j : j + 2]
        bound += _exact(q.m[:, x:y], c.m[:, x:y], rows, cols) - q.rest[j][rows] * c.rest[j][cols] + q.rest[j + 1][rows] * c.rest[j + 1][cols]
        fine = bound >= limits[rows]
        rows, cols, bound = rows[fine], cols[fine], bound[fine]
    return rows, cols, _exact(q.m, c.m, rows, cols), len(rows), lists - (lists > 1 and share < DENSE / 8)


def survivors(q: np.ndarray, c: np.ndarray, limits: np.ndarray, other: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows, columns, exact scores) of the entries that reach their row's limit, and how many entries had all their lists opened."""
    rows, cols, score, opened, _ = _reach(Block(q, np.arange(len(q)), edges), Block(c, np.arange(len(c)), edges), limits, other, 1)
    fine = score >= limits[rows]
    return rows[fine], cols[fine], score[fine], opened


def _top(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best ids of each row, each id once; ties to the smaller id."""
    order = np.lexsort((-score, ids, rows))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (rows[order][1:] != rows[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    best = order[first]
    order = best[np.lexsort((ids[best], -score[best], rows[best]))]
    begin = np.searchsorted(rows[order], rows[order], side="left")
    return order[np.arange(len(order)) - begin < k]


def _score(rows: DataFrame, width: int, k: int, cutoff: bool) -> DataFrame:
    """Entries (key, vec_id, score) of each group of candidate blocks with all queries behind it: phase 1, or phases 2 and 3 with the cutoffs."""
    edges = np.linspace(0, width, LISTS + 1).astype(int)

    def build(batches):
        held: list[Block] = []
        group, lists = None, 1

        def score(q: Block, keys: np.ndarray, limits: np.ndarray):
            nonlocal lists
            found = [np.zeros(0, np.int64)] * 3
            for c in held:
                if not cutoff:
                    rows, cols = _first_list(q, c, k)
                    points = _exact(q.m, c.m, rows, cols)
                else:
                    rows, cols, points, _, lists = _reach(q, c, limits, None, lists)
                    fine = points >= limits[rows]
                    rows, cols, points = rows[fine], cols[fine], points[fine]
                if not len(rows):
                    continue
                found = [np.concatenate(x) for x in zip(found, c.named(rows, cols, points))]
                if not cutoff and len(found[0]) < MERGED and c is not held[-1]:
                    continue
                keep = _top(*found, k)
                found = [x[keep] for x in found]
                if cutoff:
                    full = np.flatnonzero(np.bincount(found[0], minlength=len(keys)) == k)
                    limits = limits.copy()
                    limits[full] = np.maximum(limits[full], found[2][np.searchsorted(found[0], full, "right") - 1])
            return pa.RecordBatch.from_arrays([pa.array(keys[found[0]]), pa.array(found[1]), pa.array(found[2])], names=["key", "vec_id", "score"])

        for b in batches:
            col = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            for at in range(b.num_rows):
                get = lambda n: col[n][at].as_py()
                if get("group") != group:
                    group = get("group")
                    held.clear()
                counts, ids = np.frombuffer(get("counts"), dtype="<i4"), np.frombuffer(get("ids"), dtype="<i8")
                m = np.frombuffer(get("values"), dtype=f"<i{get('bytes')}").reshape(len(counts), get("width"))
                block = Block(np.pad(m, ((0, 0), (0, width - m.shape[1]))), ids, edges, counts)
                if get("kind") == 0:
                    held.append(block)
                    continue
                limits = np.frombuffer(get("limits"), dtype="<i8") if cutoff else np.full(len(ids), _NONE)
                for x in range(0, len(ids), ROWS_AT_ONCE):
                    y = min(len(ids), x + ROWS_AT_ONCE)
                    yield score(block.rows(x, y), ids[x:y], limits[x:y])

    return rows.mapInArrow(build, "key long, vec_id long, score long")


def _with_limits(queries: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds each block's cutoffs, in the order of its keys; a query with too few entries has none to fall short of."""
    ids = queries.select("block", "ids")

    def unpack(batches):
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = np.frombuffer(raw, dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block)), pa.array(np.arange(len(i))), pa.array(i)], names=["block", "at", "key"])

    rows = ids.mapInArrow(unpack, "block long, at long, key long").join(limits, "key", "left")
    per_block = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("t", F.lit(_NONE)).alias("t")))).alias("ts"))

    def pack(batches):
        for b in batches:
            packed = [np.array([x["t"] for x in ts], dtype="<i8").tobytes() for ts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["block", "limits"])

    return queries.join(per_block.mapInArrow(pack, "block long, limits binary"), "block")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, the rows whose vec_id is divisible by `every`."""
    rows = scaled(vectors).withColumn("h", F.xxhash64("v"))
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    least = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    different = save(rows.withColumn("nth", least).where(F.col("nth") <= k + 1).groupBy("h", "v").agg(F.collect_set("vec_id").alias("ids")), "topk-vectors")
    asked = save(asking.select("h", "v").distinct().select("h", "v", F.monotonically_increasing_id().alias("key")), "topk-asked")
    n, width = different.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    most = max(1, BLOCK_COMPONENTS // width)
    blocks = lambda n, size: max(1, -(-n // min(size, most)))
    count = blocks(n, CANDIDATE_BLOCK)
    candidates = _blocks(different, count, "topk-candidates")
    queries = _blocks(asked.select("h", "v", F.array("key").alias("ids")), blocks(asked.count(), QUERY_BLOCK), "topk-queries")
    per_group = max(1, min(GROUP, GROUP_COMPONENTS // (width * min(CANDIDATE_BLOCK, most)), count // GROUPS))
    groups = -(-count // per_group)

    def scored(queries: DataFrame, cutoff: bool) -> DataFrame:
        """Entries of the groups of candidates, each with the queries' blocks behind it."""
        limits = F.col("limits") if cutoff else F.lit(None).cast("binary")
        common = ["block", "width", "bytes", "counts", "ids", "values"]
        c = candidates.select(F.floor(F.col("block") / per_group).alias("group"), F.lit(0).alias("kind"), *common, F.lit(None).cast("binary").alias("limits"))
        q = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(1).alias("kind"), *common, limits.alias("limits"))
        return _score(c.unionByName(q).repartition(groups, "group").sortWithinPartitions("group", "kind", "block"), width, k + 1, cutoff)

    def ranked(found: DataFrame, by: str, k: int) -> DataFrame:
        found = found.repartition(by).groupBy(by, "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    first = ranked(scored(queries, False), "key", k + 1)
    limits = save(first.where(F.col("rank") == k + 1).select("key", F.col("score").alias("t")), "topk-limits")
    best = ranked(scored(save(_with_limits(queries, limits), "topk-limited"), True), "key", k + 1).drop("rank")
    names = asking.join(asked, ["h", "v"]).select(F.col("vec_id").alias("query_id"), "key").distinct()
    found = names.join(best, "key").where("vec_id <> query_id").select("query_id", "vec_id", "score")
    return ranked(found, "query_id", k).select("query_id", "rank", "vec_id", "score")
