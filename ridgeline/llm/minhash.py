"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every document becomes its set of distinct word shingles; equal sets form one
class. The signature's values, read round from the start of each of TREES
trees, give TREES keys of DEPTH values. Keys that share their first LEAST_DEPTH
values with another class are sorted, tree by tree, over range partitions; a
class's neighbours are those beside it, and the length of the common prefix
ranks them. The BEST nearest of each class are compared on full sets.

Depth is adaptive: a region (the keys with one prefix of LEAST_DEPTH values)
whose classes the deep neighbours have all linked to each other is done. One
that still holds several components is widened to its whole breadth: every two of
its classes that lie in different components' reach are compared, the largest
component's classes only with the others. So whatever its size, two classes of
a region are in one component or were compared; no neighbour is left out. Regions
that overlap are compared as one family where that reads fewer rows.

Comparisons run in pairs of blocks, which bound the shingles and rows a task
holds, and a pair emits a spanning forest of its links, never all pairs. A pair
at similarity 0.85 shares no region with probability
(1 - 0.85**LEAST_DEPTH)**TREES, below 1e-5.

Words have 64-bit hashes; equality of sets is by two 64-bit sums of their own.

Defined results: null or empty text has an empty set, is linked with nothing
and is kept; fewer words than a shingle make one shingle of all words; rows
without doc_id are linked like others but name no component; repeated rows and
ties fall into one class; rows of one doc_id with different texts are classes of
their own; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_groups, chunks, components, gram_hashes, input_columns, mix, numbered, save

SHINGLE_WORDS = 5
TREES = 16
LEAST_DEPTH, DEPTH = 4, 16
SIGNATURE = TREES * LEAST_DEPTH
#: Neighbours of each class that are compared before its regions are looked at.
BEST = 2
#: Shingles and rows of a block, about.
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 19, 2048
#: Owners up to which a shingle's pairs are counted one by one.
FEW = 48
_MULTIPLIERS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS):
    """The sorted distinct shingle hashes of each text."""
    for i, j, data, off in chunks(texts):
        w = Words(data, off, lower=True)
        for d in range(j - i):
            words = w.hash[w.first[d] : w.first[d + 1]]
            yield np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def signature(grams: np.ndarray) -> np.ndarray:
    """SIGNATURE minima over the grams, each under its own multiplier."""
    out = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 2048):
        h = grams[at : at + 2048]
        h = (h ^ (h >> np.uint64(29)))[None, :] * _MULTIPLIERS[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _set_key(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for the whole set."""
    a, b = mix(grams), mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int((b * b).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, k1, k2, sig of each document, and its column `row` if given."""
    keys = ["doc_id", "th", row] if row else ["doc_id", "th"]

    def build(batches):
        for b in batches:
            n, k1, k2, sig = [], [], [], []
            for grams in shingle_sets(b.column(0)):
                x, y = _set_key(grams)
                n.append(len(grams)), k1.append(x), k2.append(y)
                sig.append(signature(grams).astype(">u4").tobytes() if len(grams) else b"")
            found = [pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *found], names=[*keys, "n_shingles", "k1", "k2", "sig"])

    texts = input_columns(docs, "text", "doc_id", *keys[2:]).withColumn("th", F.xxhash64("text"))
    return texts.select("text", *keys).mapInArrow(build, ", ".join(f"{k} long" for k in keys) + ", n_shingles long, k1 long, k2 long, sig binary")


# --- neighbours in sorted orders ----------------------------------------------------


def _regions(classes: DataFrame) -> DataFrame:
    """(node, tree, region): one row per class and tree; the region is a hash of the tree's first LEAST_DEPTH values."""
    trees = [F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", 4 * LEAST_DEPTH * t + 1, 4 * LEAST_DEPTH)).alias("region")) for t in range(TREES)]
    return classes.select("node", F.explode(F.array(*trees)).alias("t")).select("node", "t.tree", "t.region")


def neighbours(crowded: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(u, v, lcp): classes beside each other in a tree's sorted order, and the values their keys have in common, LEAST_DEPTH at least."""
    key = F.expr(f"substring(concat(sig, sig), {4 * LEAST_DEPTH} * tree + 1, {4 * DEPTH})")
    rows = crowded.join(classes.select("node", "sig"), "node").select("tree", key.alias("key"), "node")
    ordered = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def compare(batches):
        part, first, last = TaskContext.get().partitionId(), None, None

        def edge(row, end):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row[2], pa.int64()), (None, pa.int64()), (0, pa.int32()), (2 * part + end, pa.int64()), (row[0], pa.int32()), (row[1], pa.binary()))], names=["u", "v", "lcp", "edge", "tree", "key"])

        for b in batches:
            if not b.num_rows:
                continue
            tree, key, node = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            first = first or (tree[0], key[0], node[0])
            if last:
                tree, key, node = [last[0], *tree], [last[1], *key], [last[2], *node]
            last = tree[-1], key[-1], node[-1]
            lcp, near = _common(tree, key), np.asarray(node, dtype=np.int64)
            some = np.flatnonzero(lcp >= LEAST_DEPTH)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(near[some]), pa.array(near[some + 1]), pa.array(lcp[some].astype(np.int32)), none, none.cast(pa.int32()), pa.nulls(len(some), pa.binary())], names=["u", "v", "lcp", "edge", "tree", "key"])
        if last:
            yield edge(first, 0)
            yield edge(last, 1)

    found = save(ordered.mapInArrow(compare, "u long, v long, lcp int, edge long, tree int, key binary"), f"{name}-neighbours")
    # across partitions: two rows for each, in their order
    w = Window.orderBy("edge")
    ends = found.where("edge is not null").select("edge", "u", "tree", "key", F.lead("u").over(w).alias("v"), F.lead("tree").over(w).alias("tree2"), F.lead("key").over(w).alias("key2")).where("edge % 2 = 1 and tree = tree2")
    same = [F.expr(f"substring(key, 1, {4 * d}) = substring(key2, 1, {4 * d})").cast("int") for d in range(1, DEPTH + 1)]
    ends = ends.withColumn("lcp", sum(same[1:], same[0])).where(F.col("lcp") >= LEAST_DEPTH)
    return found.where("edge is null").select("u", "v", "lcp").unionByName(ends.select("u", "v", "lcp"))


def _common(tree: list[int], key: list[bytes]) -> np.ndarray:
    """Equal leading values of each key and the next one; 0 between trees."""
    k = np.frombuffer(b"".join(key), dtype=">u4").reshape(len(key), -1)
    t = np.asarray(tree)
    differ = np.concatenate([k[1:] != k[:-1], np.ones((len(k) - 1, 1), bool)], axis=1)
    return np.where(t[1:] == t[:-1], differ.argmax(axis=1), 0)


def _best(pairs: DataFrame) -> DataFrame:
    """(u, v), u < v: for each class the BEST neighbours by common prefixes, added up over the trees."""
    pairs = pairs.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("lcp").alias("lcp")).where("u < v")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("own"), F.col("v").alias("other")), F.struct(F.col("v").alias("own"), F.col("u").alias("other")))).alias("s"), "lcp")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("lcp"), "other"))  # at most two rows a tree
    top = sides.select("s.own", "s.other", "lcp").withColumn("rank", rank).where(F.col("rank") <= BEST)
    return top.select(F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v")).distinct()


# --- comparisons on full sets ---------------------------------------------------------


def _sets(classes: DataFrame, wanted: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(node, n, grams) of the wanted classes, from the text of one document each."""
    some = classes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("doc"), "th", "k1", "k2")
    texts = input_columns(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    rows = texts.join(some, (texts["th"] == some["th"]) & texts["doc_id"].eqNullSafe(some["doc"])).select("node", "k1", "k2", "text")

    def build(batches):
        for b in batches:
            grams, same, n = [], [], []
            for s, k1, k2 in zip(shingle_sets(b.column(3)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                same.append(_set_key(s) == (k1, k2))
                grams.append(s.tobytes())
                n.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(grams, pa.binary())], names=["node", "n", "grams"]).filter(pa.array(same, pa.bool_()))

    return save(rows.mapInArrow(build, "node long, n long, grams binary"), f"{name}-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    left, right = sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    # a pair whose smaller set is too small can't be linked
    close = (F.lit(den) * F.least(F.length("a"), F.length("b"))) >= (F.lit(num) * F.greatest(F.length("a"), F.length("b")))
    rows = pairs.join(left, "u").join(right, "v").where(close).select("u", "v", "a", "b")

    def build(batches):
        for b in batches:
            fine = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(inter > 0 and den * inter >= num * (len(x) + len(y) - inter))
            yield b.select(["u", "v"]).filter(pa.array(fine, pa.bool_()))

    return rows.mapInArrow(build, "u long, v long")


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets of left with sets of right."""
    n = len(sets)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    held = np.diff(np.append(begin, len(grams)))
    at_left, at_right = np.full(n, -1), np.full(n, -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    inter = np.zeros(len(left) * len(right), dtype=np.int64)
    # shingles of few owners: their pairs, counted together by the number of owners
    for c in range(2, FEW + 1):
        some = begin[held == c]
        step = max(1, (1 << 21) // (c * c))
        for s in range(0, len(some), step):
            who = owner[some[s : s + step, None] + np.arange(c)]
            a, b = at_left[who][:, :, None], at_right[who][:, None, :]
            pair = (a * len(right) + b)[(a >= 0) & (b >= 0)]
            if len(pair) < len(inter) // 8:
                np.add.at(inter, pair, 1)
            else:
                inter += np.bincount(pair, minlength=len(inter))
    # shingles of many owners: columns of a product of matrices
    inter = inter.reshape(len(left), len(right))
    many = np.flatnonzero(held > FEW)
    for s in range(0, len(many), 2048):
        pick = many[s : s + 2048]
        column = np.repeat(np.arange(len(pick)), held[pick])
        who = owner[np.repeat(begin[pick] - (np.cumsum(held[pick]) - held[pick]), held[pick]) + np.arange(held[pick].sum())]
        a, b = np.zeros((len(left), len(pick)), np.float32), np.zeros((len(right), len(pick)), np.float32)
        m = at_left[who] >= 0
        a[at_left[who[m]], column[m]] = 1
        m = at_right[who] >= 0
        b[at_right[who[m]], column[m]] = 1
        inter += np.rint(a @ b.T).astype(np.int64)
    return inter


def _forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs (one of left, one of right) with den * intersection >= num * union."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets], dtype=np.int64)
    inter = _shared_counts(sets, left, right)
    union = size[left][:, None] + size[right][None, :] - inter
    out = []
    for i, j in np.argwhere((den * inter >= num * union) & (inter > 0)):
        x, y = int(left[i]), int(right[j])
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


# --- regions that are still open ---------------------------------------------------------


def _blocks(rows, shingles):
    """Blocks for so many rows and shingles."""
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _groups(members: DataFrame, name: str) -> DataFrame:
    """(node, component, n, group): the sets of classes to be compared with each other, from (node, component, n, region).

    Regions with classes in common are a family; it is one group where that takes fewer rows than its regions apart."""
    hubs = save(members.groupBy("region").agg(F.min("node").alias("hub"), F.count("*").alias("size"), F.sum("n").alias("held")), f"{name}-hubs")
    stars = members.join(hubs, "region").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    family = save(components(stars, f"{name}-families").withColumnRenamed("root", "family"), f"{name}-families")
    nodes = save(members.select("node", "component", "n").distinct().join(family, "node"), f"{name}-members")
    whole = nodes.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("held")).select("family", (F.col("size") * _blocks(F.col("size"), F.col("held"))).alias("whole"))
    apart = hubs.join(family, F.col("hub") == F.col("node")).groupBy("family").agg(F.sum(F.col("size") * _blocks(F.col("size"), F.col("held"))).alias("apart"))
    split = save(whole.join(apart, "family").where("apart < whole").select("family"), f"{name}-split")
    together = nodes.join(split, "family", "left_anti").select("node", "component", "n", F.xxhash64(F.lit("family"), "family").alias("group"))
    pieces = members.join(nodes.join(split, "family", "left_semi").select("node"), "node", "left_semi").select("node", "component", "n", F.col("region").alias("group"))
    return together.unionByName(pieces)


def _wide_links(groups: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Confirmed links (u, v) between the classes of each group, those inside its largest component left out."""
    groups = save(groups, f"{name}-groups")
    parts = groups.groupBy("group", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("held"))
    parts = save(parts, f"{name}-parts")
    sums = parts.groupBy("group").agg(F.max_by("component", F.struct("rows", "component")).alias("major"), F.sum("rows").alias("rows"), F.sum("held").alias("held"), F.max(F.struct("rows", "component", "held")).alias("top"))
    sums = sums.select("group", "major", _blocks(F.col("rows") - F.col("top.rows"), F.col("held") - F.col("top.held")).alias("minors"), _blocks(F.col("top.rows"), F.col("top.held")).alias("majors"))
    rows = groups.join(save(sums, f"{name}-sums"), "group").withColumn("minor", F.col("component") != F.col("major"))
    within = lambda n: F.pmod(F.xxhash64("node"), n)
    rows = rows.withColumn("block", F.when(F.col("minor"), within(F.col("minors"))).otherwise(F.col("minors") + within(F.col("majors"))).cast("int"))
    others = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    rows = rows.select("group", "block", "node", F.explode(others).alias("with")).select("group", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node")
    rows = rows.join(sets.select("node", "grams"), "node").select("group", "lo", "hi", "block", "node", "grams")
    rows = rows.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "node")

    def confirm(batches):
        for (_, lo, hi), t in arrow_groups(batches, ["group", "lo", "hi"]):
            node, grams, block = t.column("node").to_pylist(), t.column("grams").to_pylist(), t.column("block").to_numpy()
            keep = [i for i in range(len(node)) if i == 0 or node[i] != node[i - 1]]
            if len(keep) < 2:
                continue
            node, block = [node[i] for i in keep], block[keep]
            own = [np.frombuffer(grams[i], dtype=np.uint64) for i in keep]
            left, right = (np.flatnonzero(block == lo), np.flatnonzero(block == hi)) if lo != hi else (np.arange(len(node)),) * 2
            links = _forest(own, left, right, num, den) if len(left) and len(right) else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in links], pa.int64()), pa.array([node[y] for _, y in links], pa.int64())], names=["u", "v"])

    return rows.mapInArrow(confirm, "u long, v long")


def _links(classes: DataFrame, docs: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Confirmed links (u, v) between classes (node, doc_id, th, k1, k2, sig), whose components are those of all links within regions."""
    regions = _regions(classes)
    held = regions.groupBy("region").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("region")
    crowded = save(regions.join(save(held, f"{name}-held"), "region"), f"{name}-crowded")
    sets = _sets(classes, crowded, docs, name)
    deep = save(_confirmed(_best(neighbours(crowded, classes, name)), sets, num, den), f"{name}-deep")
    roots = components(deep, f"{name}-deep")
    known = crowded.select("node", "region").join(roots, "node", "left").select("node", "region", F.coalesce("root", "node").alias("component"))
    known = save(known, f"{name}-known")
    still = known.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("region")
    still = save(known.join(save(still, f"{name}-still"), "region").join(sets.select("node", "n").distinct(), "node"), f"{name}-open")
    if still.isEmpty():
        return deep
    return deep.unionByName(save(_wide_links(_groups(still, name), sets, num, den, name), f"{name}-wide"))


# --- operators ---------------------------------------------------------------------------------


def _judged(docs: DataFrame, num: int, den: int, name: str, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, root and `row`, if given, of every document; root is null for empty sets."""
    all_ = save(signatures(docs, row), f"{name}-signatures")
    some = all_.where("n_shingles > 0")
    first = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min_by("th", first).alias("th"), F.min_by("sig", first).alias("sig"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()), f"{name}-classes")
    roots = components(_links(classes, docs, num, den, name), f"{name}-links")
    labelled = save(classes.select("node", "k1", "k2", "doc_id").join(roots, "node", "left").select("k1", "k2", "doc_id", F.coalesce("root", "node").alias("root")), f"{name}-roots")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("classes"))
    # a class alone is its own component
    named = labelled.join(save(least.where("classes > 1"), f"{name}-least"), "root", "left").select("k1", "k2", "root", F.coalesce("least", "doc_id").alias("component"))
    rows = all_.join(named, ["k1", "k2"], "left")
    return rows.select("doc_id", *([row] if row else []), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, name: str = "near") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where den * intersection >= num * union of their sets."""
    rows = _judged(docs, num, den, name)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_each(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """One row, of the smallest doc_id, of each group of rows linked over any chain; rows without words all stay."""
    keyed = numbered(docs, "dedup-rows")
    rows = save(_judged(keyed.select("row.doc_id", "row.text", "key"), num, den, "dedup", "key").where("root is not null"), "dedup-judged")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("first"))
    # a table of its own, so that the join can split a very large group
    gone = rows.join(save(first, "dedup-first"), "root").where(F.col("key") != F.col("first.key")).select("key")
    return keyed.join(gone, "key", "left_anti").select("row.*")
