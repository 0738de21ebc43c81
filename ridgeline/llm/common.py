"""Helpers shared by the operators of this subpackage: shared scratch tables,
vectorised word hashing over Arrow buffers, streaming group iteration and
distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these white-space bytes.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once inside a task; a longer document is its own chunk.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANE_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


# --- scratch tables -------------------------------------------------------


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all machines share.

    Where that setting is absent a local session (tests, benchmarks) gets a
    temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ridgeline-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write df to a shared scratch table and read it back: cuts the lineage, survives lost executors.

    The table's path is added to `paths`, for discard()."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    paths.clear()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row, key): each row of docs as one struct, so that its columns' names can't clash, and a number of its own, both saved."""
    return save(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), name)


def input_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash.

    Operators that go through Python begin here, so the size of Arrow batches,
    64 MB unless the session says otherwise, is brought down to what a worker
    beside a full JVM can hold."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(*[F.col(f"`{n}`") for n in names])


# --- words ------------------------------------------------------------------


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n of the hash base ("up") or of its inverse ("down"), modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) <= n:
        base = np.full(max(n, CHUNK_BYTES + 4096) + 1, _P if kind == "up" else _PINV, dtype=np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """(first, last, bytes, offsets) for runs of documents of about `most` bytes."""
    data, off = text_buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Word boundaries and 64-bit word hashes of a chunk of documents.

    start, end: byte positions of each word; first: index of each document's
    first word, with the total at the end; hash: one uint64 per word. A word
    never spans two documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        self.data = _LOWER[data] if lower and len(data) else data
        word = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begin, finish = word.copy(), word.copy()
        if len(data):
            begin[1:] &= ~word[:-1] | edge[1:-1]
            finish[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes() if hashed else None

    def _hashes(self) -> np.ndarray:
        """The sum of each word's lanes of eight bytes, mixed with their places, mixed with the length: no sum over bytes, which regular words could level out."""
        size = self.end - self.start
        lanes = (size + 7) >> 3
        first = np.cumsum(lanes) - lanes
        owner = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(owner)) - first[owner]
        at = self.start[owner] + 8 * nth
        view = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        lane = view[at] & _LANE_BYTES[np.minimum(self.end[owner] - at, 8)]
        lane = mix(lane + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        total = np.add.reduceat(lane, first) if len(first) else np.zeros(0, np.uint64)
        return mix(total ^ (size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions without k words are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    q = np.uint64(_P)
    for j in range(k):
        out *= q
        out += words[j : j + n]
    return mix(out ^ np.uint64(k))


def long_gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """As gram_hashes, by prefix sums: the cost doesn't depend on k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power("up", len(words)), _power("down", len(words))
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * down[:n] ^ np.uint64(k))


# --- grouped streaming ------------------------------------------------------


def arrow_groups(batches, keys: list[str]):
    """Tables of equal keys from batches sorted by those keys; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


# --- connected components ------------------------------------------------------


#: Edges that one task may settle; more are settled by rounds over the whole table.
FEW_EDGES = 500_000


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each) of edges u, v: hooking to smaller labels and halving paths until nothing changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label[label], label):
            label = label[label]


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over edges (u, v), for each node on an edge.

    Alternates large-star and small-star (Kiveris et al. 2014) until the edges
    are stars; each round is a few aggregations and joins and is written to the
    shared scratch folder. At most FEW_EDGES edges are settled in one task
    instead. Only a count and a checksum reach the driver."""
    spark, old, own = edges.sparkSession, [], []
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = save(e, name, old), None
    if e.count() <= FEW_EDGES:

        def settle(batches):
            held = [b for b in batches if b.num_rows]
            if held:
                t = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots_of(t.column(0).to_numpy(), t.column(1).to_numpy())], names=["node", "root"])

        return e.repartition(1).mapInArrow(settle, "node long, root long")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are tables of their own, so that the joins with them can split a node with very many edges
        low = save(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), name, old)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = save(large, name, old)
        low = save(large.groupBy("u").agg(F.min("v").alias("m")), name, old)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = save(small.where("u <> v").distinct(), name, own)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, old)
        old, own = own, []
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
