"""Packing documents into sequences of WINDOW tokens, with neighbours found by BM25.

Whole windows of a document need nothing else and are emitted where they are
encoded. What is left of each document, its tail, goes to a shard. A tail's
signature are its tokens that the vocabulary learnt last, its rarest; tails
are dealt to shards in the order of signatures, so that tails with rare tokens
in common meet. A shard holds an inverted index of its tails with BM25 weights
by document counts over the whole corpus;
each seed's window is filled greedily by its unused neighbours in falling
score over all its terms, and a tail that none leads to is a seed again; the
last one is cut to fit and its rest is the next seed. Only the last
sequence of a task is padded.

The index is sharded: neighbours come from the seed's own shard. Document counts
are one row per token of the vocabulary, whatever the corpus.

Defined results: null text is empty, and an empty text is the end id alone;
repeated rows are packed each; rows without doc_id too; an empty table gives no
rows; extra columns are ignored. Sequence ids are unique, not consecutive."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_columns, save
from .tokens import coder, encode_chunks, ids_crc32

WINDOW = 1024
#: Tokens of a shard's tails, and of a task's, about.
SHARD_TOKENS, TASK_TOKENS = 1_000_000, 4_000_000
K1, B = 1.2, 0.75
#: Neighbours of a seed that are ranked at once; when they are used up it is asked again.
MOST = 64
_PIECE, _TAIL, _COUNT = 0, 1, 2
_PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def _width(vocabulary: str) -> str:
    """The type that tails' ids are stored in."""
    return "<u2" if len(coder(vocabulary).width) <= 1 << 16 else "<u4"


def _pieces(docs: DataFrame, vocabulary: str, window: int) -> DataFrame:
    """Three kinds of rows: finished windows, tails with their ids, and document counts by token (doc_id, length)."""

    def build(batches):
        task = TaskContext.get().partitionId() << 34
        seen = None
        done = 0
        for b in batches:
            for i, j, ids, off in encode_chunks(b.column(1), vocabulary):
                if seen is None:
                    seen = np.zeros(len(coder(vocabulary).width), dtype=np.int64)
                    place, upto = np.zeros(len(seen), dtype=np.int32), np.arange(1 << 16, dtype=np.int32)
                keys = b.column(0).slice(i, j - i).to_pylist()
                out: list[list] = [[] for _ in range(8)]
                for doc, x, y in zip(keys, off[:-1].tolist(), off[1:].tolist()):
                    own = ids[x:y]
                    if len(own) > len(upto):
                        upto = np.arange(len(own), dtype=np.int32)
                    place[own] = upto[: len(own)]  # the last place of each id stands for it
                    seen[own[place[own] == upto[: len(own)]]] += 1
                    for at in range(x, y, window):
                        piece = ids[at : min(at + window, y)]
                        full = len(piece) == window
                        if full:
                            row = (_PIECE, doc, at - x, window, ids_crc32(piece), y - x, task + done, None)
                        else:  # a tail has its signature in the place of the sequence
                            row = (_TAIL, doc, at - x, len(piece), None, y - x, _signature(piece), piece.astype(_width(vocabulary)).tobytes())
                        done += full
                        for column, value in zip(out, row):
                            column.append(value)
                yield _rows(out)
        if seen is not None:
            some = np.flatnonzero(seen)
            n = len(some)
            yield _rows([[_COUNT] * n, some.tolist(), [None] * n, seen[some].tolist(), [None] * n, [None] * n, [None] * n, [None] * n])

    names = ["kind", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids"]
    types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    schema = "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary"
    return input_columns(docs, "doc_id", "text").mapInArrow(build, schema)


def _signature(tail: np.ndarray) -> int:
    """The tail's two tokens that the vocabulary learnt last: high ids are rare ones."""
    first = int(tail.max())
    second = int(np.where(tail == first, 0, tail).max())
    return first << 43 | second << 24


class Shard:
    """Tails of one shard and the inverted index over their tokens."""

    def __init__(self, ids: list[np.ndarray], counts: np.ndarray, documents: int):
        self.ids = ids
        n = len(ids)
        terms, owner, tf = [], [], []
        for k, x in enumerate(ids):
            t, c = np.unique(x, return_counts=True)
            terms.append(t), owner.append(np.full(len(t), k)), tf.append(c)
        self.terms = terms
        term, owner, tf = (np.concatenate(v) if n else np.zeros(0, np.int64) for v in (terms, owner, tf))
        order = np.argsort(term, kind="stable")
        term, self.owner, tf = term[order], owner[order], tf[order]
        length = np.array([len(x) for x in ids], dtype=np.float64)
        idf = np.log1p((documents - counts + 0.5) / (counts + 0.5))
        self.idf = idf
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.owner])
        self.at = np.searchsorted(term, np.arange(len(counts) + 1))
        # terms of a quarter of the tails or more are rows of a matrix, at most four times as large as the postings
        held = np.diff(self.at)
        common = np.flatnonzero((held > 0) & (4 * held >= n))
        self.row = np.full(len(counts), -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), n))
        for i, x in enumerate(common.tolist()):
            self.matrix[i, self.owner[self.at[x] : self.at[x + 1]]] = self.weight[self.at[x] : self.at[x + 1]]

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """Unused tails that share a term with the seed, best first, about `most` of them at least; ties by position."""
        t = self.terms[seed]
        row = self.row[t]
        rare = t[row < 0]
        begin = self.at[rare]
        n = self.at[rare + 1] - begin
        post = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(self.owner[post], weights=self.weight[post], minlength=len(self.ids)) + self.matrix[row[row >= 0]].sum(axis=0)
        who = np.flatnonzero(unused & (score > 0))
        if most and len(who) > most:
            who = who[score[who] >= np.partition(score[who], len(who) - most)[len(who) - most]]
        return who[np.argsort(-score[who], kind="stable")]


def pack_shard(ids: list[np.ndarray], counts: np.ndarray, documents: int, window: int = WINDOW, room: int | None = None):
    """Yields sequences, each a list of (tail, from, to); the first one has only `room` left."""
    shard = Shard(ids, counts, documents)
    unused = np.ones(len(ids), dtype=bool)
    rest: tuple[int, int] | None = None
    cursor, room = 0, room or window
    asked, more = -1, False
    while True:
        row: list[tuple[int, int, int]] = []
        queue: list[int] = []
        more = False
        while room:
            seed = not queue
            if rest:
                k, a = rest
                rest = None
            else:
                while queue and not unused[queue[-1]]:
                    queue.pop()
                if not queue and more:  # the seed has more neighbours than were asked for
                    queue = shard.neighbours(asked, unused, MOST)[::-1].tolist()
                    more = len(queue) >= MOST
                if queue:
                    k, seed = queue.pop(), False
                else:
                    seed = True
                    while cursor < len(ids) and not unused[cursor]:
                        cursor += 1
                    if cursor == len(ids):
                        break
                    k = cursor
                a, unused[k] = 0, False
            b = min(len(ids[k]), a + room)
            row.append((k, a, b))
            room -= b - a
            if b < len(ids[k]):
                rest = (k, b)
            if room and seed:
                asked, queue = k, shard.neighbours(k, unused, MOST)[::-1].tolist()
                more = len(queue) >= MOST
        if row:
            yield row
        if room:
            return
        room = window


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows = save(_pieces(docs, vocabulary, window), "packing")
    found = rows.where(F.col("kind") == _COUNT).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()  # one row per token of the vocabulary at most
    counts = np.zeros(len(coder(vocabulary).width), dtype=np.int64)
    for r in found:
        counts[r["doc_id"]] = r["n"]
    documents = int(counts[0]) if len(counts) else 0  # the end id is in every document
    sig = F.col("sequence_id") + F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 24))
    signed = rows.where(F.col("kind") == _TAIL).select("doc_id", "start", "length", "doc_tokens", "ids", sig.alias("sig"))
    tasks = max(1, round((signed.agg(F.sum("length")).first()[0] or 0) / TASK_TOKENS))
    dealt = signed.repartitionByRange(tasks, "sig", "doc_id", "start").sortWithinPartitions("sig", "doc_id", "start")

    def build(batches):
        base, done, fill = (1 << 62) + (TaskContext.get().partitionId() << 34), 0, 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal done, fill
            ids = [np.frombuffer(h[4], dtype=_width(vocabulary)).astype(np.int64) for h in held]
            out: list[tuple] = []
            for row in pack_shard(ids, counts, documents, window, window - fill):
                for k, a, b in row:
                    doc, start, _, total, _ = held[k]
                    out.append((doc, start + a, b - a, ids_crc32(ids[k][a:b]), total, base + done, fill))
                    fill += b - a
                if fill == window:
                    done, fill = done + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for r in zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "start", "length", "doc_tokens", "ids")]):
                held.append(r)
                size += r[2]
                if size >= SHARD_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    packed = dealt.mapInArrow(build, _PIECE_SCHEMA)
    return rows.where(F.col("kind") == _PIECE).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset")).unionByName(packed)
