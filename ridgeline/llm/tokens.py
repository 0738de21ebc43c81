"""Token ids of documents, and their ORC store.

Encoding: a document is cut at single spaces and line feeds, where the
byte-level pattern always starts a new piece, equal pieces of a batch are
encoded once and the ids are gathered by dictionary index. A document with
adjacent, leading or trailing white space is encoded whole.

Store: documents are dealt to ranges of ascending ids, each range is sorted and
encoded in one task, and Spark's ORC writer lays the ids out as run-length coded
integers in stripes with row indexes and a Bloom filter on doc_id. Readers split
files by stripe and prune stripes by doc_id; the start of a document is its
offset in its range plus the sizes of the ranges before.

Defined results: null text is empty; an empty text is the end id alone;
rows without doc_id sort first; repeated rows each get their own ids; an empty
table gives an empty store; extra columns are ignored."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, input_columns, scratch_dir, text_buffers

END_ID = 0
#: Bytes of running text encoded in one call.
SLICE_BYTES = 128 << 10
#: Bytes of units whose ids a process keeps from one call to the next; beyond it starts anew.
KNOWN_BYTES = 16 << 20
VOCABULARY = "byte_bpe_50k.json"

_SPACE = r"\s\v\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Texts that start or end in white space, or have a space or line feed beside more white space, are encoded whole.
ODD = rf"^[{_SPACE}]|[{_SPACE}]\z|[{_SPACE}][ \n]|[ \n][{_SPACE}]"

_coders: dict[str, "Coder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """A byte-level BPE tokenizer that encodes whole Arrow batches."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; the library's own threads would spin beside them
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for piece, i in vocab.items():
            self.width[i] = len(piece)  # one character of the vocabulary stands for one byte
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        self.known, self.known_ids, self.known_at = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.comma, self.stop = (int(self.whole([x])[0][0]) for x in ",.")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units in a row, and the n + 1 offsets: they are encoded as running text, and the ids' widths tell where each begins."""
        lead = pc.if_else(pc.starts_with(units, "\n"), "", " ").cast(pa.large_string())
        units = pc.binary_join_element_wise(lead, units, pa.scalar("", pa.large_string()))
        data, off = text_buffers(units)
        # in slices: an encoding takes some hundred bytes for each token while it lives
        cuts = np.unique(np.searchsorted(off, np.arange(0, len(data) + SLICE_BYTES, SLICE_BYTES)).clip(0, len(off) - 1))
        ids = np.concatenate([self.whole([data[off[x] : off[y]].tobytes().decode()])[0] for x, y in zip(cuts, cuts[1:])])
        return ids, np.concatenate([[0], np.searchsorted(np.cumsum(self.width[ids]), off[1:], side="left") + 1])

    def _known_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end): the places of each distinct unit's ids; units that an earlier call met are not encoded again."""
        if self.known.nbytes > KNOWN_BYTES:
            self.known, self.known_ids, self.known_at = self.known[:0], self.known_ids[:0], self.known_at[:1]
        units = units.cast(pa.large_string())
        new = units.filter(pc.invert(pc.is_in(units, value_set=self.known)))
        if len(new):
            ids, at = self._unit_ids(new)
            self.known_at = np.concatenate([self.known_at, self.known_at[-1] + at[1:]])
            self.known_ids = np.concatenate([self.known_ids, ids])
            self.known = pa.concat_arrays([self.known, new])
        place = pc.index_in(units, value_set=self.known).to_numpy(zero_copy_only=False)
        return self.known_ids, self.known_at[place], self.known_at[place + 1]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the n + 1 offsets. A last comma or full stop after a letter is a unit of its own."""
        n = len(pieces)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        closed = pc.match_substring_regex(pieces, r"\p{L}[.,]$")
        comma = pc.ends_with(pieces, ",").to_numpy(zero_copy_only=False)
        base = pc.if_else(closed, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        closed = closed.to_numpy(zero_copy_only=False)
        table, begin, end = self._known_ids(base.dictionary)
        unit = base.indices.to_numpy(zero_copy_only=False)
        size = (end - begin)[unit]
        total = np.concatenate([[0], np.cumsum(size + closed)])
        ids = np.empty(total[-1], dtype=np.int32)
        body = np.cumsum(size) - size
        ids[np.repeat(total[:-1] - body, size) + np.arange(size.sum())] = table[np.repeat(begin[unit] - body, size) + np.arange(size.sum())]
        ids[total[1:][closed] - 1] = np.where(comma[closed], self.comma, self.stop)
        return ids, total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, each closed by the end id, and the n + 1 offsets."""
        n = len(texts)
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        data = text_buffers(texts)[0].tobytes()
        for mark in self.marks:
            if mark.encode() in data:
                odd = pc.or_(odd, pc.match_substring(texts, mark))
        odd = odd.to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        count = np.diff(first)
        flat = parts.flatten()
        heads = flat.take(pa.array(first[:-1])).to_pylist()
        rest = np.ones(len(flat), dtype=bool)
        rest[first[:-1]] = False
        rest[np.repeat(odd, count)] = False
        coded = flat.filter(pa.array(rest)).dictionary_encode()
        lead = self.whole([texts[k].as_py() if o else h for k, (h, o) in enumerate(zip(heads, odd))])
        table, at = self._pieces(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = np.diff(at)[index]
        total = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.repeat((at[index] - total[:-1]).astype(np.int32), lengths)
        gather += np.arange(total[-1], dtype=np.int32)
        body = table[gather]
        del gather, flat, parts
        bounds = total[np.concatenate([[0], np.cumsum(np.where(odd, 0, count - 1))])]
        end = np.array([END_ID], dtype=np.int32)
        out: list[np.ndarray] = []
        for i in range(n):
            out += [lead[i], body[bounds[i] : bounds[i + 1]], end]
        sizes = np.diff(bounds) + 1 + np.fromiter(map(len, lead), dtype=np.int64, count=n)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(sizes)])


def coder(path: str) -> Coder:
    """The process's own tokenizer for that file, loaded once."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_chunks(texts: pa.Array, path: str, most: int = 4 << 20):
    """(first, last, ids, offsets) for runs of documents of about `most` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for i, j, _, _ in chunks(texts, most):
        yield i, j, *coder(path).encode(texts.slice(i, j - i))


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


# --- the store ------------------------------------------------------------


def write_store(docs: DataFrame, path: str, vocabulary: str, parts: int, stripe_bytes: int = 16 << 20) -> None:
    """Write doc_id, text as token ids into an ORC store at path, in ascending doc_id order."""
    docs = input_columns(docs, "doc_id", "text")
    dealt = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j, ids, off in encode_chunks(b.column(1), vocabulary):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(at + off[:-1]), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                at += int(off[-1])

    writer = dealt.mapInArrow(encode, STORE_SCHEMA).write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", 1000).option("orc.create.index", "true")
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("compression", "snappy").orc(path)


STORE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of a store. Filters on doc_id reach the ORC reader.

    The sizes of ranges come from the two small columns; that table has one row
    per range of the store, so its broadcast doesn't grow with the rows."""
    rows = spark.read.schema(STORE_SCHEMA).orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """Replaces ids by their crc32."""

    def crcs(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            flat, off = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            off = off - off[0]
            crc = [ids_crc32(flat[x:y]) for x, y in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Bytes of the table, as it is stored, that a range of a store stands for.
RANGE_BYTES = 4 << 20


def store_parts(docs: DataFrame) -> int:
    """Ranges by the size that the plan's statistics give; where they know none, the session's partitions."""
    size = int(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, -(-size // RANGE_BYTES)) if size < 1 << 50 else max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def token_store(docs: DataFrame, vocabulary: str, parts: int | None = None) -> DataFrame:
    """Write the store into the shared scratch folder and read it back."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_store(docs, path, vocabulary, parts or store_parts(docs))
    return read_store(spark, path)
