"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept at positions that their content selects: of each SPAN
consecutive anchors (hashes of ANCHOR words) the smallest marks its position, so
every run of LEAST_WORDS words has one marked position, at the same place in all
of its occurrences. Suffixes whose anchor no other text has can't match and go.

The others carry their words, not hashes of them: the suffix itself and the
words on its left that its runs take in. They are sorted by their words
over range partitions, and the common prefix with the neighbours on both sides,
counted in words, tells how far a match goes to the right: no suffix can have a
longer one with any other. Matches are extended to the left by 0 to SPAN - 1 words
where the right side leaves enough; an extended match is a run of LEAST_WORDS
words, known by a 128-bit BLAKE2b digest of its words. Runs that another text has
are joined to maximal spans.

Equal texts (two 64-bit hashes) are taken together first: all but the first
copy are spans from their first word to the last one.

Words longer than LONG_WORD bytes stand in the array by their digests.

Defined results: null, empty or shorter texts have no span; a passage that
repeats in one text alone is none; rows without doc_id come after all others;
rows of one doc_id with different texts are documents of their own; repeated rows
of one doc_id and text are one; ties between first documents go to either;
an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Words, chunks, input_columns, long_gram_hashes, save

LEAST_WORDS = 50
ANCHOR = 20
#: Anchors in a window; a passage of LEAST_WORDS words has this many.
SPAN = LEAST_WORDS - ANCHOR + 1
LONG_WORD = 64
#: Stands for no doc_id in the order of documents.
_LAST = (1 << 63) - 1


def marked(anchors: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, least, most): positions of the smallest anchor (the last of equal ones) of some window of `span`, and how far before them their windows begin."""
    n = len(anchors)
    if n < span:
        return (np.zeros(0, dtype=np.int64),) * 3
    # running minima over 2**k values; a window is the minimum of two of them
    place = np.arange(n)
    low, reach = anchors, 1
    while 2 * reach <= span:
        a, b = low[: n - 2 * reach + 1], low[reach : n - reach + 1]
        right = b <= a
        low, place = np.where(right, b, a), np.where(right, place[reach : n - reach + 1], place[: n - 2 * reach + 1])
        reach *= 2
    m = n - span + 1
    a, b = low[:m], low[span - reach : span - reach + m]
    chosen = np.where(b <= a, place[span - reach : span - reach + m], place[:m])
    # the choices of consecutive windows never go back
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:], m) - 1
    pos = chosen[first]
    return pos, pos - last, pos - first


def suffix_positions(texts: DataFrame) -> DataFrame:
    """(doc, t, pos, least, most, anchor) of the kept suffixes of (doc, t, text)."""

    def build(batches):
        for b in batches:
            doc, t = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j, data, off in chunks(b.column(2)):
                w = Words(data, off)
                found = []
                for d in range(j - i):
                    anchors = long_gram_hashes(w.hash[w.first[d] : w.first[d + 1]], ANCHOR)
                    pos, least, most = marked(anchors)
                    found.append((np.full(len(pos), i + d), pos, least, most, anchors[pos]))
                at, pos, least, most, anchor = (np.concatenate(x) for x in zip(*found))
                small = [pa.array(x.astype(np.int32)) for x in (pos, least, most)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(t[at]), *small, pa.array(anchor.astype(np.uint64).view(np.int64))], names=["doc", "t", "pos", "least", "most", "anchor"])

    return texts.mapInArrow(build, "doc long, t long, pos int, least int, most int, anchor long")


def plain_words(w: Words) -> tuple[bytes, np.ndarray]:
    """The words of a chunk, each closed by one space, and the places where they begin, with the end; long ones by their digests."""
    size = w.end - w.start
    long = np.flatnonzero(size > LONG_WORD)
    names = {k: b"\0" + hashlib.blake2b(w.data[w.start[k] : w.end[k]].tobytes(), digest_size=24).hexdigest().encode() for k in long.tolist()}
    if names:
        size = size.copy()
        size[long] = [len(names[k]) for k in long.tolist()]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 32, dtype=np.uint8)
    fine = np.ones(len(size), dtype=bool)
    fine[long] = False
    n = size[fine]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(at[:-1][fine], n) + within] = w.data[np.repeat(w.start[fine], n) + within]
    for k, name in names.items():
        out[at[k] : at[k] + len(name)] = np.frombuffer(name, dtype=np.uint8)
    return out.tobytes(), at


def _contexts(texts: DataFrame) -> DataFrame:
    """(doc, t, pos, least, most, before, suffix): the words that the runs around each position of (doc, t, text, places) take in."""

    def build(batches):
        for b in batches:
            for i, j, data, off in chunks(b.column(2)):
                w = Words(data, off, hashed=False)
                words, at = plain_words(w)
                for d in range(i, j):
                    v = b.column(3)[d].values
                    pos, least, most = (v.field(n).to_numpy(zero_copy_only=False) for n in ("pos", "least", "most"))
                    p = pos + w.first[d - i]
                    x, y, z = at[p - most].tolist(), at[p].tolist(), at[p - least + LEAST_WORDS].tolist()
                    n = len(pos)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0)[d].as_py()] * n, pa.int64()), pa.array([b.column(1)[d].as_py()] * n, pa.int64()), *[pa.array(k, pa.int32()) for k in (pos, least, most)], pa.array([words[k:m] for k, m in zip(x, y)], pa.binary()), pa.array([words[k:m] for k, m in zip(y, z)], pa.binary())],
                        names=["doc", "t", "pos", "least", "most", "before", "suffix"],
                    )

    def joined(batches):
        held, size = [], 0
        for b in build(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return texts.mapInArrow(joined, "doc long, t long, pos int, least int, most int, before binary, suffix binary")


def common_words(suffixes: list[bytes]) -> np.ndarray:
    """Whole words that each suffix has in common with the next one from the start on."""
    if len(suffixes) < 2:
        return np.zeros(0, dtype=np.int64)
    out = []
    for s in range(0, len(suffixes) - 1, 2000):
        part = suffixes[s : s + 2001]
        width = max(map(len, part))
        rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), dtype=np.uint8).reshape(len(part), width)
        same = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1)
        out.append((same & (rows[1:] == 32)).sum(axis=1))
    return np.concatenate(out)


def _runs(contexts: DataFrame) -> DataFrame:
    """(doc, t, start, k1, k2): runs of LEAST_WORDS words around the suffixes, as far as the neighbours in sorted order let them match."""
    ordered = contexts.repartitionByRange("suffix", "doc", "t", "pos").sortWithinPartitions("suffix", "doc", "t", "pos")

    def emit(rows: list[tuple], right: np.ndarray):
        doc, t, start, keys = [], [], [], []
        for (d, u, pos, least, most, before, suffix), r in zip(rows, right.tolist()):
            low = max(least, LEAST_WORDS - r)
            if low > most:
                continue
            words = before + suffix
            at = [0, *(np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32) + 1).tolist()]
            for a in range(low, most + 1):
                keys.append(hashlib.blake2b(words[at[most - a] : at[most - a + LEAST_WORDS]], digest_size=16).digest())
            n = most + 1 - low
            doc += [d] * n
            t += [u] * n
            start += range(pos - low, pos - most - 1, -1)
        k = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(t, pa.int64()), pa.array(start, pa.int32()), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["doc", "t", "start", "k1", "k2"])

    def build(batches):
        # the ends of a partition have a neighbour in another one: taken to match
        held, known = None, LEAST_WORDS
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            if not rows:
                continue
            rows = rows if held is None else [held, *rows]
            lcp = common_words([r[6] for r in rows])
            sides = np.concatenate([[known], lcp])
            if len(lcp):
                yield emit(rows[:-1], np.maximum(sides[:-1], sides[1:]))
            held, known = rows[-1], int(sides[-1])
        if held is not None:
            yield emit([held], np.array([LEAST_WORDS]))

    return ordered.mapInArrow(build, "doc long, t long, start int, k1 long, k2 long")


def _islands(rows: DataFrame) -> DataFrame:
    """Spans of words (doc, t, start_word, end_word, removed) from the repeated runs (doc, t, ats) of each text."""

    def build(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, t, group in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                v = group.values
                start, again = v.field("start").to_numpy(zero_copy_only=False), v.field("again").to_numpy(zero_copy_only=False)
                for removed in (False, True):
                    s = np.sort(start[again == removed])
                    if not len(s):
                        continue
                    cut = np.flatnonzero(s[1:] > s[:-1] + LEAST_WORDS)
                    first, last = s[np.concatenate([[0], cut + 1])], s[np.concatenate([cut, [len(s) - 1]])]
                    out += [(doc, t, x, y + LEAST_WORDS, removed) for x, y in zip(first.tolist(), last.tolist())]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.bool_())], names=["doc", "t", "start_word", "end_word", "removed"])

    return rows.mapInArrow(build, "doc long, t long, start_word long, end_word long, removed boolean")


def _keys() -> list:
    """doc, the place of a row in the order of documents, and t, which tells its text."""
    return [F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("t")]


def _spans(docs: DataFrame, name: str) -> DataFrame:
    """(doc, t, start_word, end_word, removed) of docs (doc_id, text)."""
    texts = input_columns(docs, "doc_id", "text").where(F.length("text") >= 2 * LEAST_WORDS - 1).select(*_keys(), F.xxhash64(F.lit(1), "text").alias("h"), "text")
    copies = texts.groupBy("t", "h").agg(F.min("doc").alias("rep"), F.max("doc").alias("other")).where("rep < other").select("t", "h", "rep")
    copies = save(copies, f"{name}-copies")
    whole = texts.join(copies, ["t", "h"]).select("doc", "t", F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("end_word"), (F.col("doc") > F.col("rep")).alias("removed"))
    whole = save(whole.where(F.col("end_word") >= LEAST_WORDS).distinct(), f"{name}-whole").select("doc", "t", F.lit(0).cast("long").alias("start_word"), "end_word", "removed")
    single = texts.join(copies, ["t", "h"], "left").where("rep is null or doc = rep").select("doc", "t", "text")
    suffixes = save(suffix_positions(single), f"{name}-suffixes")
    again = save(suffixes.groupBy("anchor").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b").select("anchor"), f"{name}-anchors")
    kept = save(suffixes.join(again, "anchor", "left_semi").select("doc", "t", "pos", "least", "most"), f"{name}-kept")
    places = kept.groupBy("doc", "t").agg(F.collect_list(F.struct("pos", "least", "most")).alias("places"))
    contexts = save(_contexts(single.join(places, ["doc", "t"]).select("doc", "t", "text", "places")), f"{name}-contexts")
    runs = save(_runs(contexts), f"{name}-runs")
    shared = runs.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.min_by("t", "doc").alias("first_t"), F.min("t").alias("a"), F.max("t").alias("b")).where("a < b").drop("a", "b")
    # tables of their own, so that the joins can split an anchor or a run that very many texts share
    shared = save(shared, f"{name}-shared")
    later = (F.col("doc") != F.col("first")) | (F.col("t") != F.col("first_t"))
    both = runs.join(shared, ["k1", "k2"]).select("doc", "t", F.struct("start", later.alias("again")).alias("at"))
    spans = save(_islands(both.groupBy("doc", "t").agg(F.collect_list("at").alias("ats"))), f"{name}-spans")
    inside = spans.where("not removed").join(whole.select("doc", "t"), ["doc", "t"], "left_anti")
    return whole.unionByName(spans.where("removed")).unionByName(inside)


def repeated_spans(docs: DataFrame, name: str = "suffix") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), removed: the maximal spans of words that another document has too.

    removed is false in the first document (smallest doc_id) that has a run of
    words; a document can have spans of both kinds."""
    return _spans(docs, name).select(F.nullif("doc", F.lit(_LAST)).alias("doc_id"), "start_word", "end_word", "removed")


def cut_words(text: str, cuts: list[tuple[int, int]]) -> tuple[str, bool]:
    """The text without the words of each cut (from, to), and whether words are left."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    w = Words(data, np.array([0, len(data)]), hashed=False)
    keep, some = np.ones(len(data), dtype=bool), np.ones(len(w.start), dtype=bool)
    for x, y in cuts:
        keep[w.start[x] : w.end[y - 1]] = False
        some[x:y] = False
    return data[keep].tobytes().decode(), bool(some.any())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every passage kept in its first document only; documents left without words go, and n_chars follows the text."""
    cuts = _spans(docs, "repeats").where("removed").groupBy("doc", "t").agg(F.collect_list(F.struct("start_word", "end_word")).alias("cuts"))
    names = docs.columns
    # numbers for names, so that columns can't clash
    rows = docs.select(*[F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(names)], *_keys())
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    rows = rows.join(cuts, ["doc", "t"], "left").select(*[f"`{k}`" for k in range(len(names))], "cuts")
    kept = rows.drop("cuts")

    def cut(batches):
        for b in batches:
            places = b.column(len(names))
            columns, fine = list(b.columns[:-1]), np.ones(b.num_rows, dtype=bool)
            changed = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if changed:
                texts, sizes = columns[text].to_pylist(), columns[chars].to_pylist() if chars is not None else None
                for k in changed:
                    texts[k], fine[k] = cut_words(texts[k], [(p["start_word"], p["end_word"]) for p in places[k].as_py()])
                    if sizes:
                        sizes[k] = len(texts[k])
                columns[text] = pa.array(texts, columns[text].type)
                if sizes:
                    columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(pa.array(fine))

    return rows.mapInArrow(cut, kept.schema).toDF(*names)
