"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a step are a word's own vector and the mean vector of its character
n-grams, from vocabularies of the training rows; unknown ones are zero. Both
directions read a window of WINDOW words, attention pools their states into the
window's logit. Every text is cut into windows that overlap by half, all are
scored, and a document's score is that of its highest window, through a
logistic fit on the training rows.

Training takes at most TRAIN_ROWS labelled rows of each label, of at most
TRAIN_CHARS characters, picked by hash, and never rows of the held-out fold. A
label marks a document, not a window: in each round the highest windows of toxic
rows are the positives, the highest and some other windows of clean rows the
negatives. The first column of the vectors starts from log odds of document
counts, which chooses the windows of the first round.

Words are runs of ASCII letters, digits and bytes from 0x80 on, lower-cased in A-Z.

Defined results: null text and text without words score as one empty window;
rows without doc_id or label train nothing; without both labels every score is
0; repeated rows score alike; an empty table gives no rows; extra columns are
ignored."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Words, chunks, input_columns

TRAIN_ROWS, TRAIN_CHARS = 2000, 20_000
FOLDS, HELD_OUT = 5, 0
WINDOW, STRIDE = 24, 12
VECTOR, HIDDEN, ATTENTION = 6, 8, 8
GRAM_BYTES = (4, 6)
MOST_WORDS, MOST_GRAMS = 40_000, 80_000
ROUNDS, BATCH, RATE = 6, 256, 0.02
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Letters(Words):
    """Runs of letters and digits instead of runs of non-space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data] if len(data) else data
        super().__init__(np.where(_LETTER[low], low, np.uint8(32)) if len(low) else low, offsets)


def unique_words(w: Words):
    """(hashes of the distinct words, index of each word in them, gram hashes, owner of each gram)."""
    hashes, first, index = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first]
    grams, owner = [], []
    for k in GRAM_BYTES:
        some = np.flatnonzero(size >= k)
        n = size[some] - k + 1
        who = np.repeat(some, n)
        at = np.repeat(start[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        h = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + w.data[at + j].astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        # the same gram at a word's start is one more feature
        lead = at == start[who]
        grams += [h, h[lead] ^ np.uint64(0xABCDEF)]
        owner += [who, who[lead]]
    return hashes, index, np.concatenate(grams), np.concatenate(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Parameters, forward and backward pass."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.words, self.grams = words, grams
        normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"word": normal(len(words) + 1, VECTOR), "gram": normal(len(grams) + 1, VECTOR), "w1": normal(2 * HIDDEN, ATTENTION), "v1": normal(ATTENTION), "out": normal(2 * HIDDEN), "bias": np.float32([-1.0])}
        self.p["word"][:, 0], self.p["gram"][:, 0] = np.append(word_odds, 0), np.append(gram_odds, 0)
        self.p["word"][-1] = self.p["gram"][-1] = 0
        for d in "fb":
            self.p[f"in{d}"], self.p[f"rec{d}"], self.p[f"b{d}"] = normal(2 * VECTOR, 3 * HIDDEN) * 3, normal(HIDDEN, 3 * HIDDEN) * 3, np.zeros(3 * HIDDEN, np.float32)
        self.slope, self.shift = 1.0, 0.0
        self.empty = True

    def lookup(self, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(keys), 0)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, len(table))

    def features(self, hashes: np.ndarray, grams: np.ndarray, owner: np.ndarray):
        """Rows of the distinct words' vectors, and of their known grams with their owners."""
        row = self.lookup(grams, self.grams)
        known = row < len(self.grams)
        return self.lookup(hashes, self.words), row[known], owner[known]

    def vectors(self, words: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
        x = np.zeros((len(words) + 1, 2 * VECTOR), dtype=np.float32)  # the last row pads windows
        x[:-1, :VECTOR] = self.p["word"][words]
        n = np.bincount(owner, minlength=len(words)).astype(np.float32)
        for j in range(VECTOR):
            x[:-1, VECTOR + j] = np.bincount(owner, weights=self.p["gram"][grams, j], minlength=len(words)) / np.maximum(n, 1)
        return x

    def _direction(self, gates: np.ndarray, d: str, keep: bool):
        steps, n, _ = gates.shape
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        states, saved = np.empty((steps, n, HIDDEN), dtype=np.float32), []
        rec = self.p[f"rec{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            r = h @ rec
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
            cand = np.tanh(gates[t, :, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
            if keep:
                saved.append((t, h, z, reset, cand, r[:, 2 * HIDDEN :]))
            h = cand + z * (h - cand)
            states[t] = h
        return states, saved

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows (n, WINDOW) of rows of x."""
        index = windows.T
        out, saved = [], {}
        for d in "fb":
            gates = (x @ self.p[f"in{d}"] + self.p[f"b{d}"])[index]
            states, saved[d] = self._direction(gates, d, keep)
            out.append(states)
        h = np.concatenate(out, axis=2)
        u = np.tanh(h @ self.p["w1"])
        e = u @ self.p["v1"]
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, h)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (h, u, a, pooled, saved)) if keep else logit

    def backward(self, x: np.ndarray, windows: np.ndarray, cache, grad: np.ndarray):
        """Gradients of all parameters but the vectors, and that of x."""
        h, u, a, pooled, saved = cache
        g = {"out": pooled.T @ grad, "bias": np.float32([grad.sum()])}
        d_pooled = grad[:, None] * self.p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, h)
        d_h = a[:, :, None] * d_pooled
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["v1"] = np.einsum("tn,tnk->k", d_e, u)
        d_u = d_e[:, :, None] * self.p["v1"] * (1 - u * u)
        g["w1"] = np.einsum("tnh,tnk->hk", h, d_u)
        d_h += d_u @ self.p["w1"].T
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            rec, d_next = self.p[f"rec{d}"], np.zeros((windows.shape[0], HIDDEN), np.float32)
            g[f"rec{d}"], d_gates = np.zeros_like(rec), np.zeros((windows.shape[1], windows.shape[0], 3 * HIDDEN), np.float32)
            for t, before, z, reset, cand, r_cand in reversed(saved[d]):
                dh = d_h[t, :, i * HIDDEN : (i + 1) * HIDDEN] + d_next
                d_cand = dh * (1 - z) * (1 - cand * cand)
                d_z = dh * (before - cand) * z * (1 - z)
                d_reset = d_cand * r_cand * reset * (1 - reset)
                d_rec = np.concatenate([d_z, d_reset, d_cand * reset], axis=1)
                d_gates[t] = np.concatenate([d_z, d_reset, d_cand], axis=1)
                g[f"rec{d}"] += before.T @ d_rec
                d_next = dh * z + d_rec @ rec.T
            flat, rows = d_gates.reshape(-1, 3 * HIDDEN), windows.T.ravel()
            g[f"b{d}"] = flat.sum(axis=0)
            g[f"in{d}"] = x[rows].T @ flat
            np.add.at(d_x, rows, flat @ self.p[f"in{d}"].T)
        return g, d_x


def window_table(first: np.ndarray, index: np.ndarray, pad: int):
    """(windows of word rows, document of each window): every document has one window at least."""
    count = np.diff(first)
    per_doc = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(count)), per_doc)
    nth = np.arange(per_doc.sum()) - np.repeat(np.concatenate([[0], np.cumsum(per_doc)[:-1]]), per_doc)
    at = (first[:-1][doc] + nth * STRIDE)[:, None] + np.arange(WINDOW)
    inside = at < first[1:][doc][:, None]
    padded = np.append(index, pad)
    return padded[np.where(inside, at, len(index))], doc


def document_logits(model: Model, texts: pa.Array) -> np.ndarray:
    """The highest window's logit of each text, all windows scored."""
    out = []
    for i, j, data, off in chunks(texts):
        w = Letters(data, off)
        hashes, index, grams, owner = unique_words(w)
        words, grams, owner = model.features(hashes, grams, owner)
        x = model.vectors(words, grams, owner)
        windows, doc = window_table(w.first, index, len(words))
        logit = np.concatenate([model.forward(x, windows[s : s + 2048]) for s in range(0, len(windows), 2048)])
        best = np.full(j - i, -np.inf, dtype=np.float64)
        np.maximum.at(best, doc, logit)
        out.append(best)
    return np.concatenate(out) if out else np.zeros(0)


def corpus_words(texts: pa.Array):
    """As unique_words, over many chunks, with the index of each document's first word."""
    first, index, hashes, grams, owner = [np.zeros(1, np.int64)], [], [], [], []
    base = 0
    for _, _, data, off in chunks(texts):
        w = Letters(data, off)
        h, at, g, who = unique_words(w)
        first.append(w.first[1:] + first[-1][-1])
        index.append(at + base), hashes.append(h), grams.append(g), owner.append(who + base)
        base += len(h)
    distinct, origin, same = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    chosen = np.zeros(base, dtype=bool)
    chosen[origin] = True
    owner = np.concatenate(owner)
    keep = chosen[owner]
    return distinct, same[np.concatenate(index)], np.concatenate(grams)[keep], same[owner[keep]], np.concatenate(first)


def _odds(keys: np.ndarray, n: np.ndarray, bad: np.ndarray, label: np.ndarray, most: int):
    """The keys of two documents at least (the most frequent ones), with smoothed log odds of their documents."""
    some = np.flatnonzero(n >= 2)
    some = np.sort(some[np.argsort(-n[some], kind="stable")[:most]])
    n, bad = n[some], bad[some]
    odds = np.log((bad + 0.5) / label.sum()) - np.log((n - bad + 0.5) / (1 - label).sum())
    return keys[some], (np.clip(odds, -3, 6) / 3).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = 1) -> Model:
    """Fit a model to documents and their labels."""
    label = np.asarray(labels, dtype=np.int64)
    none = np.zeros(0, np.uint64)
    if not len(label) or label.min() == label.max():
        return Model(none, none, np.zeros(0, np.float32), np.zeros(0, np.float32))
    hashes, index, grams, owner, first = corpus_words(pa.array(texts, pa.large_string()))
    kinds, grams = np.unique(grams, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    grams, owner = grams[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(hashes) + 1))
    counts = [np.zeros((2, len(hashes)), np.int64), np.zeros((2, len(kinds)), np.int64)]
    for d, y in enumerate(label):
        own = np.unique(index[first[d] : first[d + 1]])
        n = np.diff(at)[own]
        take = np.repeat(at[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(own) else own
        counts[0][y, own] += 1
        counts[1][y, np.unique(grams[take])] += 1
    words, word_odds = _odds(hashes, counts[0].sum(axis=0), counts[0][1], label, MOST_WORDS)
    known, gram_odds = _odds(kinds, counts[1].sum(axis=0), counts[1][1], label, MOST_GRAMS)
    model = Model(words, known, word_odds, gram_odds, seed)
    model.empty = False
    rows, gram_rows, gram_owner = model.features(hashes, kinds[grams], owner)
    windows, doc = window_table(first, index, len(rows))
    windows = windows.astype(np.int32)
    by_owner = np.argsort(gram_owner, kind="stable")
    gram_rows, gram_owner = gram_rows[by_owner], gram_owner[by_owner]
    gram_n = np.maximum(1, np.bincount(gram_owner, minlength=len(rows)))
    rng = np.random.default_rng(seed)
    x = model.vectors(rows, gram_rows, gram_owner)
    score = (x[:, 0] + 2 * x[:, VECTOR])[windows].max(axis=1)
    moments: dict = {}
    step = 0

    def adam(name: str, g: np.ndarray, at=None):
        m, v = moments.setdefault(name, (np.zeros_like(model.p[name]), np.zeros_like(model.p[name])))
        at = slice(None) if at is None else at
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        model.p[name][at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    for _ in range(ROUNDS):
        order = np.lexsort((-score, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        top = np.zeros(len(doc), dtype=np.int64)
        top[order] = rank
        positive = np.flatnonzero((label[doc] == 1) & (top == 0))
        negative = np.flatnonzero((label[doc] == 0) & (top < 2))
        others = np.flatnonzero((label[doc] == 0) & (top >= 2))
        negative = np.concatenate([negative, rng.choice(others, min(len(others), len(negative)), replace=False)])
        chosen = np.concatenate([positive, negative])
        weight = np.where(label[doc[chosen]] == 1, max(1.0, len(negative) / max(1, len(positive)) / 2), 1.0).astype(np.float32)
        for _ in range(2):
            mixed = rng.permutation(len(chosen))
            for s in range(0, len(mixed), BATCH):
                pick = mixed[s : s + BATCH]
                used, local = np.unique(windows[chosen[pick]], return_inverse=True)
                local = local.reshape(len(pick), WINDOW)
                real = used < len(rows)
                lo, hi = np.searchsorted(gram_owner, used), np.searchsorted(gram_owner, used, side="right")
                g_owner = np.repeat(np.arange(len(used)), hi - lo)
                g_at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
                g_rows = gram_rows[g_at]
                w_rows = np.where(real, np.append(rows, len(words))[used], len(words))
                xs = model.vectors(w_rows, g_rows, g_owner)
                logit, cache = model.forward(xs, local, True)
                y = label[doc[chosen[pick]]]
                grad = ((_sigmoid(logit) - y) * weight[pick] / len(pick)).astype(np.float32)
                step += 1
                grads, d_x = model.backward(xs, local, cache, grad)
                for name, g in grads.items():
                    adam(name, g)
                keep = w_rows < len(words)
                adam_rows, inverse = np.unique(w_rows[keep], return_inverse=True)
                if len(adam_rows):
                    g = np.zeros((len(adam_rows), VECTOR), np.float32)
                    np.add.at(g, inverse, d_x[:-1, :VECTOR][keep])
                    adam("word", g, adam_rows)
                adam_rows, inverse = np.unique(g_rows, return_inverse=True)
                if len(adam_rows):
                    g = np.zeros((len(adam_rows), VECTOR), np.float32)
                    share = d_x[:-1, VECTOR:] / np.append(gram_n, 1)[np.minimum(used, len(rows))][:, None]
                    np.add.at(g, inverse, share[g_owner])
                    adam("gram", g, adam_rows)
        x = model.vectors(rows, gram_rows, gram_owner)
        score = np.concatenate([model.forward(x, windows[s : s + 2048]) for s in range(0, len(windows), 2048)])
    best = np.full(len(label), -np.inf)
    np.maximum.at(best, doc, score)
    model.slope, model.shift = _calibrate(best, label)
    return model


def _calibrate(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A positive slope and a shift: 0.5 falls in the middle of the widest cut with the fewest errors."""
    order = np.argsort(logit, kind="stable")
    z, y = logit[order], label[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(1 - y)])[-1] - np.concatenate([[0], np.cumsum(1 - y)])
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    width = np.concatenate([[0], z[1:] - z[:-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    cut = cuts[best[np.argmax(width[best])]]
    return 1.0, float(-cut)


def training_rows(docs: DataFrame, labels: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, text, toxic of at most TRAIN_ROWS rows of each label outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    marks = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (fold != HELD_OUT))
    picked = None
    for value in (0, 1):
        some = marks.where(F.col("toxic") == value).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(TRAIN_ROWS)
        picked = some if picked is None else picked.unionByName(some)
    return input_columns(docs, "doc_id", "text").where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")


def train_model(rows: DataFrame) -> Model:
    """Train in one task on the bounded rows of training_rows(); the driver gets the finished model alone."""

    def fit(batches):
        found = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        found.sort()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t, _ in found], [y for _, _, y in found]))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], [])  # a plan known to be empty has no task


def document_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text."""
    z = [document_logits(model, texts.slice(s, 2000)) for s in range(0, len(texts), 2000)]
    z = np.concatenate(z) if z else np.zeros(0)
    return np.zeros(len(z)) if model.empty else _sigmoid(np.clip(model.slope * z + model.shift, -30, 30))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_WORDS and MOST_GRAMS

    def build(batches):
        for b in batches:
            p = document_scores(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = input_columns(docs, "doc_id", "text").mapInArrow(build, "doc_id long, score double, predicted int")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    return scored.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below 0.5, each judged by its own text, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")
    rows = input_columns(docs, *names).toDF(*map(str, range(len(names))))  # numbers for names, so that columns can't clash

    def build(batches):
        for b in batches:
            yield b.filter(pa.array(document_scores(shared.value, b.column(at)) < 0.5))

    return rows.mapInArrow(build, rows.schema).toDF(*names)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels (doc_id, toxic) and score all of docs (doc_id, text)."""
    return score_documents(docs, train_model(training_rows(docs, labels)))
