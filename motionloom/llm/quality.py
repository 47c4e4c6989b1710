"""Quality of whole texts by attention-based multiple-instance learning.

A text is a bag of passages of about PASSAGE bytes, cut at white space, all of
it. Each passage is described by shares of byte classes, word repetition and a
hashed histogram of byte pairs, and encoded by a layer; a gated attention (a tanh
and a sigmoid branch) learned from document labels only weighs the passages; the
score is logistic in the weighted mean of their codes. Labels, language, source
and key are no inputs.

The model is fitted on at most SAMPLE labelled rows, taken in the order of a hash
of their key, whose crc32(key as text) mod FOLDS is not 0.

Cases: null or empty text: one passage without bytes, so a constant score;
repeated rows and null keys are scored like others (a null key is never held
out); no usable labels of both kinds: every score is 0.5; empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.llm import words as W
from motionloom.llm.common import bulks, column, bounded_batches, texts

PASSAGE, SAMPLE, FOLDS, THRESHOLD = 800, 8000, 5, 0.3
PAIRS, CODE, GATE = 64, 16, 8
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()/\\=+", b"-_:;'\"`")


def passages(b: np.ndarray, bounds: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all passages, and each one's text; an empty text has one empty passage."""
    lens = np.diff(bounds)
    count = np.maximum(1, lens // size)
    doc = np.repeat(np.arange(len(lens)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[doc] + k * lens[doc] // count[doc]
    space = np.flatnonzero((b == 32) | (b == 10))
    inner = k > 0
    if len(space):
        nxt = space[np.minimum(np.searchsorted(space, start), len(space) - 1)]
        ok = inner & (nxt >= start) & (nxt < bounds[doc + 1]) & (nxt - start < size // 4)
        start = np.where(ok, nxt, start)
    return np.append(start, bounds[-1]), doc


def features(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of float32 for each passage, and the number of its text."""
    cuts, doc = passages(b, bounds)
    n = len(doc)
    lens = np.diff(cuts)
    out = np.zeros((n, len(CLASSES) + 6 + PAIRS), np.float32)
    scale = 1.0 / np.maximum(lens, 1)
    owner = np.repeat(np.arange(n), lens)
    kind = np.full(256, len(CLASSES), np.int64)
    for i, c in enumerate(CLASSES):
        kind[list(c)] = i
    width = len(CLASSES) + 1
    out[:, :width] = np.bincount(owner * width + kind[b], minlength=n * width).reshape(n, width) * scale[:, None]
    if len(b):
        pair = ((b[:-1].astype(np.int64) * 31 + b[1:]) * 2654435761 >> 12) & (PAIRS - 1)
        same = owner[1:] == owner[:-1]
        got = np.bincount(owner[:-1][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS)
        # a short passage's histogram says little: its deviation from an even one is weighed by length
        out[:, -PAIRS:] = (np.sqrt(got * scale[:, None]) - PAIRS**-0.5) * (lens / (lens + 64.0))[:, None]
        low = W.lowered(b)
        s, e = W.runs(~((b == 32) | ((b >= 9) & (b <= 13))), cuts)
        h, of = W.hashes(low, s, e), owner[s]
        words = np.maximum(np.bincount(of, minlength=n), 1)
        twice = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
        order = np.lexsort((h, of))
        fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])]) if len(h) else np.zeros(0, bool)
        out[:, width] = twice / words
        out[:, width + 1] = np.bincount(of[order][fresh], minlength=n) / words
        out[:, width + 2] = np.bincount(of, e - s, minlength=n) / words / 16
        out[:, width + 3] = np.log1p(words) / 8
        out[:, width + 4] = np.bincount(of, b[e - 1] < 48, minlength=n) / words if len(s) else 0
    return out, doc


class AttentionModel:
    """Encoder, gated attention and output, in plain arrays."""

    def __init__(self, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.p = {"E": init(n, CODE), "e": np.zeros(CODE), "V": init(CODE, GATE), "G": init(CODE, GATE), "a": init(GATE, 1), "o": init(CODE, 1), "c": np.zeros(1)}

    def forward(self, x: np.ndarray, doc: np.ndarray, n_docs: int):
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        v, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        s = ((v * g) @ p["a"])[:, 0]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        top = np.maximum.reduceat(s, first)
        w = np.exp(s - np.repeat(top, np.diff(np.append(first, len(s)))))
        w /= np.repeat(np.add.reduceat(w, first), np.diff(np.append(first, len(s))))
        z = np.add.reduceat(w[:, None] * h, first, axis=0)
        return x, h, v, g, w, z, 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)[:, 0]))

    def score(self, x: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        return self.forward(x, doc, n_docs)[-1]

    def gradients(self, x, doc, y):
        p, n = self.p, len(y)
        x, h, v, g, w, z, q = self.forward(x, doc, n)
        d = ((q - y) / n)[:, None]
        dz = d @ p["o"].T
        dh = w[:, None] * dz[doc]
        dw = (dz[doc] * h).sum(axis=1)
        ds = w * (dw - np.bincount(doc, w * dw, minlength=n)[doc])
        dvg = ds[:, None] @ p["a"].T
        dv, dg = dvg * g * (1 - v * v), dvg * v * g * (1 - g)
        dh += dv @ p["V"].T + dg @ p["G"].T
        dx = dh * (1 - h * h)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": h.T @ dv, "G": h.T @ dg, "a": (v * g).T @ ds[:, None], "o": z.T @ d, "c": d.sum(0)}

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        bounds = np.searchsorted(doc, np.arange(len(y) + 1))
        rng, m, s, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                size = bounds[rows + 1] - bounds[rows]
                at = np.repeat(bounds[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                t += 1
                for k, grad in self.gradients(x[at], np.repeat(np.arange(len(rows)), size), y[rows]).items():
                    grad = grad + decay * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * grad
                    s[k] = 0.999 * s.get(k, 0) + 0.001 * grad * grad
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel | None:
    """Fit on at most `sample` labelled rows outside the held-out fold; None without both labels."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for table in bulks(batches):
            x, doc = features(*W.flat(column(table, "text")))
            bounds = np.searchsorted(doc, np.arange(len(table) + 1))
            rows = [x[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(table, "doc_id"), column(table, "quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    # at most `sample` rows of ids are broadcast
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["quality"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    width = len(CLASSES) + 6 + PAIRS
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in rows]
    return AttentionModel(width).fit(np.concatenate(bags).astype(np.float64), np.repeat(np.arange(len(bags)), [len(x) for x in bags]), y)


def score(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for table in bulks(batches):
            n = len(table)
            s = np.full(n, 0.5)
            if model is not None:
                x, doc = features(*W.flat(column(table, "text")))
                s = model.score(x.astype(np.float64), doc, n)
            yield pa.RecordBatch.from_arrays([column(table, "doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts; their columns stay."""
    model = train(docs, labels)
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs

    def good(batches):
        for batch in batches:
            if batch.num_rows:
                text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).fill_null("")
                x, doc = features(*W.flat(text))
                batch = batch.filter(pa.array(model.score(x.astype(np.float64), doc, batch.num_rows) >= THRESHOLD))
            yield batch

    return docs.mapInArrow(good, docs.schema)
