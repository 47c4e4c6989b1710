"""Document scores by masked pseudo-likelihood.

A window network predicts every word from REACH words on both sides: embeddings,
one table for each place, are summed, pass a tanh layer, and a two-level softmax (a group
of symbols, then the symbol in it) gives the conditional probability of the word's
symbol. The score of a document is the sum of all its words' conditional log-probabilities.

Words are counted over the whole corpus, and the counts are kept as a table. The
number of symbols grows with the corpus: as many as the square of SIDE times the
sixth root of its words. The most frequent words have symbols of their own; the others
share symbols by hash, and a word's probability within a shared symbol is its part of
the symbol's count. Scoring carries the counts of the NEAR most frequent words, at all
sizes, and gets those of all others by a join with the table of counts. Each shared
symbol holds back the count of its words seen once (Good and Turing) for unseen words,
which are spelled: every byte, and the end, is one of 257.

The network starts at the symbols' frequencies. In each of ROUNDS rounds every
partition runs its whole rows through it, embeddings and all, and the networks are
averaged by words, in the order of the partitions.

Cases: null or empty text: no words, log-likelihood 0 and a null mean; null keys
and repeated rows are scored each; empty table: no rows, and a model trained on one
spells every word; other columns are not read. Ties of counts are broken by the word's
hash. Words are runs of bytes between white space, A-Z in lower case. Networks depend
on how rows lie in partitions, by less than the models differ between rounds.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.llm import words as W
from motionloom.llm.common import bulks, column, bounded_batches, deals, materialize, texts

SIDE, WIDTH, REACH = 2.0, 16, 2
BATCH, ROUNDS, RATE, NEAR = 4096, 2, 1.0, 1 << 16


def word_hashes(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each text's words begin and end, and the words' numbers of bytes."""
    starts, ends = W.runs(~((b == 32) | (b - np.uint8(9) <= 4)), bounds)
    return W.hashes(W.lowered(b), starts, ends), np.searchsorted(starts, bounds), ends - starts


class Sorted:
    """Sorted hashes, found by their first bits: most of the 2**bits slots have one at most."""

    def __init__(self, known: np.ndarray):
        self.known, bits = known, min(22, max(8, len(known).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(self.first, append=len(known)).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash, a place in `known`, and whether it is there."""
        if not len(self.known):
            return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        at = np.minimum(self.first[h >> self.shift], len(self.known) - 1)
        there = self.known[at] == h
        rest = np.flatnonzero(~there)
        for k in range(1, self.most):
            # whose slot has more
            rest = rest[self.known[at[rest]] < h[rest]]
            next = np.minimum(at[rest] + 1, len(self.known) - 1)
            at[rest], there[rest] = next, self.known[next] == h[rest]
        return at, there


def single_thread() -> None:
    """One thread for numpy's own OpenBLAS, if it has one: these products are small, and more threads mostly wait."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


@dataclass
class Vocabulary:
    """Symbols of words: `side` groups of `side`; the first `own` symbols are words, the rest are shared by hash."""

    side: int
    known: np.ndarray  # sorted hashes of the words with symbols of their own
    number: np.ndarray  # their symbols

    def __post_init__(self):
        self.places = Sorted(self.known)

    @property
    def pad(self) -> int:
        return self.side**2

    @property
    def own(self) -> int:
        return self.pad * 3 // 4

    def symbols(self, h: np.ndarray) -> np.ndarray:
        # 16-bit numbers are sorted by radix
        kind = np.uint16 if self.pad < 1 << 16 else np.int32
        shared = self.own + ((h >> np.uint64(1)) % np.uint64(self.pad - self.own)).astype(np.int64)
        if not len(self.known):
            return shared.astype(kind)
        at, there = self.places.find(h)
        return np.where(there, self.number[at], shared).astype(kind)


def contexts(s: np.ndarray, bounds: np.ndarray, pad: int) -> np.ndarray:
    """The REACH symbols before and after each word; `pad` beyond the text."""
    n, doc = len(s), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((n, 2 * REACH), pad, s.dtype)
    for j, k in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        if k < 0:
            ok = doc[-k:] == doc[:k]
            out[-k:, j][ok] = s[:k][ok]
        else:
            ok = doc[:-k] == doc[k:]
            out[:-k, j][ok] = s[k:][ok]
    return out


class Network:
    """Embeddings of the left and right neighbours (L and R), a tanh layer, and the two-level output."""

    def __init__(self, counts: np.ndarray, seed: int = 1):
        """counts: of every symbol; the untrained network gives their frequencies."""
        rng = np.random.default_rng(seed)
        normal = lambda *s: (0.1 * rng.standard_normal(s)).astype(np.float32)
        self.side = side = int(round(len(counts) ** 0.5))
        n = np.log(counts.reshape(side, side) + 0.5)
        top = np.log(np.exp(n).sum(axis=1))
        self.p = {"E": normal(2 * REACH, side * side + 1, WIDTH), "b": np.zeros(WIDTH, np.float32), "G": normal(WIDTH, side) / 10, "g": (top - top.max()).astype(np.float32), "M": normal(side, WIDTH, side) / 10, "m": (n - n.max(axis=1, keepdims=True)).astype(np.float32)}

    def _hidden(self, c: np.ndarray) -> np.ndarray:
        x = np.take(self.p["E"][0] + self.p["b"], c[:, 0], axis=0)
        for j in range(1, c.shape[1]):
            x += np.take(self.p["E"][j], c[:, j], axis=0)
        return np.tanh(x, out=x)

    def _run(self, c: np.ndarray, s: np.ndarray, rate: float = 0.0) -> np.ndarray:
        """Log-probabilities of symbols s in contexts c; with a rate, moves all layers along their gradient."""
        p, n, side = self.p, len(s), self.side
        order = np.argsort(s, kind="stable")
        c, s = np.take(c, order, axis=0), s[order]
        hidden = self._hidden(c)
        # a last column of ones: the output's biases are rows of its matrices
        inner = np.ones((n, WIDTH + 1), np.float32)
        inner[:, :-1] = hidden
        # sums as products: much faster than sums along short rows
        one = np.ones(side, np.float32)
        group, member = np.divmod(s, s.dtype.type(side))
        cuts = np.searchsorted(group, np.arange(side + 1)).tolist()
        parts = [(k, slice(a, e)) for k, (a, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < e]
        first = np.arange(0, n * side, side)
        at = first + group
        z = inner @ np.concatenate([p["G"], p["g"][None]])
        flat = z.reshape(-1)
        own = flat[at]
        np.exp(z, out=z)
        total = z @ one
        got = own - np.log(total)
        if rate:
            z *= (-1 / total)[:, None]
            flat[at] += 1
            back = z @ p["G"].T
            move = inner.T @ z
            move *= np.float32(rate / n)
            p["G"] += move[:-1]
            p["g"] += move[-1]
        both = np.concatenate([p["M"], p["m"][:, None]], axis=1)
        for k, part in parts:
            np.matmul(inner[part], both[k], out=z[part])
        at = first + member
        own = flat[at]
        np.exp(z, out=z)
        total = z @ one
        got += own - np.log(total)
        if rate:
            z *= (-1 / total)[:, None]
            flat[at] += 1
            more, moves = np.empty_like(back), np.zeros_like(both)
            for k, part in parts:
                x = z[part]
                np.matmul(x, p["M"][k].T, out=more[part])
                np.matmul(inner[part].T, x, out=moves[k])
            moves *= (rate / np.maximum(np.diff(cuts), 64)).astype(np.float32)[:, None, None]
            p["M"] += moves[:, :-1]
            p["m"] += moves[:, -1]
            back += more
            hidden *= hidden
            back *= np.subtract(1, hidden, out=hidden)
            p["b"] += np.float32(rate / n) * (np.ones(n, np.float32) @ back)
            # sums by symbol, a column at a time: much faster than sums of short rows
            columns, sums = np.ascontiguousarray(back.T, np.float64), np.empty((WIDTH, side**2 + 1), np.float32)
            for j in range(c.shape[1]):
                x = c[:, j].astype(np.int64)
                step = rate / np.maximum(np.bincount(x, minlength=len(sums.T)), 32)
                for k in range(WIDTH):
                    np.multiply(np.bincount(x, columns[k], len(step)), step, out=sums[k], casting="unsafe")
                p["E"][j] += sums.T
        out = np.empty(n, np.float32)
        out[order] = got
        return out

    def learn(self, c: np.ndarray, s: np.ndarray, rate: float) -> None:
        """Steps of BATCH words at most, each from all over the rows."""
        steps = -(-len(s) // BATCH)
        for i in range(steps):
            self._run(c[i::steps], s[i::steps], rate)

    def log_probabilities(self, c: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = [self._run(c[i : i + 4 * BATCH], s[i : i + 4 * BATCH]) for i in range(0, len(s), 4 * BATCH)]
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def copy(self) -> Network:
        other = object.__new__(Network)
        other.side, other.p = self.side, {k: v.copy() for k, v in self.p.items()}
        return other

    def to_bytes(self) -> bytes:
        return b"".join(v.tobytes() for v in self.p.values())

    def from_vector(self, v: np.ndarray) -> Network:
        at = 0
        for k, w in self.p.items():
            self.p[k] = v[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by hash, stands in the corpus."""

    def run(batches):
        for table in bulks(batches, 16 << 20):
            h, n = np.unique(word_hashes(*W.flat(column(table, "text")))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    return texts(docs).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """The network, the symbols, the table (word, n) of the corpus, and by symbol the
    logarithms of its count with what it holds back, and of what it holds back; `near`
    has the sorted hashes and the logarithms of the counts of the most frequent words."""

    net: Network
    vocabulary: Vocabulary
    counts: DataFrame
    whole: np.ndarray
    held: np.ndarray
    near: tuple[np.ndarray, np.ndarray]


def train(docs: DataFrame) -> Model:
    """Counts all words of all rows and trains the network on all of them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = materialize(count_words(docs), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    side = max(2, int(np.ceil(SIDE * total ** (1 / 6))))
    own = Vocabulary(side, np.zeros(0), np.zeros(0)).own
    top = counts.orderBy(F.desc("n"), "word").limit(max(own, NEAR)).collect()
    known = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    number = np.argsort(known[:own], kind="stable")
    v = Vocabulary(side, known[number], number)
    order = np.argsort(known, kind="stable")
    near = known[order], np.log(np.array([r["n"] for r in top], np.float64))[order]

    def by_symbol(batches):
        for batch in batches:
            s = v.symbols(batch.column("word").to_numpy().view(np.uint64)).astype(np.int64)
            n = batch.column("n").to_numpy()
            kinds, at = np.unique(s, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(at, n, len(kinds)).astype(np.int64)), pa.array(np.bincount(at, n == 1, len(kinds)).astype(np.int64))], ["symbol", "n", "once"])

    size, once = np.zeros(v.pad), np.zeros(v.pad)
    for r in counts.mapInArrow(by_symbol, "symbol long, n long, once long").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect():
        size[r["symbol"]], once[r["symbol"]] = r["n"], r["once"]
    net = Network(size)
    rows = texts(docs).select("text")
    for epoch in range(ROUNDS):
        net = _round(rows, net, v, RATE / (1 + epoch))
    return Model(net, v, counts, np.log(size + once + 1), np.log(once + 1), near)


def _round(rows: DataFrame, start: Network, v: Vocabulary, rate: float) -> Network:
    """The average of the networks that the partitions make of `start`."""

    def run(batches):
        single_thread()
        own, seen = start.copy(), 0
        for table in bulks(batches):
            h, bounds, _ = word_hashes(*W.flat(column(table, "text")))
            s = v.symbols(h)
            own.learn(contexts(s, bounds, v.pad), s, rate)
            seen += len(s)
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "seen": pa.array([seen], pa.int64()), "net": [own.to_bytes()]})

    def summed(batches):
        total, seen, part = None, 0, 0
        for batch in batches:
            for p, n, raw in zip(*(batch.column(k).to_pylist() for k in ("part", "seen", "net")), strict=True):
                x = np.frombuffer(raw, np.float32).astype(np.float64) * n
                total, seen, part = x if total is None else total + x, seen + n, p
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seen": pa.array([seen], pa.int64()), "net": [total.tobytes()]})

    schema = "part long, seen long, net binary"
    # no more networks than the session's partitions, however many the table has; sums of sums: the driver gets 8
    few = rows.coalesce(deals(rows.sparkSession, 64)).mapInArrow(run, schema)
    got = few.repartition(8, "part").sortWithinPartitions("part").mapInArrow(summed, schema).collect()
    if not got:
        return start
    seen = sum(r["seen"] for r in got)
    return start.copy().from_vector(sum(np.frombuffer(r["net"], np.float64) for r in sorted(got, key=lambda r: r["part"])) / seen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_likelihood of every row."""
    bounded_batches(docs.sparkSession)
    net, v, whole, held, (near, logs) = model.net, model.vocabulary, model.whole, model.held, model.near
    near = Sorted(near)

    def run(batches):
        single_thread()
        at = TaskContext.get().partitionId() << 33
        for table in bulks(batches):
            h, bounds, size = word_hashes(*W.flat(column(table, "text")))
            s = v.symbols(h)
            got = net.log_probabilities(contexts(s, bounds, v.pad), s)
            rare = np.flatnonzero(s >= v.own)
            got[rare] -= whole[s[rare]]
            at_near, there = near.find(h[rare])
            got[rare[there]] += logs[at_near[there]]
            rare = rare[~there]
            total = np.concatenate([[0.0], np.cumsum(got)])[bounds]
            n = np.diff(bounds)
            spelled = held[s[rare]] - (size[rare] + 1) * np.log(257)
            offsets = pa.array(np.searchsorted(rare, bounds).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at + np.arange(len(n))), column(table, "doc_id"), pa.array(n, pa.int64()), pa.array(np.where(n > 0, np.diff(total), 0.0)), pa.ListArray.from_arrays(offsets, pa.array(h[rare].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(spelled.astype(np.float32)))],
                ["row", "doc_id", "n_words", "ll", "words", "spelled"],
            )
            at += len(n)

    # the written table fixes the numbers of the rows
    rows = materialize(texts(docs).mapInArrow(run, "row long, doc_id long, n_words long, ll double, words array<long>, spelled array<float>"), "scores")
    words = rows.select("row", F.inline(F.arrays_zip("words", "spelled"))).withColumnRenamed("words", "word")
    counted = words.join(model.counts, "word", "left").select("row", F.coalesce(F.log("n"), F.col("spelled").cast("double")).alias("x"))
    # whole numbers: the sum doesn't depend on the order
    shared = counted.groupBy("row").agg(F.sum(F.round(F.col("x") * 2**20).cast("long")).alias("x"))
    ll = F.col("ll") + F.coalesce(F.col("x") / 2**20, F.lit(0.0))
    return rows.select("row", "doc_id", "n_words", "ll").join(shared, "row", "left").select("doc_id", "n_words", ll.alias("log_likelihood"), F.when(F.col("n_words") > 0, ll / F.col("n_words")).alias("mean_log_likelihood"))
