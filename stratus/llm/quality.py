"""Quality classifier: a factorisation machine.

A document is a sparse vector of hashed words (sublinear counts, unit length) and of
one-hot bins of its structure statistics and metadata (stated length). The score is

    sigmoid(b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ])

the last term being all pairwise interactions of rank ``FACTORS``, in time linear in the
vector's entries. Features and scores are computed where the texts are.

Fitting takes at most about ``max_rows`` labelled documents (a documented bound, chosen by
a hash of the id, so the sample doesn't depend on order or partitions). Their features
are computed in parallel and written to the shared folder; one task, whose input the
bound limits whatever the corpus, runs mini-batch AdaGrad over them in a fixed order. The
model, of fixed size, is broadcast.

Defined cases: a null or empty text has structure features only and gets a score like any
other; null metadata falls back on the text; rows with null labels or ids aren't learnt
from; rows that repeat an id are scored each, and learnt from each; with no labelled rows
the score is 0.5; other columns pass unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratus.llm import tokens
from stratus.llm.common import written

WORD_BITS, FACTORS = 15, 8
BINS = 32
MAX_ROWS, EPOCHS, BATCH = 12_000, 8, 128
RATE, DECAY = 0.1, 1e-5
#: Deletes these bytes to count them: C speed.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", bytes(range(128, 256)), b"{}[]()\\^~_=+/@'\"`-"]
N_STATS = len(CLASSES) + 8
SIZE = (1 << WORD_BITS) + N_STATS * BINS


# ---- features ---------------------------------------------------------------------------


def statistics(body: bytes, words: list[bytes], counts: Counter, stated: int | None) -> list[float]:
    """Structure statistics, each from 0 to 1."""
    n, size = len(words), len(body)
    ratio = [(size - len(body.translate(None, c))) / max(size, 1) for c in CLASSES]
    lines = [x for x in body.split(b"\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:])) if n > 2 else ()
    return [
        *[x**0.5 for x in ratio],
        min(np.log2(n + 1) / 16, 1),
        min(sum(map(len, words)) / max(n, 1) / 20, 1),
        len(counts) / max(n, 1),
        len(triples) / max(n - 2, 1),
        len(set(lines)) / max(len(lines), 1),
        min(max(counts.values(), default=0) / max(n, 1) * 4, 1),
        min(np.log2(len(lines) + 1) / 10, 1),
        min(np.log2((size if stated is None else max(stated, 0)) + 1) / 20, 1),
    ]


def features(text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a document."""
    body = (text or "").encode()
    words = body.split()
    counts = Counter(words)
    k = len(counts)
    index, value = np.empty(k + N_STATS, np.int32), np.empty(k + N_STATS, np.float32)
    index[:k] = np.fromiter(map(crc32, counts), np.int64, k) & ((1 << WORD_BITS) - 1)
    x = 1 + np.log(np.fromiter(counts.values(), np.float32, k))
    value[:k] = x / max(float(np.sqrt((x * x).sum())), 1e-9)
    bins = np.minimum((np.array(statistics(body, words, counts, stated)) * BINS).astype(np.int32), BINS - 1)
    index[k:] = (1 << WORD_BITS) + np.arange(N_STATS) * BINS + bins
    value[k:] = 0.5
    return index, value


# ---- model ------------------------------------------------------------------------------


class Machine:
    """Weights w (SIZE), factors v (SIZE, FACTORS) and the bias."""

    def __init__(self, bias: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None):
        draw = np.random.default_rng(7)
        self.bias = bias
        self.w = np.zeros(SIZE, np.float32) if w is None else w
        self.v = draw.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32) if v is None else v

    def _sums(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, starts)
        logit = self.bias + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return logit, s, vx

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        index, value, starts = _flat(rows)
        return 1 / (1 + np.exp(-np.clip(self._sums(index, value, starts)[0], -30, 30).astype(np.float64)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> "Machine":
        """AdaGrad on the log loss, in the given order of rows, reshuffled each epoch."""
        draw, sw, sv, sb = np.random.default_rng(11), np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32), 1e-6
        for _ in range(EPOCHS):
            order = draw.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                index, value, starts = _flat([rows[i] for i in pick])
                logit, s, vx = self._sums(index, value, starts)
                wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]).astype(np.float32) / len(pick) * 16
                each = np.repeat(wrong, np.diff(np.r_[starts, len(index)]))
                wide = np.repeat(s, np.diff(np.r_[starts, len(index)]), axis=0)
                own, back = np.unique(index, return_inverse=True)
                gw = np.bincount(back, each * value, len(own)).astype(np.float32) + DECAY * self.w[own]
                pulls = (each * value)[:, None] * (wide - vx)
                gv = np.stack([np.bincount(back, pulls[:, f], len(own)) for f in range(FACTORS)], 1).astype(np.float32) + DECAY * self.v[own]
                sw[own] += gw * gw
                sv[own] += gv * gv
                self.w[own] -= RATE * gw / np.sqrt(sw[own])
                self.v[own] -= RATE / 4 * gv / np.sqrt(sv[own])
                sb += float(wrong.sum()) ** 2
                self.bias -= RATE * float(wrong.sum()) / sb**0.5
        return self


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i, _ in rows])
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.r_[0, np.cumsum(sizes)[:-1]]


# ---- Spark ------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", label_col: str = "quality", usable: Column | None = None, max_rows: int = MAX_ROWS) -> Machine:
    """Learns from documents that have a label (and satisfy ``usable``, a condition on the
    labels' rows), about ``max_rows`` of them at most, by a hash of the id."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)")
    if usable is not None:
        known = labels.filter(usable).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)")
    share = min(1.0, max_rows / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("__id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    x = docs.join(F.broadcast(known), F.col(id_col) == F.col("__id"))  # max_rows rows of two numbers
    x = x.select(F.col("__id").cast("string"), F.col("__label"), F.col(text_col), (F.col(length_col) if length_col in docs.columns else F.lit(None)).cast("long"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tokens.slices(b.column(2)):
                keys, label, texts, stated = (c.slice(lo, hi - lo) for c in b.columns)
                vectors = [features(t, n) for t, n in zip(texts.to_pylist(), stated.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, label, pa.array([i.tobytes() for i, _ in vectors]), pa.array([v.tobytes() for _, v in vectors])], names=["id", "label", "i", "v"])

    held = written(x.mapInArrow(rows, "id string, label int, i binary, v binary"), "quality-sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in b.to_pylist()]
        found.sort(key=lambda r: (crc32(r["id"].encode()), r["id"], r["i"]))
        if not found:
            return
        vectors = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in found]
        m = Machine().fit(vectors, np.array([r["label"] for r in found], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.w.tobytes()]), pa.array([m.v.tobytes()])], names=["bias", "w", "v"])

    model = held.coalesce(1).mapInArrow(learn, "bias double, w binary, v binary").first()  # of fixed size
    if model is None:
        return Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))
    return Machine(model["bias"], np.frombuffer(model["w"], np.float32), np.frombuffer(model["v"], np.float32).reshape(SIZE, FACTORS))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", length_col: str | None = "n_chars", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, by default all) with the score appended."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))
    n = len(kept)
    x = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__text"), (F.col(length_col) if length_col in docs.columns else F.lit(None)).cast("long").alias("__stated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine(*shared.value)
        for b in batches:
            for lo, hi in tokens.slices(b.column(n)):
                part = b.slice(lo, hi - lo)
                vectors = [features(t, k) for t, k in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(model.scores(vectors))], names=[*kept, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:n])
    return x.mapInArrow(run, f"{fields}, `{score_col}` double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = fit(docs, labels, usable=~held_out())
    out = score(docs, machine, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
