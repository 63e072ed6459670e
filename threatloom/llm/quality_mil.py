"""Quality scores by gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` consecutive words, all of them. A passage is encoded by
shares of byte classes, word lengths, repetition and hashed words, and a learned layer. Gated attention
(a softmax over passages of w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the weighted
representation gives the score. Labels are known for documents only; the gradient reaches passages
through their attention.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the smallest hashes of their
ids, whole, as long as they have at most ``SAMPLE_PASSAGES`` passages together; those of over ``LONGEST`` passages are left out.
So what reaches the driver is bounded by these parameters. Scoring runs over every document in one pass without a shuffle.

Defined results: null and empty texts are one empty passage and have a score like others; texts of any length are
scored whole; without labels of both kinds every score is the share of the label 1 (0.5 without labels); null labels
are not used; several labels of a document count as their mean, a tie as 1; of several labelled rows with one id one
is learned from; repeated rows and equal texts have equal scores; an empty table of documents gives an empty one;
extra columns are kept and never read; only text is ever an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import crc_of_id, materialize, small_batches

PASSAGE = 64
SAMPLE = 4000
SAMPLE_PASSAGES, LONGEST = 60_000, 3_000
BUCKETS = 64
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY, BATCH = 30, 0.01, 1e-4, 64
THRESHOLD = 0.7

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"*#$%&@^~+=", b"|/\\<>{}[]()_", b".,;:'\"-", b"\n", b" \t\r\x0b\x0c", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
_TABLES = [textops.byte_class(c).astype(np.uint8) for c in _CLASSES]
N_FEATURES = len(_CLASSES) + 6 + BUCKETS


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text and the end)."""
    words = textops.Words(data, offsets)
    counts = np.maximum(1, -(-words.counts // PASSAGE))
    first = np.r_[0, np.cumsum(counts)]
    n, text = int(first[-1]), np.repeat(np.arange(len(counts)), counts)
    word = np.minimum(words.first[text] + (np.arange(n) - first[text]) * PASSAGE, words.first[text + 1])  # first word
    stop = np.minimum(word + PASSAGE, words.first[text + 1])
    size = np.maximum(1, stop - word).astype(np.float32)
    starts = np.r_[words.starts, len(data)]
    begin = np.where(word == words.first[text], offsets[text], starts[word])
    length = np.diff(np.r_[begin, len(data)])
    out = np.zeros((n, N_FEATURES), np.float32)
    full = np.flatnonzero(length > 0)
    share = np.maximum(1, length).astype(np.float32)
    if len(full):
        for k, table in enumerate(_TABLES):
            out[full, k] = np.add.reduceat(table[data], begin[full], dtype=np.int32) / share[full]
    k = len(_TABLES)
    if len(words):
        hashes, at = words.hashes(), np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)
        passage = np.repeat(first[:-1], words.counts) + at // PASSAGE
        long = (words.ends - words.starts).astype(np.float32)
        grid = np.zeros((n, PASSAGE), np.uint64)
        grid[passage, at % PASSAGE] = hashes
        two = np.zeros((n, PASSAGE), np.uint64)
        two[:, 1:] = np.where(grid[:, 1:] != 0, textops.mix(grid[:, :-1]) + grid[:, 1:], 0)
        mean = np.bincount(passage, long, n) / size
        out[:, k] = mean / 10
        out[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(passage, long * long, n) / size - mean * mean)) / 10
        for j, g in enumerate((grid, two)):
            g = np.sort(g, axis=1)
            out[:, k + 2 + j] = ((g[:, 1:] != g[:, :-1]) & (g[:, 1:] != 0)).sum(1) / size
        out[:, k + 4] = np.sqrt(size / PASSAGE)
        out[:, k + 5] = np.bincount(passage, long > 15, n) / size
        hashed = np.bincount(passage * BUCKETS + (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, k + 6 :] = np.sqrt(hashed / size[:, None])
    return out, first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.weights, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh((x - self.mean) / self.scale @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * s) @ p["w"]
        raw = np.exp(raw - np.maximum.reduceat(raw, first[:-1])[bag])
        a = raw / np.add.reduceat(raw, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["b"] + p["c"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(first) - 1, self.prior)
        return self.forward(x, first)["score"].astype(np.float64)


def gradient(model: Model, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of bags, in the model's weights."""
    p, f = model.weights, model.forward(x, first)
    d = (f["score"] - labels) / len(labels)
    dz = d[:, None] * p["b"]
    dh = f["a"][:, None] * dz[f["bag"]]
    da = (f["h"] * dz[f["bag"]]).sum(1)
    raw = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
    dt, ds = raw[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), raw[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
    dh += dt @ p["V"].T + ds @ p["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    return {"E": ((x - model.mean) / model.scale).T @ dpre, "e": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ raw, "b": f["z"].T @ d, "c": d.sum()}


def begin(everything: np.ndarray, prior: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
    weights = {"E": draw(everything.shape[1], HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "b": draw(HIDDEN), "c": np.log(prior / (1 - prior)) * np.ones(())}
    return Model(prior, everything.mean(0), everything.std(0) + 1e-3, weights)


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Adam on the log loss; equal bags and labels in equal order give an equal model."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(prior)
    model, rng = begin(np.concatenate(bags), prior, seed), np.random.default_rng(seed)
    p = model.weights
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x, first = np.concatenate([bags[i] for i in own]), np.r_[0, np.cumsum([len(bags[i]) for i in own])]
            g = gradient(model, x, first, labels[own])
            step += 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of_id(doc_id), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on labelled documents (doc_id, text; doc_id, quality) that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(labels["doc_id"].alias("_id"), labels["quality"].cast("double").alias("_label")).where(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg((F.avg("_label") >= 0.5).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches):
        for batch in batches:
            for at, data, offsets in textops.slices(batch.column(2)):
                x, first = encode(data, offsets)
                bags = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bags)), batch.column(1).slice(at, len(bags)), pa.array(np.diff(first)), pa.array(bags, pa.binary())], names=["_id", "_label", "_n", "_bag"])

    rows = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("text")).join(F.broadcast(known), "_id").select("_id", "_label", "text")  # at most `sample` labels
    bags = rows.mapInArrow(run, "_id long, _label int, _n long, _bag binary").groupBy("_id", "_label").agg(F.min(F.struct("_n", "_bag")).alias("_one"))
    bags = materialize(bags.select("_id", "_label", "_one.*"), "quality-bags")
    bags, last, passages = bags.where(F.col("_n") <= LONGEST), None, 0
    for r in bags.select(F.xxhash64("_id").alias("_hash"), "_id", "_n").orderBy("_hash", "_id").collect():  # at most `sample` rows
        passages += r["_n"]
        if passages > SAMPLE_PASSAGES:
            break
        last = r
    if last is None:
        return fit([], np.zeros(0))
    first_ones = F.struct(F.xxhash64("_id").alias("h"), "_id") <= F.struct(F.lit(last["_hash"]).alias("h"), F.lit(last["_id"]).alias("_id"))
    rows = sorted((r["_id"], r["_label"], bytes(r["_bag"])) for r in bags.where(first_ones).collect())  # SAMPLE_PASSAGES at most
    found = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in rows]
    return fit(found, np.array([r[1] for r in rows], np.float64))


def with_scores(docs: DataFrame, model: Model, column: str = "_score") -> DataFrame:
    """``docs`` with the score of each row as a last column, whose own name clashes with none."""
    small_batches(docs.sparkSession)
    while column in docs.columns:
        column = "_" + column
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for _, data, offsets in textops.slices(batch.column(text)):
                scores.append(model.score(*encode(data, offsets)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = with_scores(docs.select("doc_id", "text"), train(docs, labels, sample), "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good."""
    rows = with_scores(docs, train(docs, labels, sample))
    return rows.where(F.col(rows.columns[-1]) >= THRESHOLD).select(*[rows[c] for c in docs.columns])
