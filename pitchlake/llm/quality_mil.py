"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, which together are its whole text. Each passage is
encoded by one hidden layer; gated attention (a tanh branch times a sigmoid branch) weighs the
encodings, and the weighted mean is scored. Weights are learned from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel

PASSAGE = 64
HASHED = 24
HIDDEN, GATE = 24, 12
#: Labelled documents to learn from, at most, and the passages that each gives, at most, from all over its text.
SAMPLE_DOCS, SAMPLE_PASSAGES = 2000, 256
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 64, 0.01, 1e-4, 7
ACCEPT = 0.7

_CLASSES = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?", "'\"()-", "#$%&*+/<=>@[\\]^_`{|}~", "\n\r", " \t"]
_LUT = np.zeros((len(_CLASSES) + 1, 256), np.float32)
for _i, _c in enumerate(_CLASSES):
    _LUT[_i, [ord(c) for c in _c]] = 1
_LUT[-1, 128:] = 1
FEATURES = len(_LUT) + 8 + HASHED


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of features for each passage, for each text the index of its first passage; one more than texts).

    A text without words has one passage, of zeros.
    """
    starts, ends, first = kernel.word_bounds(data, offsets)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    bag = np.concatenate([[0], np.cumsum(n_passages)])
    x = np.zeros((bag[-1], FEATURES), np.float32)
    if not len(starts):
        return x, bag
    text = np.repeat(np.arange(len(n_words)), n_words)
    passage = bag[text] + (np.arange(len(starts)) - first[text]) // PASSAGE
    full, at, size = np.unique(passage, return_index=True, return_counts=True)
    size = size.astype(np.float32)
    # The bytes of a passage go from its first word to the end of its last one.
    low, high = starts[at], ends[np.append(at[1:], len(starts)) - 1]
    span = (high - low).astype(np.float32)
    for i, lut in enumerate(_LUT):
        sums = np.concatenate([[0], np.cumsum(lut[data], dtype=np.float64)])
        x[full, i] = (sums[high] - sums[low]) / span
    k = len(_LUT)
    length = (ends - starts).astype(np.float32)
    mean = np.add.reduceat(length, at) / size
    x[full, k] = np.log1p(size)
    x[full, k + 1] = np.log(mean)
    x[full, k + 2] = np.sqrt(np.maximum(0, np.add.reduceat(length * length, at) / size - mean * mean)) / mean
    h = kernel.word_hashes(data, starts, ends)
    again = np.zeros(len(h), np.float32)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    x[full, k + 3] = np.add.reduceat(again, at) / size
    with np.errstate(over="ignore"):
        own = kernel.mix(h + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x[full, k + 4] = np.bincount(passage[np.unique(own, return_index=True)[1]], minlength=len(x))[full] / size
        # Runs of four words that the text had before, wherever in it.
        runs = kernel.run_hashes(h, 4)
        inside = kernel.in_texts(first, 4)
        where = np.flatnonzero(inside)
        if len(where):
            new = np.unique(kernel.mix(runs[where] + text[where].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)[1]
            old = np.ones(len(where), bool)
            old[new] = False
            x[full, k + 5] = np.bincount(passage[where[old]], minlength=len(x))[full] / size
    x[full, k + 6] = np.log1p(n_words[text[at]])
    last = data[ends - 1]
    x[full, k + 7] = np.add.reduceat(_LUT[4][last], at) / size
    bucket = (h >> np.uint64(40)).astype(np.int64) % HASHED
    sign = np.where((h >> np.uint64(63)).astype(bool), 1.0, -1.0)
    x[:, k + 8 :] = np.bincount(passage * HASHED + bucket, sign, len(x) * HASHED).reshape(len(x), HASHED) / 8
    return x, bag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights, and the means and deviations that standardize features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = mean, scale
        d = len(mean)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"E": draw(d, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w, first = self.w, bag[:-1]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        s = (t * g) @ w["a"]
        of = np.repeat(np.arange(len(first)), np.diff(bag))
        s = np.exp(s - np.maximum.reduceat(s, first)[of])
        weight = s / np.add.reduceat(s, first)[of]
        z = np.add.reduceat(weight[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "of": of, "weight": weight, "z": z, "p": _sigmoid(z @ w["c"] + w["b"])}

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, bag)
        dl = (f["p"] - y) / len(y)
        dz = dl[:, None] * w["c"]
        dweight = (dz[f["of"]] * f["h"]).sum(1)
        ds = f["weight"] * (dweight - np.add.reduceat(f["weight"] * dweight, bag[:-1])[f["of"]])
        dt, dg = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["weight"][:, None] * dz[f["of"]] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dl, "b": dl.sum(keepdims=True)}

    def scores(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self.forward(x, bag)["p"]


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam over batches of bags in an order fixed by SEED; the same bags give the same weights."""
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    model = Model(every.mean(0), every.std(0) + 1e-3, rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs if len(bags) else 0):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            bag = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            step += 1
            for k, g in model.gradient(np.concatenate([bags[i] for i in chosen]), bag, y[chosen]).items():
                g = g + DECAY * model.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = model.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


_BAG = T.StructType([T.StructField("key", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.BinaryType())])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from the labelled documents, at most sample_docs of them, chosen by a hash of their id.

    Rows without label, id or text are not learned from; of an id with several labels the smallest
    counts, of an id with several texts the one with the smallest hash. Of a text of more than
    SAMPLE_PASSAGES passages so many are taken, evenly spaced. The driver gets passage features of
    the sample only: one row for each chosen id. No labelled row: a model with random weights,
    whose scores are all near 0.5.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__mil_id")).agg(F.min(label_col).cast("int").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("__mil_id"), "__mil_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), F.col("key") == F.col("__mil_id")).groupBy("key").agg(F.first("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for _, data, offsets in kernel.chunks(batch.column(2)):
                x, bag = features(data, offsets)
                for a, b in zip(bag[:-1], bag[1:], strict=True):
                    own = x[a:b] if b - a <= SAMPLE_PASSAGES else x[np.linspace(a, b - 1, SAMPLE_PASSAGES).astype(np.int64)]
                    out.append(own.tobytes())
                    sizes.append(len(own))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=_BAG.names)

    found = sorted(rows.mapInArrow(bags, _BAG).collect())
    return fit([np.frombuffer(r["x"], np.float32).reshape(r["n"], FEATURES) for r in found], np.array([float(r["quality"]) for r in found]))


def score(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text", accept: float = ACCEPT, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` with score (0 to 1) and predicted (1 if score >= accept) for each row of docs.

    Kept columns of these names are an error; `out` gives others. Null and empty texts are scored as a bag of one empty passage. Passages of very long texts
    are held at once, some 200 bytes for each 64 words.
    """
    kept = docs.select(*keep)
    if clash := {c.lower() for c in kept.columns} & {c.lower() for c in out}:
        raise ValueError(f"kept columns with names of results: {sorted(clash)}")
    names = [*kept.columns, *out]
    kept = docs.select(*keep, F.col(text_col)).toDF(*[f"c{i}" for i in range(len(keep))], "text")
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for at, data, offsets in kernel.chunks(batch.column(batch.num_columns - 1)):
                p[at : at + len(offsets) - 1] = sent.value.scores(*features(data, offsets))
            yield pa.record_batch([*batch.columns[:-1], pa.array(p), pa.array((p >= accept).astype(np.int32))], names=schema.names)

    return kept.mapInArrow(run, schema).toDF(*names)
