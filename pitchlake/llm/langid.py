"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: how often each byte followed each context of up to
ORDER bytes in its training text. A byte's code length is that of the longest context that knows
it, behind the escapes of the longer ones (method C: a context seen t times with d different
bytes escapes with probability d / (t + d)); below order 0 all 256 bytes are equal. Statistics
are frozen before scoring, so a text's code length is exact and does not depend on other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel

ORDER = 3
#: Bytes of training text over all languages, in expectation; what each gets at least; different texts of each, at least. See train().
SAMPLE_BYTES, LEAST_BYTES, LEAST_TEXTS = 4 << 20, 256 << 10, 32
UNKNOWN = "und"

_GRAMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, itself and the ORDER bytes before it, in a uint32; texts are preceded by line feeds."""
    padded = np.full(len(data), 10, np.uint32)
    out = data.astype(np.uint32)
    starts = np.minimum(offsets[:-1][np.diff(offsets) > 0], max(0, len(data) - 1))
    for k in range(1, ORDER + 1):
        padded[k:] = data[:-k]
        padded[:k] = 10
        for j in range(k):  # what lies before a text is not its context
            at = starts + j
            padded[at[at < np.append(starts[1:], len(data))[: len(at)]]] = 10
        out |= padded << np.uint32(8 * k)
    return out


class Model:
    """Code lengths of grams by language, from sorted count tables."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.trees = [self._tree(*c) for c in counts]

    @staticmethod
    def _tree(gram: np.ndarray, n: np.ndarray) -> list[tuple]:
        """By order: sorted (context + byte) keys with counts; sorted contexts with total and different bytes."""
        tree = []
        for order in range(ORDER + 1):
            key, inverse = np.unique(gram & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(inverse, n).astype(np.float64)
            context, inverse = np.unique(key >> np.uint32(8), return_inverse=True)
            # Contexts of this order keep their bytes in place: the last byte of the key is the predicted one.
            tree.append((key, count, context, np.bincount(inverse, count), np.bincount(inverse).astype(np.float64)))
        return tree

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte behind the bytes before it: one column for each language."""
        out = np.zeros((len(gram), len(self.languages)))
        for column, tree in enumerate(self.trees):
            bits, todo = np.zeros(len(gram)), np.ones(len(gram), bool)
            for order in range(ORDER, -1, -1):
                key, count, context, total, kinds = tree[order]
                if not len(key):
                    continue
                own = gram & np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else gram
                c = np.minimum(np.searchsorted(context, own >> np.uint32(8)), len(context) - 1)
                seen = todo & (context[c] == own >> np.uint32(8))
                k = np.minimum(np.searchsorted(key, own), len(key) - 1)
                known = seen & (key[k] == own)
                bits[known] -= np.log2(count[k[known]] / (total[c[known]] + kinds[c[known]]))
                escaped = seen & ~known
                bits[escaped] -= np.log2(kinds[c[escaped]] / (total[c[escaped]] + kinds[c[escaped]]))
                todo &= ~known
            bits[todo] += 8
            out[:, column] = bits
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            distinct, inverse = np.unique(grams(data, offsets), return_inverse=True)
            bits = self.lengths(distinct)
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(bits[:, k][inverse], offsets[:-1][full])
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from rows with text and language.

    All rows count when a language's share of texts to read is set. Its different texts are read
    whole and chosen by a hash of the text, so that about sample_bytes / languages bytes of each
    language are read, LEAST_BYTES and LEAST_TEXTS texts at least in expectation; of a language with
    fewer different texts all are. A text counts once, however many rows have it. Sums of counts are
    made in Spark; what reaches the driver has at most as many rows as the sample has bytes. No
    rows: a model without languages.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    hashed = rows.withColumn("h", F.xxhash64("text"))
    found = hashed.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.approx_count_distinct("h").alias("texts")).filter("n > 0").collect()
    if not found:
        return Model([], [])
    each = max(LEAST_BYTES, sample_bytes / len(found)) if sample_bytes >= LEAST_BYTES else sample_bytes / len(found)
    share = {r["lang"]: min(1.0, max(each / r["n"], LEAST_TEXTS / max(1, r["texts"]))) for r in sorted(found)}
    # 62 bits of the hash against the share, so that it may be as small as it needs to be.
    most = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 62)))]), F.col("lang"))
    chosen = hashed.filter(F.col("lang").isin(list(share)) & (F.shiftrightunsigned("h", 2) <= most)).groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_numpy(zero_copy_only=False)
            for lang in sorted(set(names)):
                texts = batch.column(0).filter(pa.array(names == lang))
                for _, data, offsets in kernel.chunks(texts):
                    gram, n = np.unique(grams(data, offsets), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=_GRAMS.names)

    counted = chosen.mapInArrow(count, _GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = counted.column("lang").to_numpy()
    gram, n = counted.column("gram").to_numpy().astype(np.uint32), counted.column("n").to_numpy()
    languages = [k for k in share if (names == k).any()]
    return Model(languages, [(gram[names == k], n[names == k]) for k in languages])


_SCORED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score and bits_per_byte for each row of docs; kept columns of these names are an error.

    The language with the shortest code, the first by name among equals; its posterior
    probability under equal priors is the score. Null text, or text without any letter, gives
    'und' with score 0; so does every text if the model has no language.
    """
    kept = docs.select(*keep)
    if clash := {c.lower() for c in kept.columns} & set(_SCORED.names):
        raise ValueError(f"kept columns with names of results: {sorted(clash)}")
    names = [*kept.columns, *_SCORED.names]
    kept = docs.select(*keep, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))).toDF(*[f"c{i}" for i in range(len(keep))], "text")
    schema = T.StructType([*kept.schema.fields[:-1], *_SCORED.fields])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            size = np.zeros(batch.num_rows, np.int64)
            bits = np.zeros((batch.num_rows, max(1, len(model.languages))))
            for at, data, offsets in kernel.chunks(text):
                size[at : at + len(offsets) - 1] = np.diff(offsets)
                if model.languages:
                    bits[at : at + len(offsets) - 1] = model.code_lengths(data, offsets)
            best = bits.argmin(1)
            least = bits[np.arange(len(bits)), best]
            p = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(1)
            none = (size == 0) | (not model.languages)
            best[none], p[none] = len(model.languages), 0.0
            per_byte = np.where(none, 0.0, least / np.maximum(size, 1))
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(p), pa.array(per_byte)], names=schema.names
            )

    return kept.mapInArrow(score, schema).toDF(*names)
