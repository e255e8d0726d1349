"""Benchmark decontamination by spaced seeds.

A fixed mask reads some words of a window and ignores the others. Hashes of the benchmark's
windows are joined with those of the documents' windows; around each hit, document and item are
laid over each other and compared word by word, so that substituted words do not hide a copy.

An overlap is a run of WINDOW words, or a whole shorter item, of which SHARE agree. For each number
of words the masks are such that one of them fits between any substitutions that this allows, so no
overlap is lost. Items of fewer than LEAST_WORDS words, which are found in any text, overlap only
a document that has these words and no others.

Words are runs of ASCII letters, digits and non-ASCII characters; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel
from pitchlake.llm.shared import cut

#: Word positions that count. Whichever 2 of 13 words are substituted, a mask still fits between.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
#: An overlap is a run of WINDOW words (or a whole shorter item) of which SHARE agree.
WINDOW, SHARE = 13, 0.8
#: Items of fewer words overlap only documents that consist of just these words.
LEAST_WORDS = 5
#: Bits of the filter for each seed, places that a seed sets, and bits of the filter at most.
FILTER_BITS, FILTER_PLACES, FILTER_MOST = 64, 8, 1 << 27
#: Rows of the benchmark that are broadcast, at most, and their bytes; more are joined by a shuffle, in SALTS copies.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 500_000, 32 << 20, 8

HIT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal")]
)
_SEED = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("seed", T.LongType()), T.StructField("item_at", T.LongType()), T.StructField("places", T.ArrayType(T.LongType()))])
_MARKED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("seed", T.LongType()), T.StructField("at", T.LongType())])))])


@lru_cache
def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks for items of n words (n = WINDOW: of that or more).

    Of a short item the words are dealt to blocks, one or two more than words may be substituted, and
    each mask leaves out as many blocks as that: whichever are substituted, a mask has none of them.
    """
    if n >= WINDOW:
        return MASKS
    spare = n - ceil(SHARE * n)
    if not spare:
        return (tuple(range(n)),)
    edges = [round(i * n / (spare + 2)) for i in range(spare + 3)]
    blocks = [range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return tuple(tuple(sorted(set(range(n)) - {i for b in out for i in b})) for out in combinations(blocks, spare))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = kernel.LOWER[data]
    starts, ends, first = kernel.word_bounds(data, offsets, kernel.ALNUM)
    return kernel.word_hashes(data, starts, ends), first


def seeds(h: np.ndarray, first: np.ndarray, sizes: Sequence[int], items: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, seeds) for each mask of each of the item sizes (WINDOW: that or more) over texts in a row.

    items: the texts are benchmark items, and each has the masks of its own size only.
    """
    n_words = np.diff(first)
    for n in sizes:
        for number, mask in enumerate(masks_for(n)):
            span = mask[-1] + 1 if n >= WINDOW else n
            if len(h) < span:
                continue
            ok = kernel.in_texts(first, span)
            at = np.flatnonzero(ok)
            if items or n < LEAST_WORDS:
                of = n_words[np.searchsorted(first, at, "right") - 1]
                at = at[of >= n if n >= WINDOW else of == n]
            with np.errstate(over="ignore"):
                out = np.full(len(at), n * 64 + number, np.uint64)
                for j in mask:
                    out = kernel.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at + j])
            yield at, out


def place(seed: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each seed in a filter of so many bits, a power of two."""
    with np.errstate(over="ignore"):
        return ((seed + np.uint64(k) * (kernel.mix(seed) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


class Benchmark:
    """A benchmark's items as DataFrames of words and of seeds, the sizes of items and the filter of their seeds."""

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
        spark = benchmark.sparkSession
        self.items = cut(benchmark.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("item")).distinct())
        sizes = T.StructType([T.StructField("n", T.LongType())])

        def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, data, offsets in kernel.chunks(batch.column(0)):
                    yield pa.record_batch([pa.array(np.minimum(np.diff(_words(data, offsets)[1]), WINDOW))], names=["n"])

        # At most WINDOW + 1 numbers.
        self.sizes = sorted(r["n"] for r in self.items.select("item").mapInArrow(lengths, sizes).distinct().collect() if r["n"])

        def rows(batches: Iterator[pa.RecordBatch], bits: int, own=tuple(self.sizes)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for base, data, offsets in kernel.chunks(batch.column(1)):
                    h, first = _words(data, offsets)
                    for at, seed in seeds(h, first, own, True):
                        item = np.searchsorted(first, at, "right") - 1
                        put = np.stack([place(seed, k, bits) for k in range(FILTER_PLACES)], 1) if bits else np.zeros((len(at), 0), np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * put.shape[1]), pa.array(put.ravel()))
                        yield pa.record_batch([pa.array(ids[base + item]), pa.array(seed.view(np.int64)), pa.array(at - first[item]), lists], names=_SEED.names)

        source = self.items.select("item_id", "item")
        self.seeds = cut(source.mapInArrow(lambda b: rows(b, 0), _SEED).drop("places"))
        self.n_seeds = self.seeds.count()
        self.bits = min(FILTER_MOST, 1 << max(12, (FILTER_BITS * self.n_seeds).bit_length()))
        # One number for each 64 bits of the filter, so at most FILTER_MOST / 64 of them reach the driver.
        at = source.mapInArrow(lambda b, bits=self.bits: rows(b, bits), _SEED).select(F.explode("places").alias("p"))
        one = F.expr("shiftleft(1L, cast(p & 63 as int))")
        words = at.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
        kept = np.zeros(self.bits // 64, np.int64)
        kept[words.column("w").to_numpy()] = words.column("b").to_numpy()
        self.filter = spark.sparkContext.broadcast(kept.view(np.uint64))

    def marked(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(uid, doc_id, key, text, hits) of the documents with a seed that passes the filter; key is the text's MD5."""
        sent, bits, sizes = self.filter, self.bits, tuple(self.sizes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for base, data, offsets in kernel.chunks(batch.column(1)):
                    h, first = _words(data, offsets)
                    passed, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                    for at, seed in seeds(h, first, sizes, False):
                        for k in range(FILTER_PLACES):
                            p = place(seed, k, bits)
                            ok = (sent.value[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                            at, seed = at[ok], seed[ok]
                        passed.append(at), found.append(seed)
                    at, seed = np.concatenate(passed), np.concatenate(found)
                    if not len(at):
                        continue
                    text = np.searchsorted(first, at, "right") - 1
                    order = np.argsort(text, kind="stable")
                    at, seed, text = at[order], seed[order], text[order]
                    some = np.unique(text)
                    bounds = pa.array(np.append(np.searchsorted(text, some), len(text)).astype(np.int32))
                    hits = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array(at - first[text])], ["seed", "at"])
                    rows = batch.take(pa.array(base + some))
                    yield pa.record_batch([*rows.columns, pa.ListArray.from_arrays(bounds, hits)], names=_MARKED.names)

        rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return cut(rows.mapInArrow(run, _MARKED).withColumns({"uid": F.monotonically_increasing_id(), "key": F.md5(F.col("text").cast("binary"))}))

    def found(self, marked: DataFrame) -> DataFrame:
        """marked() -> (doc_id, key, item_id, doc_word, item_word, n_words, n_equal): the longest overlap for each uid and item."""
        hits = marked.select("uid", F.explode("hits").alias("hit")).select("uid", F.col("hit.seed").alias("own"), F.col("hit.at").alias("doc_at"))
        met = _spread(hits, self.seeds, F.col("own") == F.col("seed"), self.n_seeds, 24 * self.n_seeds)
        pairs = met.groupBy("uid", F.col("item_id").alias("of")).agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("diagonals"))
        n_items, size = self.items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).head()
        pairs = _spread(pairs, self.items, F.col("of") == F.col("item_id"), n_items, size)
        by_text = pairs.groupBy("uid").agg(F.collect_list(F.struct("item_id", "item", "diagonals")).alias("pairs"))
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.StringType()), *HIT.fields[1:]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc_id, key, text, rows in zip(*batch.columns, strict=True):
                    h = _words(*kernel.text_bytes(pa.array([text.as_py()])))[0]
                    best: dict[int, tuple[int, int, int, int]] = {}
                    for r in rows.as_py():
                        item, i = _words(*kernel.text_bytes(pa.array([r["item"]])))[0], r["item_id"]
                        for diagonal in r["diagonals"]:
                            o = overlap(h, item, diagonal)
                            if o and (i not in best or (o[3], -o[0], o[2]) > (best[i][3], -best[i][0], best[i][2])):
                                best[i] = o
                    out += [(doc_id.as_py(), key.as_py(), i, *o) for i, o in sorted(best.items())]
                columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
                yield pa.record_batch([pa.array(c, pa.string() if f.name == "key" else pa.int64()) for c, f in zip(columns, schema, strict=True)], names=schema.names)

        texts = marked.select("uid", "doc_id", "key", "text").join(by_text, "uid")
        return texts.select("doc_id", "key", "text", "pairs").mapInArrow(run, schema)


def _spread(rows: DataFrame, bench: DataFrame, on: F.Column, n: int, size: int) -> DataFrame:
    """Inner join with a table of the benchmark of n rows and `size` bytes.

    A small one is broadcast. Of a larger one SALTS copies are made, so that rows of one frequent
    seed or item go to as many tasks.
    """
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(bench), on)
    copies = bench.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(copies, on & (F.col("__salt") == F.col("__copy"))).drop("__salt", "__copy")


def overlap(h: np.ndarray, own: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(first word in the document, in the item, words, equal words) of the overlap of a document's and an item's words, if any.

    diagonal: the document's word that lies over the item's first one.
    """
    low, high = max(0, -diagonal), min(len(own), len(h) - diagonal)
    n = min(WINDOW, len(own))
    if high - low < n or (len(own) < LEAST_WORDS and len(h) != len(own)):
        return None
    same = h[low + diagonal : high + diagonal] == own[low:high]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[n:] - sums[:-n] >= SHARE * n)
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + n
    return low + a + diagonal, low + a, b - a, int(sums[b] - sums[a])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs and benchmark item that it overlaps, with the longest overlap.

    doc_id, item_id, doc_word, item_word (first words of the overlap, from 0), n_words, n_equal.
    Null or wordless texts and items overlap nothing; rows with equal ids are judged each by itself;
    repeated items count once; an empty benchmark or corpus gives no row. Ids must be whole numbers:
    others are cast, and what cannot be cast is null (items without id are left out). Other columns
    are not read. The benchmark's seeds meet the corpus in a filter of bounded size first; documents
    that pass it, and no others, are written and joined.
    """
    bench = Benchmark(benchmark)
    return bench.found(bench.marked(docs, id_col, text_col)).drop("key")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text overlaps no item of the benchmark; null texts stay."""
    bench = Benchmark(benchmark)
    hit = cut(bench.found(bench.marked(docs.withColumn("__no_id", F.lit(0)), "__no_id", text_col)).select(F.col("key").alias("__hit")).distinct())
    return docs.join(hit, F.md5(F.col(text_col).cast("binary")) == F.col("__hit"), "left_anti")
