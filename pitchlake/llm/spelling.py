"""Grouping spelling variants: words one edit apart, found by asymmetric chunks.

Of two words one edit apart, the shorter one (or the smaller of two equally long ones) is cut into
two disjoint chunks. The edit spares one of them, and the other word has that chunk as a gram: at
the same place if both are as long, at the same place or one further on if it is longer. So the
shorter word contributes its two chunks, the longer one its positional grams within that shift, and
an equality join finds every pair. Where too many words share a chunk, the part that is not yet known
to be equal is cut into two chunks again, and so on, until few words share a key; at the end of that a
key leaves one place open, and what shares it is one edit apart anyway. Each pair is then verified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel
from pitchlake.llm.components import chain_ends, spread_join
from pitchlake.llm.set_dedup import Tables
from pitchlake.llm.shared import cut_at

#: Fixed values of the query: every 199th (document, run) loses a code point; the least length and number of a word; a form has 5 times a word's number.
DROP, LEAST_CHARS, LEAST_N, TIMES = 199, 6, 5, 5
#: Pairs of words that may share a key before the key gets another chunk.
PAIRS = 4096

#: The bytes of A-Z, a-z and of U+00C0 to U+00FF, which are 0xC3 and one more byte.
_ASCII = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_MARKED = np.arange(256) == 1


def _run_mask(data: np.ndarray) -> np.ndarray:
    mask = _ASCII[data] | (data == 0xC3)
    mask[1:] |= data[:-1] == 0xC3
    return mask


@lru_cache(maxsize=1)
def _crc_byte() -> np.ndarray:
    """The checksum's state after one zero byte, by its lowest byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


@lru_cache(maxsize=128)
def _past(n: int) -> np.ndarray:
    """Four tables of 256: what each byte of a checksum becomes when n zero bytes follow."""
    if n == 0:
        return (np.arange(256, dtype=np.uint32)[None] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    before = _past(n - 1)
    return _crc_byte()[before & 255] ^ (before >> 8)


def followed_crc(head: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of heads with words behind them, from the crc32 of each and the words' bytes (up to 64)."""
    out = np.empty(len(head), np.uint32)
    for n in np.unique(size).tolist():
        rows, t = np.flatnonzero(size == n), _past(n)
        h = head[rows]
        out[rows] = t[0][h & 255] ^ t[1][h >> 8 & 255] ^ t[2][h >> 16 & 255] ^ t[3][h >> 24] ^ word[rows]
    return out


_WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def _runs(ids: list, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, int]:
    """How often each word of at least LEAST_CHARS code points results from a chunk of texts."""
    low = kernel.LOWER[data]
    starts, ends, first = kernel.word_bounds(_run_mask(low).astype(np.uint8), offsets, _MARKED)
    if not len(starts):
        return {}
    size = ends - starts
    owner = np.repeat(np.arange(len(ids)), np.diff(first))
    plain, bounds, _ = kernel.joined(low, starts, ends)
    kind, width = (pa.binary(), np.int32) if bounds[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    coded = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds.astype(width)), pa.py_buffer(plain)]).dictionary_encode()
    words = [w[:-1] for w in coded.dictionary.to_pylist()]  # each with the space behind it
    which = coded.indices.to_numpy()
    heads = [f"{'' if i is None else i}:".encode() for i in ids]
    head = np.array([zlib.crc32(h) for h in heads], np.uint32)
    crc = np.empty(len(starts), np.uint32)
    short = size <= 64
    crc[short] = followed_crc(head[owner[short]], np.array([zlib.crc32(w) for w in words], np.uint32)[which[short]], size[short])
    for i in np.flatnonzero(~short).tolist():
        crc[i] = zlib.crc32(words[which[i]], int(head[owner[i]]))
    hit = crc % DROP == 0
    counts = np.bincount(which[~hit], minlength=len(words))
    out = {w: n for w, n in zip(words, counts.tolist(), strict=True) if n and len(w) - w.count(0xC3) >= LEAST_CHARS}
    for i in np.flatnonzero(hit).tolist():
        run = words[which[i]].decode()
        at = int(crc[i]) % len(run)
        if len(run) > LEAST_CHARS:
            word = (run[:at] + run[at + 1 :]).encode()
            out[word] = out.get(word, 0) + 1
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of the words of all texts that occur at least least_n times.

    A task counts a chunk's words before they are shuffled. Null text has none; a null id counts as
    the empty text; repeated rows count as often as they are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, data, offsets in kernel.chunks(batch.column(1)):
                found = _runs(ids[at : at + len(offsets) - 1], data, offsets)
                yield pa.record_batch([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=_WORDS.names)

    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _WORDS)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _opened(words: DataFrame) -> DataFrame:
    """Each word as the shorter one (side 0) and as the longer one (side 1) of pairs of equal length (more 0) and not (more 1), all of it open."""
    roles = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(more).alias("more")) for side in (0, 1) for more in (0, 1)])
    rows = words.select("word", F.col("n").alias("times"), F.explode(roles).alias("r")).select("word", "times", "r.side", "r.more")
    size = F.length("word") - F.col("side") * F.col("more")
    return rows.select("*", size.alias("size"), F.lit(0).alias("low"), size.alias("high"))


def _chunked(rows: DataFrame) -> DataFrame:
    """Each row twice, the one or the other chunk of what was open now taken for equal, with a key of all that is.

    Places are the shorter word's; behind the edit the longer word's are one further on. Where one
    place is open and a code point is missing, that is before or behind it.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    behind = middle + F.when(F.col("high") - F.col("low") == 1, F.col("more")).otherwise(F.lit(0))
    halves = F.array(F.struct(behind.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high")))
    cut = rows.select("word", "times", "side", "more", "size", F.explode(halves).alias("o")).select("word", "times", "side", "more", "size", "o.low", "o.high")
    tail = F.col("word").substr(F.col("high") + 1 + F.col("side") * F.col("more"), F.length("word"))
    return cut.withColumn("key", F.xxhash64("size", "more", "low", "high", F.col("word").substr(F.lit(1), F.col("low")), tail))


def near_pairs(words: DataFrame, tables: Tables, pairs: int = PAIRS) -> DataFrame:
    """(word, n) -> (a, b, n_a, n_b): all pairs one inserted, deleted or replaced code point apart, once each.

    a is the shorter word, or the smaller one. A key that more than `pairs` pairs would share is cut
    again, until one place is open, so no key's group grows with the vocabulary. The last tables stay
    in `tables`.
    """
    found, rows = None, tables.cut(_chunked(_opened(words)))
    while True:
        count = lambda side: F.sum((F.col("side") == side).cast("long"))
        sides = rows.groupBy(F.col("key").alias("k")).agg(count(0).alias("c0"), count(1).alias("c1"), F.count("*").alias("n"), F.max(F.col("high") - F.col("low") + F.col("more")).alias("open"))
        sides = tables.cut(sides.filter("c0 > 0 and c1 > 0").select("k", "n", ((F.col("c0") * F.col("c1") > pairs) & (F.col("open") > 1)).alias("again")))
        met = tables.cut(spread_join(rows, sides, "key", "k", rows.count()).drop("k", "n"))
        few = met.filter("not again")
        a = few.filter("side = 0").select("key", F.col("word").alias("a"), F.col("times").alias("n_a"))
        b = few.filter("side = 1").select(F.col("key").alias("k"), "more", F.col("word").alias("b"), F.col("times").alias("n_b"))
        fits = (F.col("key") == F.col("k")) & ((F.col("more") == 1) | (F.col("a") < F.col("b")))
        near = a.join(b, fits).filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b")
        found = near if found is None else found.unionByName(near)
        many = met.filter("again")
        if many.isEmpty():
            return tables.cut(found.dropDuplicates(["a", "b"]))
        rows = tables.cut(_chunked(many))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n), each word once -> word, form, root, n, n_near, form_n.

    A word's form is its near word of the largest n (of equal ones the smallest by code point) if that
    is at least `times` the word's own, else null; root follows forms to the last and is the word
    itself without one. No words give no rows; words are not null. The result is a table in the shared
    folder, all others are removed.
    """
    tables = Tables()
    words = tables.cut(words)
    pairs = near_pairs(words, tables)
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(pairs.select(F.col("b").alias("w"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = both.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("least"), "other")).alias("top"))
    told = words.join(best, F.col("word") == F.col("w"), "left").withColumn("ok", -F.col("top.least") >= F.col("n") * times)
    told = tables.cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), F.col("top.other")).alias("form"), F.when(F.col("ok"), -F.col("top.least")).alias("form_n")))
    ends = chain_ends(told.filter("form is not null").select(F.col("word").alias("node"), F.col("form").alias("next"))).withColumnRenamed("node", "w")
    done, _ = cut_at(told.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    tables.remove()
    return done


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = LEAST_N, times: int = TIMES) -> DataFrame:
    """variants() of the vocabulary() of docs."""
    return variants(vocabulary(docs, id_col, text_col, least_n), times)
