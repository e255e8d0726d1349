"""Near-duplicates by the Jaccard similarity of word shingles, candidates by long SimHash fingerprints, links verified.

Each text is the set of its runs of set_dedup.SHINGLE lower-case words; sets that are equal collapse at
once. A bit of a set's fingerprint is 1 if it is set in over half of its shingles' hashes; two large sets
of similarity 0.8 differ in a bit with a chance DIFFER of 0.152. Every fingerprint is dealt to tables,
keyed by some of its bits, so many that two such sets share none of their keys with a chance of MISS.
Fingerprints of a key are compared by bit planes, as in simhash.py, over their first word, pairs that are
left over all COMPARED bits; chains of these make groups of sets. In a group all pairs are compared
exactly, chunk against chunk, and of their links a forest is kept: no row is ever made for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel, simhash
from pitchlake.llm.components import components, spread_join
from pitchlake.llm.set_dedup import SHARE, Tables, set_hashes, shingle_sets, texts_of, without

#: Chance that a bit of two large sets at SHARE differs: the angle between them by pi; chance that they share no key.
DIFFER, MISS = 0.1515, 1e-7
#: Bits of a fingerprint, at most and compared; bits of the first 64, and of those compared, that differ in a candidate at most.
BITS, COMPARED, FIRST_RADIUS, RADIUS = 1024, 256, 26, 75
#: Bits of a key, at least, and more as long as a key has over PER_KEY fingerprints in expectation.
LEAST, MOST, PER_KEY = 8, 20, 256
#: Fingerprints of one key, sets of one group and shingles of all these that one task compares with as many others.
TILE, TOGETHER, MOST_TOGETHER, SHINGLES = 2048, 100, 4096, 1 << 19
#: Fingerprints of a key that share planes with other keys, and of all these; a key with more has planes of its own.
PACKED, ROWS = 1024, 1 << 17
#: Larger groups make no more chunks than this until these have MOST_TOGETHER sets.
CHUNKS = 16

_WORDS = [f"w{i}" for i in range(COMPARED // 64)]
_SEEDS = np.random.default_rng(7).integers(0, 1 << 64, BITS // 64, np.uint64)
_PRINT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.IntegerType())), *[T.StructField(w, T.LongType()) for w in _WORDS]])
_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def key_bits(n: int) -> int:
    """How many bits a key has for n fingerprints."""
    return next((k for k in range(LEAST, MOST) if n <= PER_KEY << k), MOST)


@lru_cache(maxsize=4)
def tables_of(bits: int) -> np.ndarray:
    """The positions of each table's key bits, a row for each table. No position is used again before all others are."""
    many = ceil(log(1 / MISS) / (1 - DIFFER) ** bits)
    rng = np.random.default_rng(bits)
    width = min(BITS, -(-many * bits // 64) * 64)
    drawn = [rng.permutation(width) for _ in range(-(-many * bits // width))]
    return np.concatenate(drawn)[: many * bits].reshape(many, bits)


def fingerprints(h: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits of each set, as rows of bytes that are 0 or 1; an empty set's are 0.

    Eight bits at a time are added up in the bytes of a word, over 255 shingles at most.
    """
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    out = np.zeros((len(size), 64 * words), np.uint8)
    if not len(full):
        return out
    parts = -(-size[full] // 255)
    own = np.concatenate([[0], np.cumsum(parts)])[:-1]
    starts = np.repeat(bounds[full], parts) + 255 * (np.arange(parts.sum()) - np.repeat(own, parts))
    half = size[full][:, None]
    for w in range(words):
        x = kernel.mix(h ^ _SEEDS[w])
        for b in range(8):
            lanes = np.add.reduceat((x >> np.uint64(b)) & np.uint64(0x0101010101010101), starts)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), own, axis=0)
            out[full, 64 * w + 8 * b : 64 * w + 8 * b + 8] = 2 * ones > half
    return out


def prints(docs: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n, keys, w0 ...) of every row of docs: its set's hash, size, a key of each table and bits to compare."""
    places = tables_of(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in kernel.chunks(batch.column(1)):
                h, bounds = shingle_sets(data, offsets)
                found = fingerprints(h, bounds, max(COMPARED, int(places.max()) + 1) // -64 * -1)
                keys = np.stack([(found[:, p].astype(np.int32) << np.arange(bits, dtype=np.int32)).sum(axis=1) | t << bits for t, p in enumerate(places)], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * len(places)), pa.array(keys.ravel()))
                compared = np.packbits(found[:, :COMPARED], axis=1, bitorder="little").view(np.int64)
                own = [batch.slice(at, len(keys)).column(0), pa.array(set_hashes(h, bounds).view(np.int64)), pa.array(np.diff(bounds)), lists]
                yield pa.record_batch([*own, *[pa.array(np.ascontiguousarray(c)) for c in compared.T]], names=_PRINT.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PRINT)


class Forest:
    """Which of n rows are joined, and the pairs that joined them."""

    def __init__(self, n: int):
        self.root, self.kept = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            new = x != y
            if not new.any():
                return
            a, b = a[new], b[new]
            low, high = np.minimum(x, y)[new], np.maximum(x, y)[new]
            hook, first = np.unique(high, return_index=True)  # every root goes to one smaller root, so there are no circles
            self.root[hook] = low[first]
            self.kept.append(np.stack([a[first], b[first]]))
            while not np.array_equal(self.root, up := self.root[self.root]):
                self.root = up

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([np.zeros((2, 0), np.int64), *self.kept], axis=1)
        return both[0], both[1]


def near(words: np.ndarray, size: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the rows of `words` that differ in at most RADIUS bits inside groups of these sizes.

    second: of one group; rows where it is true meet only the others, and no others meet.
    """
    forest, held, columns = Forest(len(words)), [], np.ascontiguousarray(words.T)

    def join() -> None:
        if held:
            forest.join(*np.concatenate(held, axis=1))
            held.clear()

    def keep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Takes the pairs that all bits let stay; none is left to return."""
        at = np.flatnonzero(forest.root[a] != forest.root[b])
        x, y = a[at], b[at]
        apart = np.zeros(len(at), np.uint16)
        for word in columns:
            apart += np.bitwise_count(word[x] ^ word[y])
        fit = apart <= RADIUS
        held.append(np.stack([x[fit], y[fit]]))
        if sum(h.shape[1] for h in held) > 20_000:
            join()
        return np.zeros(len(a), bool)

    if len(size) == 1 and size[0] > PACKED or second is not None:
        queries = np.flatnonzero(~second) if second is not None else np.arange(len(words))
        others = np.flatnonzero(second) if second is not None else queries
        for at in range(0, len(queries), 128):
            some, rest = queries[at : at + 128], others if second is not None else others[at:]
            i, j = simhash.within(words[some, 0], words[rest, 0], FIRST_RADIUS)
            keep(some[i], rest[j])
    else:
        simhash.side_by_side(words[:, 0], size, FIRST_RADIUS, keep)
    join()
    return forest.pairs()


def linked(sets: list[np.ndarray], second: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the sets whose similarity reaches `share`; second: rows where it is true meet only the others, and no others meet. Every pair that is not joined yet is compared."""
    forest, size = Forest(len(sets)), np.array([len(s) for s in sets])
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(many > 1) - 1
    here = many[at] > 1  # a shingle of one set alone is in no intersection
    shape = len(sets), int((many > 1).sum()) // 64 + 1
    bits = np.zeros((shape[0], shape[1] * 64), bool)
    bits[np.repeat(np.arange(len(sets)), size)[here], column[at[here]]] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    split = second.any()
    for i in np.flatnonzero(~second) if split else range(len(sets)):
        j = np.flatnonzero((second if split else np.arange(len(sets)) > i) & (forest.root != forest.root[i]))
        j = j[np.minimum(size[i], size[j]) * share[1] >= np.maximum(size[i], size[j]) * share[0]]
        common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        j = j[share[1] * common >= share[0] * (size[i] + size[j] - common)]
        forest.join(np.full(len(j), i), j)
    return forest.pairs()


def tiles(rows: DataFrame, key: str, chunks: str, by: str) -> DataFrame:
    """rows once for each two chunks of its key that they are part of, with __i, __j and __second (part of __j, not __i).

    chunks: how many the row's key has. by: what deals rows to these.
    """
    own = F.pmod(F.xxhash64(by), F.col(chunks)).cast("int")
    met = rows.withColumn("__own", own).withColumn("__with", F.explode(F.sequence(F.lit(0), F.col(chunks) - 1)))
    met = met.withColumns({"__i": F.least("__own", "__with"), "__j": F.greatest("__own", "__with"), "__second": F.col("__own") > F.col("__with")})
    at = [key, "__i", "__j"]
    return met.drop("__own", "__with", chunks).repartition(*at).sortWithinPartitions(*at)


def whole(tile: pa.RecordBatch) -> bool:
    """Whether a tile is of one chunk, whose rows all meet."""
    return tile.column(1)[0].as_py() == tile.column(2)[0].as_py()


def in_groups(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[pa.RecordBatch]:
    """Batches of tiles(), which are in the order of their first `of` columns -> a batch for each tile that has pairs."""
    held: list[pa.RecordBatch] = []
    last = None

    def done() -> Iterator[pa.RecordBatch]:
        """The tile that is held, if it has pairs."""
        tile = pa.concat_batches(held) if len(held) > 1 else held[0]
        if tile.num_rows > 1 and (whole(tile) or len(tile.column(3).unique()) > 1):
            yield tile

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(of)])
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(keys[:, a].tolist())
            if held and now != last:
                yield from done()
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield from done()


def candidates(sets: DataFrame) -> DataFrame:
    """(keys, w0 ...) of different sets -> edges (a, b) of name_of() that join what candidates join."""
    dealt = sets.select(F.explode("keys").alias("key"), *_WORDS)
    large = dealt.groupBy(F.col("key").alias("k2")).agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    large = large.select("k2", F.ceil(F.col("n") / TILE).cast("int").alias("m"))
    rows = dealt.join(F.broadcast(large), F.col("key") == F.col("k2"), "left").select("key", *_WORDS, F.coalesce("m", F.lit(1)).alias("chunks"))
    rows = tiles(rows, "key", "chunks", _WORDS[0]).select("key", "__i", "__j", "__second", *_WORDS)

    def compare(groups: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        tile = pa.concat_batches(groups)
        words = np.stack([tile.column(c).to_numpy() for c in range(4, 4 + len(_WORDS))], axis=1).view(np.uint64)
        second = tile.column(3).to_numpy(zero_copy_only=False)
        a, b = near(words, np.array([g.num_rows for g in groups]), second if second.any() else None)
        names = names_of(words)
        return names[a], names[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[pa.RecordBatch] = []
        rows = 0
        for tile in in_groups(batches, 3):
            if tile.num_rows > PACKED or not whole(tile):
                yield pa.record_batch(list(map(pa.array, compare([tile]))), names=_EDGE.names)
            else:
                small.append(tile)
                rows += tile.num_rows
            if rows > ROWS:
                yield pa.record_batch(list(map(pa.array, compare(sorted(small, key=len)))), names=_EDGE.names)
                small, rows = [], 0
        if small:
            yield pa.record_batch(list(map(pa.array, compare(sorted(small, key=len)))), names=_EDGE.names)

    return rows.mapInArrow(run, _EDGE).filter("a <> b").distinct()


def names_of(words: np.ndarray) -> np.ndarray:
    """One number for each fingerprint; sets that share it are candidates."""
    with np.errstate(over="ignore"):
        name = np.zeros(len(words), np.uint64)
        for w in range(words.shape[1]):
            name = kernel.mix(name * np.uint64(0xD6E8FEB86659FD93) + words[:, w])
    return name.view(np.int64)


def named(sets: DataFrame) -> DataFrame:
    """sets without their keys and words, with names_of() as `name`."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("fp", "n", "name")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(c).to_numpy() for c in range(2, 2 + len(_WORDS))], axis=1).view(np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names_of(words))], names=schema.names)

    return sets.select("fp", "n", *_WORDS).mapInArrow(run, schema)


def links(marked: DataFrame, docs: DataFrame, tables: Tables, text_col: str = "text") -> DataFrame:
    """prints() of docs -> edges (a, b) of set hashes that join exactly what links inside groups of candidates join."""
    sets = tables.cut(marked.filter("n > 0").select("fp", "n", "keys", *_WORDS).dropDuplicates(["fp"]))
    found = components(tables.cut(candidates(sets)))
    grouped = tables.cut(named(sets).join(found, F.col("name") == F.col("node"), "left").select("fp", F.col("n").alias("shingles"), F.coalesce("root", "name").alias("root")))
    sizes = tables.cut(grouped.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n"), F.sum("shingles").alias("of_all")).filter("n > 1"))
    many = F.greatest(F.least(F.ceil(F.col("n") / TOGETHER), F.lit(CHUNKS)), F.ceil(F.col("n") / MOST_TOGETHER), F.ceil(F.col("of_all") / SHINGLES)).cast("int")
    members = tables.cut(spread_join(grouped, sizes, "root", "r", grouped.count()).select("root", F.col("fp").alias("w"), many.alias("chunks")))
    texts = tables.cut(texts_of(docs, members.select("w"), text_col))
    rows = tiles(texts.join(members, F.col("fp") == F.col("w")).select("root", "fp", "text", "chunks"), "root", "chunks", "fp").select("root", "__i", "__j", "__second", "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in in_groups(batches, 3):
            fp, second = tile.column(4).to_numpy(), tile.column(3).to_numpy(zero_copy_only=False)
            sets = []
            for _, data, offsets in kernel.chunks(tile.column(5)):
                h, bounds = shingle_sets(data, offsets)
                sets += [h[p:q] for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(fp[x]) for x in linked(sets, second)], names=_EDGE.names)

    return tables.cut(rows.mapInArrow(run, _EDGE).distinct())


def groups_of(docs: DataFrame, id_col: str, text_col: str, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """((fp, least, component_id) of each distinct set: the smallest id that has it and that of its group, prints() of docs).

    Both last until tables.remove(). Texts without words, null ones too, are one set. Null ids are no set's or
    group's name, unless it has no other.
    """
    marked = tables.cut(prints(docs, key_bits(docs.count()), id_col, text_col))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labelled = tables.cut(classes.join(components(links(marked, docs, tables, text_col)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    of_root = labelled.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return tables.cut(spread_join(labelled, of_root, "root", "r", labelled.count()).select("fp", "least", "component_id")), marked


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of a group; ids as in set_dedup.representatives()."""
    tables = Tables()
    return without(docs, *groups_of(docs, id_col, text_col, tables), tables, id_col)
