"""SimHash near-duplicates, compared by bit slices.

Fingerprints are 64 bits. Two at a distance of at most RADIUS = 4 agree on at least B - 4 of B bit
blocks, so each fingerprint is dealt to a table for each choice of B - 4 blocks, keyed by these, and
every link shows up in one of them. Fingerprints that meet are stored as vertical bit planes: one
word holds the same bit of 64 fingerprints. Many keys' fingerprints stand in the same planes, one
behind the other, and are laid over themselves, shifted; a large key's are laid over each of its
own. Carry-save counters add up the differing bits of 64 pairs at once, and a block of 64 pairs is
left as soon as all of it is beyond the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel
from pitchlake.llm.components import components, spread_join
from pitchlake.llm.shared import cut

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bit blocks: the fewest for which a key has, in expectation, at most PER_KEY fingerprints. More blocks, more tables.
LEAST_BLOCKS, MOST_BLOCKS, PER_KEY = 6, 12, 64
#: Fingerprints of one key in one row of work; larger keys are compared tile by tile.
TILE = 2048
#: Fingerprints of a key that share planes with other keys; more have planes of their own.
PACKED = 64


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The plain form of simhashes(), for one text's lower-case words."""
    n = max(1, len(words) - shingle + 1) if words else 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def simhashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, as uint64; 0 for texts without words."""
    data = kernel.LOWER[data]
    starts, ends, first = kernel.word_bounds(data, offsets)
    out = np.zeros(len(first) - 1, np.uint64)
    if not len(starts):
        return out
    text, put, size = kernel.joined(data, starts, ends)
    digest = xxhash.xxh64_intdigest
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(1, n_words - shingle + 1), 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    last = np.minimum(at + shingle, np.repeat(first[1:], n)) - 1
    low, high = put[at].tolist(), (put[last] + size[last]).tolist()
    h = np.fromiter((digest(text[a:b], seed) for a, b in zip(low, high, strict=True)), np.uint64, len(low))
    full = np.flatnonzero(n)
    bounds = (np.cumsum(n) - n)[full]
    bits = np.zeros(len(full), np.uint64)
    for b in range(64):
        ones = np.add.reduceat((h >> np.uint64(b)) & np.uint64(1), bounds)
        bits |= (2 * ones > n[full].astype(np.uint64)).astype(np.uint64) << np.uint64(b)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row of docs; fp is the fingerprint's 64 bits as a signed long. Null text has no words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhashes(data, offsets) for _, data, offsets in kernel.chunks(batch.column(1))]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """How many bit blocks n different fingerprints need; every number of them finds all links."""
    fits = (b for b in range(radius + LEAST_BLOCKS - RADIUS, radius + MOST_BLOCKS - RADIUS) if n <= PER_KEY << (64 * (b - radius) // b))
    return next(fits, radius + MOST_BLOCKS - RADIUS)


def block_masks(blocks: int = LEAST_BLOCKS) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def keys(blocks: int = LEAST_BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits that each table's key keeps: all choices of blocks - radius blocks."""
    masks = block_masks(blocks)
    return [sum(c) for c in combinations(masks, blocks - radius)]


def planes(fp: np.ndarray) -> np.ndarray:
    """64 rows, one for each bit; each row holds that bit of 64 fingerprints in a word."""
    padded = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def at_most(difference: Callable[[int, np.ndarray], np.ndarray], asked: np.ndarray, radius: int) -> np.ndarray:
    """For each block of 64 pairs a word of bits: which of the asked pairs differ in at most radius bits.

    difference(b, live) gives, for the blocks `live`, the word of differences in bit b. Counters of
    0 to radius are kept bit-sliced; what overflows stays in `beyond`. Bits are added three at a
    time by carry-save adders. Every 16 bits, blocks all of whose pairs are beyond are dropped.
    """
    out = np.zeros(len(asked), np.uint64)
    live = np.flatnonzero(asked)
    beyond = ~asked[live]
    width = radius.bit_length()
    low = [np.zeros_like(beyond) for _ in range(width)]

    def add(bit: np.ndarray, at: int) -> None:
        nonlocal beyond
        for k in range(at, width):
            low[k], bit = low[k] ^ bit, low[k] & bit
        beyond = beyond | bit

    def over() -> np.ndarray:
        """Where the counters are above radius."""
        above, equal = np.zeros_like(beyond), np.full_like(beyond, _ONES)
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                equal = equal & low[k]
            else:
                above |= equal & low[k]
                equal = equal & ~low[k]
        return above

    for start in range(0, 64, 16):
        d = [difference(b, live) for b in range(start, start + 16)]
        for k in range(0, 15, 3):
            x, y, z = d[k : k + 3]
            u = x ^ y
            add(u ^ z, 0)
            add((x & y) | (u & z), 1)
        add(d[15], 0)
        beyond = beyond | over()
        keep = beyond != _ONES
        live, beyond, low = live[keep], beyond[keep], [x[keep] for x in low]
        if not len(live):
            return out
    out[live] = ~beyond
    return out


def _bits(words: np.ndarray) -> np.ndarray:
    """Positions of the bits that are set."""
    some = np.flatnonzero(words)
    word, bit = np.nonzero(np.unpackbits(words[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[word] * 64 + bit


def within(queries: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of a query and one of fp that differ in at most radius bits."""
    stored = planes(fp)
    words = stored.shape[1]
    flip = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), _ONES, np.uint64(0))
    asked = np.full(words, _ONES)
    if len(fp) % 64:
        asked[-1] = np.uint64((1 << len(fp) % 64) - 1)
    found = at_most(lambda b, live: stored[b, live % words] ^ flip[live // words, b], np.tile(asked, len(queries)), radius)
    at = _bits(found)
    return at // (64 * words), at % (64 * words)


def side_by_side(fp: np.ndarray, size: np.ndarray, radius: int = RADIUS, also: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs inside groups of fp that differ in at most radius bits; size: of each group.

    also: which of the pairs (i, j) that it is given, some at a time, are to be kept.

    All groups stand in the same planes; the planes shifted by d lay each fingerprint over the
    d-th one behind it, and pairs of two groups are masked.
    """
    most = int(size.max(initial=1))
    stored = np.pad(planes(fp), ((0, 0), (0, most // 64 + 1)))
    words = -(-len(fp) // 64)
    behind = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(fp))
    first, second = [], []
    for d in range(1, most):
        mask = np.zeros(words * 64, bool)
        mask[: len(fp)] = behind >= d
        asked = np.packbits(mask, bitorder="little").view(np.uint64)
        over, bit = divmod(d, 64)
        behind_d = stored[:, over : over + words]
        if bit:
            behind_d = (behind_d >> np.uint64(bit)) | (stored[:, over + 1 : over + 1 + words] << np.uint64(64 - bit))
        apart = stored[:, :words] ^ behind_d
        at = at_most(lambda b, live: apart[b] if len(live) == words else apart[b, live], asked, radius)  # noqa: B023
        at = _bits(at)
        if also:
            at = at[also(at, at + d)]
        first.append(at)
        second.append(at + d)
    return np.concatenate([np.zeros(0, np.int64), *first]), np.concatenate([np.zeros(0, np.int64), *second])


def spanning(n: int, first: np.ndarray, second: np.ndarray) -> list[int]:
    """Which of the pairs are enough to join what all of them join."""
    root, kept = list(range(n)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (i, j) in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def forest(fp: np.ndarray, split: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what links join within fp: fewer than there are fingerprints.

    split: where the second half of a tile of two chunks begins; links inside a chunk are then
    another tile's. split = 0: all against all.
    """
    queries = np.arange(split) if split else np.arange(len(fp))
    others = np.arange(split, len(fp)) if split else queries
    first, second = [], []
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64]
        a, b = within(fp[some], fp[others], radius)
        a, b = some[a], others[b]
        later = a < b
        first, second = np.concatenate([*first, a[later]]), np.concatenate([*second, b[later]])
        kept = spanning(len(fp), first, second)
        first, second = [first[kept]], [second[kept]]
    return first[0], second[0]


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = LEAST_BLOCKS, tile: int = TILE) -> DataFrame:
    """(fp) without repeats -> edges (a, b) that join exactly what links of at most radius bits join.

    Keys with one fingerprint alone are no work. A key's fingerprints are dealt to chunks of about
    `tile` by a hash, and each two chunks of a key meet in a row of their own, so that no row and
    no task holds a whole large key. Each row gives a forest, never all its links.
    """
    masks = keys(blocks, radius)
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(np.array(m, np.uint64).view(np.int64).item())).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    counts = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumnsRenamed({"table": "t2", "key": "k2"})
    met = dealt.join(counts, (F.col("table") == F.col("t2")) & (F.col("key") == F.col("k2"))).withColumn("chunks", F.ceil(F.col("n") / tile).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))
    tiles = met.select("table", "key", "fp", "chunk", F.explode(others).alias("tile")).groupBy("table", "key", "tile").agg(
        F.array_sort(F.collect_list(F.struct((F.col("chunk") == F.col("tile.j")).alias("second"), "fp"))).alias("rows")
    )
    tiles = tiles.filter(F.size("rows") > 1).select((F.col("tile.i") == F.col("tile.j")).alias("whole"), F.transform("rows", lambda r: r["fp"]).alias("fp"), F.size(F.filter("rows", lambda r: ~r["second"])).alias("split"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy().view(np.uint64)
            whole, split = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            size = np.diff(bounds)
            small = np.flatnonzero(whole & (size <= PACKED))
            small = small[np.argsort(size[small], kind="stable")]  # groups of a size share words
            n = size[small]
            fp = values[np.repeat(bounds[small] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            i, j = side_by_side(fp, n, radius)
            kept = spanning(len(fp), i, j)
            a, b = [fp[i[kept]]], [fp[j[kept]]]
            for k in np.flatnonzero(~whole | (size > PACKED)):
                fp = values[bounds[k] : bounds[k + 1]]
                if whole[k] or 0 < split[k] < len(fp):
                    i, j = forest(fp, 0 if whole[k] else int(split[k]), radius)
                    a.append(fp[i]), b.append(fp[j])
            yield pa.record_batch([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=_EDGE.names)

    return tiles.mapInArrow(compare, _EDGE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    component_id is the smallest id that links reach, itself included. Documents of one
    fingerprint, so also all without words, are linked. Ids must be whole numbers: others are cast,
    and what cannot be cast is null. Null ids are rows like others, but no component's name; a
    component of null ids alone has a null component_id. Rows that share an id keep their own
    fingerprints. A fingerprint or component of very many rows is not gathered: see spread_join().
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    different = distinct.count()
    found = components(links(distinct.select("fp"), radius, blocks or blocks_for(different, radius)))
    labelled = cut(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")))
    roots = labelled.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = cut(spread_join(labelled, roots, "root", "r", different).select(F.col("fp").alias("of"), F.col("rows").alias("n"), "component_id"))
    return spread_join(prints, named, "fp", "of", prints.count()).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group: the smallest id's.

    Of several rows with that id, all stay if their ids alone make them equal; rows with a null
    id stay only where no other row of their group has an id.
    """
    found = near_duplicates(docs, id_col, text_col, radius)
    lead = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__lead")).distinct()
    return docs.join(lead, F.col(id_col).eqNullSafe(F.col("__lead")), "left_semi")
