"""Near-duplicates by the Jaccard similarity of word shingles, candidates by MinHash, links verified.

Each text is the set of its runs of SHINGLE lower-case words. Sets that are equal collapse at once.
BANDS keys of ROWS MinHash values each are dealt for a set; a pair of similarity s shares none of
them with a chance of (1 - s^ROWS)^BANDS, which is 5e-8 at s = 0.8 and falls above. A pair that
shares a key is a candidate unless more than APART of 4-bit parts of its MinHash values differ, which
has a chance below 5e-8 too at s = 0.8, and a link only if the similarity of the whole sets reaches SHARE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel
from pitchlake.llm.components import HOT, chain_ends, components, spread_join
from pitchlake.llm.shared import cut, cut_at, remove

#: Words of a shingle; a link's least similarity as a fraction; MinHash keys and values of each.
SHINGLE, SHARE, BANDS, ROWS = 5, (4, 5), 32, 4
#: Of the 4-bit parts of two sets' MinHash values, this many may differ in a candidate.
APART = 50
#: Pairs of one set that a task compares together, unless more than HOT sets have that many; bits of the filter of wanted sets, at most.
TOGETHER, FILTER_BITS = 1000, 1 << 27
#: Sets of a key, at most, of which all pairs meet.
FEW = 24
#: Ids of documents that go, at most so many, are broadcast: 67 MB as Spark holds them (measured).
BROADCAST_IDS = 1 << 20
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingles, ascending; a text of fewer than `size` words is one shingle."""
    data = kernel.LOWER[data]
    starts, ends, first = kernel.word_bounds(data, offsets)
    words, n_words = kernel.word_hashes(data, starts, ends), np.diff(first)
    at = np.flatnonzero(kernel.in_texts(first, size))
    text, h = [np.searchsorted(first, at, "right") - 1], [kernel.run_hashes(words, size)[at]]
    for n in range(1, size):
        short = np.flatnonzero(n_words == n)
        if len(short):
            text.append(short)
            h.append(kernel.run_hashes(words, n)[first[short]])
    text, h = np.concatenate(text), np.concatenate(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(n_words) + 1))


def sketches(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(BANDS keys, 4 bits of each MinHash value, 16 to a number) of each set; an empty set's are 0."""
    full = np.flatnonzero(np.diff(bounds))
    keys, parts = np.zeros((len(bounds) - 1, BANDS), np.uint64), np.zeros((len(bounds) - 1, len(_TIMES) // 16), np.uint64)
    if len(full):
        low = bounds[full]
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                key = np.full(len(full), b + 1, np.uint64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    least = kernel.mix(np.minimum.reduceat(h * _TIMES[k] + _PLUS[k], low))
                    key = kernel.mix(key * np.uint64(0xD6E8FEB86659FD93) + least)
                    parts[full, k // 16] |= (least & np.uint64(15)) << np.uint64(k % 16 * 4)
                keys[full, b] = key
    return keys, parts


def set_hashes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each whole set; an empty set's is 0."""
    full, fp = np.flatnonzero(np.diff(bounds)), np.zeros(len(bounds) - 1, np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            fp[full] = kernel.mix(np.add.reduceat(kernel.mix(h ^ np.uint64(0x9E3779B97F4A7C15)), bounds[full]))
    return fp


_PARTS = [f"p{i}" for i in range(BANDS * ROWS // 16)]
_PRINT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), *[T.StructField(p, T.LongType()) for p in _PARTS]])
_TEXT = T.StructType([T.StructField("fp", T.LongType()), T.StructField("text", T.StringType())])
_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class Tables:
    """Writes tables to the shared folder, and removes them when whoever reads them is done."""

    def __init__(self):
        self.made: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.made.append(cut_at(df))
        return self.made[-1][0]

    def remove(self) -> None:
        for df, path in self.made:
            remove(df.sparkSession, path)
        self.made = []


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n, keys, p0 ...) of every row of docs: its set's hash, size, keys and parts of MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in kernel.chunks(batch.column(1)):
                h, bounds = shingle_sets(data, offsets)
                keys, parts = sketches(h, bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
                own = [batch.slice(at, len(keys)).column(0), pa.array(set_hashes(h, bounds).view(np.int64)), pa.array(np.diff(bounds)), lists]
                yield pa.record_batch([*own, *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in parts.T]], names=_PRINT.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PRINT)


def texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(fp, text): one text of each wanted set (w).

    Documents pass a filter first, in which each set has two bits of 16 or more, so that texts of other
    sets are hardly shuffled; of a set's copies a task sends one. Only the filter, of FILTER_BITS at
    most, reaches the driver; where it is full it lets all pass.
    """
    size = min(FILTER_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    half = size.bit_length() - 1
    places = wanted.select(F.explode(F.array(F.col("w"), F.shiftrightunsigned("w", half))).alias("p")).select(F.col("p").bitwiseAND(F.lit(size - 1)).alias("p"))
    words = places.groupBy(F.expr("shiftright(p, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    kept = np.zeros(size // 64, np.uint64)
    kept[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, data, offsets in kernel.chunks(batch.column(0)):
                fp = set_hashes(*shingle_sets(data, offsets))
                ok = np.ones(len(fp), bool)
                for p in (fp & np.uint64(size - 1), fp >> np.uint64(half) & np.uint64(size - 1)):
                    ok &= (sent.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                for i in np.flatnonzero(ok).tolist():
                    ok[i] = int(fp[i]) not in seen
                    seen.add(int(fp[i]))
                yield pa.record_batch([pa.array(fp[ok].view(np.int64)), batch.column(0).slice(at, len(fp)).filter(pa.array(ok))], names=_TEXT.names)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, _TEXT).join(wanted, F.col("fp") == F.col("w"), "left_semi").dropDuplicates(["fp"])


def beside(pairs: DataFrame, facts: DataFrame, on: str, other: str, total: int) -> DataFrame:
    """pairs with the columns of facts (fp, ...) by pairs.on = fp.

    Sets of more than TOGETHER of the `total` pairs, or of one in HOT if that is more, are met in parts
    of so many pairs, dealt by the other set; fewer than HOT sets are such, so their names are broadcast.
    """
    most = max(TOGETHER, total // HOT)
    hot = F.broadcast(pairs.groupBy(F.col(on).alias("__hot")).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select("__hot", (F.col("__n") / most).cast("int").alias("__last")))
    last = F.coalesce("__last", F.lit(0))
    dealt = pairs.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(other), last + 1).cast("int")).drop("__hot", "__last")
    spread = facts.join(hot, F.col("fp") == F.col("__hot"), "left").withColumn("__in", F.explode(F.sequence(F.lit(0), last))).drop("__hot", "__last")
    return dealt.join(spread, (F.col(on) == F.col("fp")) & (F.col("__part") == F.col("__in"))).drop("fp", "__part", "__in")


def may_link(n1: Column, n2: Column, parts1: list[Column], parts2: list[Column]) -> Column:
    """Whether sets of these sizes and parts of MinHash values can be as similar as SHARE."""
    apart = F.lit(0)
    for x, y in zip(parts1, parts2, strict=True):
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        apart = apart + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return (F.least(n1, n2) * SHARE[1] >= F.greatest(n1, n2) * SHARE[0]) & (apart <= APART)


def verified(pairs: DataFrame, texts: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs (a, b) of set hashes whose sets are as similar as `share`."""
    total = pairs.count()
    both = beside(pairs, texts.withColumnRenamed("text", "y"), "b", "a", total)
    both = beside(both, texts.withColumnRenamed("text", "x"), "a", "b", total).select("a", "b", "x", "y")

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in kernel.chunks(column):
            h, bounds = shingle_sets(data, offsets)
            yield from (h[p:q] for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(sets(batch.column(2)), sets(batch.column(3)), strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = share[1] * common >= share[0] * (len(x) + len(y) - common)
            yield pa.record_batch(batch.filter(pa.array(ok)).columns[:2], names=_EDGE.names)

    return both.mapInArrow(compare, _EDGE)


def shingles_of(texts: DataFrame) -> DataFrame:
    """(fp, text) -> (fp, h): a row for each distinct shingle of each text."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("h", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at, data, offsets in kernel.chunks(batch.column(1)):
                h, bounds = shingle_sets(data, offsets)
                yield pa.record_batch([pa.array(np.repeat(own[at : at + len(offsets) - 1], np.diff(bounds))), pa.array(h.view(np.int64))], names=schema.names)

    return texts.select("fp", "text").mapInArrow(run, schema)


def rarest(sets: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """(fp, n) -> (h, fp): of each set as many of its rarest shingles as two sets of similarity SHARE must have one in common of.

    Of n shingles all but the n * SHARE most frequent ones, and one of these; frequent is what many of
    `sets` have. What one set alone has is no row, so sets of pages that share a template, but too
    little besides, have no row at all.
    """
    grams = tables.cut(shingles_of(texts.join(sets.select(F.col("fp").alias("w")), F.col("fp") == F.col("w"), "left_semi")))
    often = tables.cut(grams.groupBy(F.col("h").alias("k")).agg(F.count("*").alias("n")).filter("n > 1"))
    shared = spread_join(grams, often, "h", "k", grams.count()).select("fp", "h", F.col("n").alias("often"))
    prefix = F.col("n") - F.ceil(F.col("n") * SHARE[0] / SHARE[1]) + 1
    in_order = Window.partitionBy("fp").orderBy("often", "h")
    ranked = shared.select("fp", "h", F.row_number().over(in_order).alias("i"), F.count("*").over(Window.partitionBy("fp")).alias("others"))
    return ranked.join(sets.select(F.col("fp").alias("w"), "n"), F.col("fp") == F.col("w")).filter(F.col("i") <= prefix - (F.col("n") - F.col("others"))).select("h", "fp")


def pairs_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, fp, root, n, parts) -> distinct (a, b) of rows of one key that have different roots and may link."""
    right = rows.select(F.col(key).alias("k2"), F.col("fp").alias("f2"), F.col("root").alias("root2"), F.col("n").alias("n2"), *[F.col(p).alias(f"{p}_2") for p in _PARTS])
    fits = (F.col("fp") < F.col("f2")) & (F.col("root") != F.col("root2")) & may_link(F.col("n"), F.col("n2"), [F.col(p) for p in _PARTS], [F.col(f"{p}_2") for p in _PARTS])
    return rows.join(right, (F.col(key) == F.col("k2")) & fits).select(F.col("fp").alias("a"), F.col("f2").alias("b")).distinct()


def links(marked: DataFrame, docs: DataFrame, tables: Tables, text_col: str = "text") -> DataFrame:
    """prints() of docs -> edges (a, b) of set hashes that join exactly what links between candidates join.

    Each set is first compared with one other only, the smallest that shares a key with it; then, in
    keys whose sets this has not all joined, with the key's smallest set. In keys still not joined, all
    pairs of sets not joined yet meet if they are at most FEW; the sets of larger keys meet those that
    share one of their rarest shingles, without which no two of them can be similar enough. What the
    sizes or the MinHash values rule out is left away inside the joins.
    """
    sets = tables.cut(marked.filter("n > 0").select("fp", "n", "keys", *_PARTS).dropDuplicates(["fp"]))
    dealt = sets.select("fp", F.explode("keys").alias("key"))
    shared = tables.cut(dealt.groupBy(F.col("key").alias("k2")).agg(F.min("fp").alias("lead"), F.count("*").alias("n")).filter("n > 1"))
    met = tables.cut(spread_join(dealt, shared, "key", "k2", sets.count() * BANDS).select("key", "fp", "lead"))
    wanted = tables.cut(met.select(F.col("fp").alias("w")).distinct())
    texts = tables.cut(texts_of(docs, wanted, text_col))
    sides = [sets.select("fp", *[F.col(c).alias(f"{c}_{s}") for c in ("n", *_PARTS)]) for s in "ab"]
    likely = may_link(F.col("n_a"), F.col("n_b"), *[[F.col(f"{p}_{s}") for p in _PARTS] for s in "ab"])

    def near(pairs: DataFrame) -> DataFrame:
        pairs = tables.cut(pairs)
        total = pairs.count()
        fit = tables.cut(beside(beside(pairs, sides[1], "b", "a", total), sides[0], "a", "b", total).filter(likely).select("a", "b"))
        return tables.cut(verified(fit, texts))

    def still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """(key, fp, lead, root, lead_root, n) of the rows in keys whose sets are not all joined; n: of the key."""
        labelled = tables.cut(rows.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "lead", F.coalesce("root", "fp").alias("root")))
        of_key = labelled.groupBy(F.col("key").alias("k2")).agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.max(F.when(F.col("fp") == F.col("lead"), F.col("root"))).alias("lead_root"), F.count("*").alias("n"))
        of_key = tables.cut(of_key.filter("r1 <> r2").drop("r1", "r2"))
        return tables.cut(spread_join(labelled, of_key, "key", "k2", labelled.count()).select("key", "fp", "lead", "root", "lead_root", "n"))

    first = tables.cut(met.filter("fp <> lead").groupBy(F.col("fp").alias("b")).agg(F.min("lead").alias("a")).select("a", "b"))
    edges = near(first)
    opened = still_open(met, chain_ends(edges.select(F.col("b").alias("node"), F.col("a").alias("next"))))
    star = opened.filter("root <> lead_root").select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct()
    edges = edges.unionByName(near(star.join(first, ["a", "b"], "left_anti")))
    # A pair with its key's smallest set has been compared by now.
    left = still_open(opened.select("key", "fp", "lead"), components(edges)).filter("fp <> lead")
    facts = sets.select(F.col("fp").alias("w"), F.col("n").alias("size"), *_PARTS)
    full = tables.cut(left.select("key", "fp", "root", (F.col("n") > FEW).alias("large")).join(facts, F.col("fp") == F.col("w")).drop("w").withColumnRenamed("size", "n"))
    rest = pairs_by(full.filter("not large"), "key")
    many = full.filter("large").drop("key", "large").dropDuplicates(["fp"])
    if not many.isEmpty():
        many = tables.cut(many)
        rest = rest.unionByName(pairs_by(tables.cut(rarest(many.select("fp", "n"), texts, tables).join(many.withColumnRenamed("fp", "w"), F.col("fp") == F.col("w")).drop("w")), "h")).distinct()
    return edges.unionByName(tables.cut(verified(tables.cut(rest), texts)))


def _groups(docs: DataFrame, id_col: str, text_col: str, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """groups(), and prints() of docs; both last until tables.remove()."""
    marked = tables.cut(prints(docs, id_col, text_col))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labelled = tables.cut(classes.join(components(links(marked, docs, tables, text_col)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = labelled.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return tables.cut(spread_join(labelled, named, "root", "r", labelled.count()).select("fp", "least", "component_id")), marked


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fp, least, component_id) of each distinct set: the smallest id that has it and that of its group.

    Texts without words, null ones too, are one set. Null ids are no set's or group's name, unless
    it has no other.
    """
    tables = Tables()
    found = cut(_groups(docs, id_col, text_col, tables)[0])
    tables.remove()
    return found


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of a group.

    All rows with that id stay; rows with a null id stay if some group has no other id. The ids that
    go are broadcast if they are no more than BROADCAST_IDS; more are joined by a shuffle of docs.
    """
    tables = Tables()
    return without(docs, *_groups(docs, id_col, text_col, tables), tables, id_col)


def without(docs: DataFrame, found: DataFrame, marked: DataFrame, tables: Tables, id_col: str) -> DataFrame:
    """representatives(), from groups `found` and prints `marked` of docs, whose tables are removed."""
    lead = found.select(F.col("component_id").alias("__lead")).distinct()
    gone = cut(marked.select(F.col("doc_id").alias("__gone")).distinct().join(lead, F.col("__gone").eqNullSafe(F.col("__lead")), "left_anti"))
    none, ids = gone.agg(F.count(F.when(F.col("__gone").isNull(), 1)), F.count("__gone")).head()
    tables.remove()
    kept = docs.filter(F.col(id_col).isNotNull()) if none else docs
    # A join of whole numbers that are never null is held in Spark's compact table.
    some = gone.select(F.coalesce("__gone", F.lit(0)).alias("__gone")) if not none else gone.filter("__gone is not null").select(F.coalesce("__gone", F.lit(0)).alias("__gone"))
    return kept.join(F.broadcast(some) if ids <= BROADCAST_IDS else some.hint("merge"), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
