"""Document fingerprints from closed syncmers, in Spark expressions only.

The symbols are words. A k-mer is k words in a row; its inner substrings are its k - s + 1 runs
of s words. A k-mer is chosen when the smallest hash among its inner substrings is that of the
first or of the last one. The choice looks at the k-mer alone, so equal passages give equal
anchors wherever they stand. A fingerprint is the anchors with the smallest hashes and where they
stand; two fingerprints are matched by position: shared anchors count as far as their offsets agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.ranges import ranged
from pitchlake.llm.shared import WORD, cut, let

K, S = 5, 2
#: Anchors kept in a fingerprint: those with the smallest hashes, of 31 bits each.
SKETCH = 64
#: Words by which the offsets of matched anchors may differ from that of most.
BAND = 32
#: Neighbouring ids are dealt to ranges of about so many rows.
RANGE_ROWS = 4000
#: Heads of ranges that are broadcast, at 24 bytes each; beyond, they are joined by a shuffle.
MOST_HEADS = 200_000
#: Ranges that are put in order at once.
NODE = 1024


def _word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _inner_hashes(words: Column, s: int) -> Column:
    n = F.size(words)
    return F.when(n >= s, F.transform(F.sequence(F.lit(0), F.greatest(n - s, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(s)]))).otherwise(
        F.expr("cast(array() as array<bigint>)")
    )


def _chosen(inner: Column, k: int, s: int) -> Column:
    """Positions of the chosen k-mers, in words."""
    last = k - s
    starts = F.sequence(F.lit(0), F.greatest(F.size(inner) - 1 - last, F.lit(0)))

    def edge(i: Column) -> Column:
        least = F.least(*[F.get(inner, i + j) for j in range(last + 1)])
        return (F.get(inner, i) == least) | (F.get(inner, i + last) == least)

    return F.when(F.size(inner) > last, F.filter(starts, edge)).otherwise(F.expr("cast(array() as array<int>)"))


def anchors(df: DataFrame, text_col: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """df with a column `out`: array of structs (pos in words, hash) of the chosen k-mers.

    Null and empty texts, and texts without words, have none. A text of fewer than k words has
    one anchor at 0, the hash of all its words. Ties of inner hashes count for either edge. A
    text's word hashes are held in memory, some 30 bytes a word, for one row at a time.
    """
    words, inner, at = f"__{out}_words", f"__{out}_inner", f"__{out}_at"
    df = df.withColumn(words, _word_hashes(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn(inner, _inner_hashes(F.col(words), s))
    df = df.withColumn(at, _chosen(F.col(inner), k, s))
    # A k-mer's hash is made from inner hashes that together cover its words.
    cover = sorted({*range(0, k - s + 1, s), k - s})
    found = F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(F.col(inner), i + j) for j in cover]).alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.col(words)).alias("hash")))
    none = F.expr("cast(array() as array<struct<pos:int,hash:bigint>>)")
    df = df.withColumn(out, F.when(F.size(words) >= k, found).when(F.size(words) > 0, whole).otherwise(none))
    return df.drop(words, inner, at)


def sketch(found: Column, size: int = SKETCH) -> Column:
    """The anchors with the `size` smallest hashes, ascending; of a repeated hash, the first place.

    Each is one number: the hash in the upper, the position in words in the lower 32 bits.
    """
    numbers = F.array_sort(F.transform(found, lambda a: F.shiftleft(F.shiftrightunsigned(a["hash"], 33), 32) + a["pos"]))

    def first(n: Column) -> Column:
        return F.filter(n, lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(n, i - 1), 32)))

    return let(numbers, lambda n: F.slice(first(n), 1, size))


def likeness(a: Column, b: Column, size: int = SKETCH, band: int = BAND) -> Column:
    """Of the `size` smallest hashes of both sketches, the share that both have at agreeing places; 1 for two empty ones.

    An offset is how many words later an anchor stands in b than in a. Offsets agree if they differ
    by at most `band` words from that offset which most others are that near to. The places of
    anchors stand for those of the text, so a passage that moved counts, and chance hits do not.
    """
    half = 1 << 31
    merged = F.array_sort(F.concat(a, F.transform(b, lambda x: x + half)))  # of equal hashes, that of a stands first

    def matched(m: Column) -> Column:
        hashes = F.slice(F.array_distinct(F.transform(m, lambda x: F.shiftright(x, 32))), 1, size)
        pairs = lambda last: F.filter(
            F.transform(m, lambda x, i: F.when((F.shiftright(x, 32) == F.shiftright(F.get(m, i + 1), 32)) & (F.shiftright(x, 32) <= last), F.get(m, i + 1) - half - x)), lambda d: d.isNotNull()
        )
        most = lambda offsets: F.coalesce(F.array_max(F.transform(F.array_distinct(offsets), lambda d: F.size(F.filter(offsets, lambda e: F.abs(e - d) <= band)))), F.lit(0))
        return let(hashes, lambda h: let(pairs(F.get(h, F.size(h) - 1)), most) / F.size(h))

    return F.when(F.size(a) + F.size(b) > 0, let(merged, matched)).otherwise(F.lit(1.0))


def as_text(s: Column) -> Column:
    """The sketch as hexadecimal text, sixteen digits an anchor."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, size: int = SKETCH) -> DataFrame:
    """(doc_id, t, sk) of every row of docs; null text counts as empty, whose sketch is empty."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return anchors(base, "t", "found", k, s).select("doc_id", "t", sketch(F.col("found"), size).alias("sk"))


def with_next(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (doc_id, t, sk) with next_t and next_sk: those of the next row by descending doc_id.

    After the last comes the first; null ids come last; rows of one id are ordered by text. A
    single row is its own next. No range is larger than its share: ids are dealt to ranges,
    and each range gets, behind its own rows, a copy of the rows that head the range below it.
    """
    ranges, of_ids = ranged(ids, docs, ids, rows=RANGE_ROWS)
    # A range's head also stands at the end of the range above it. Ranges are put in order NODE at a
    # time; only the nodes, one row for so many ranges, are put in order all at once.
    heads = of_ids.groupBy(F.col("range").alias("of")).agg(F.max("doc_id").alias("head")).withColumn("node", F.floor(F.col("of") / NODE))
    nodes = heads.groupBy("node").agg(F.min("of").alias("low")).select(F.col("node").alias("up"), "low")
    order = Window.orderBy(F.col("up").desc())
    nodes = nodes.withColumn("over", F.coalesce(F.lag("low").over(order), F.min("low").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("low")
    inner = Window.partitionBy("node").orderBy(F.col("of").desc())
    heads = cut(heads.join(nodes, F.col("node") == F.col("up")).select("of", "head", F.coalesce(F.lag("of").over(inner), F.col("over")).alias("above")))
    if heads.count() <= MOST_HEADS:
        heads = F.broadcast(heads)
    joined = ranges.join(heads, (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct("range", F.lit(False).alias("copy"))
    places = F.when(F.col("of").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("above").alias("range"), F.lit(True).alias("copy"))))
    rows = joined.select("doc_id", "t", "sk", F.explode(places).alias("place")).select("doc_id", "t", "sk", "place.*")
    w = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "t")
    return rows.select("doc_id", "t", "sk", "copy", F.lead("t").over(w).alias("next_t"), F.lead("sk").over(w).alias("next_sk")).filter(~F.col("copy")).drop("copy")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, size: int = SKETCH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next document. Every row of docs gives one row; see with_next() for the order.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"))
    paired = with_next(fingerprints(docs, id_col, text_col, k, s, size), ids)
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    paired = paired.withColumn("edited", F.concat(F.col("t").substr(F.lit(1), (n - half).cast("int")), F.col("next_t").substr(F.lit(1), half)))
    paired = anchors(paired, "edited", "found", k, s).withColumn("edited_sk", sketch(F.col("found"), size))
    return paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk"), size).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk"), size).alias("near_next"),
    )
