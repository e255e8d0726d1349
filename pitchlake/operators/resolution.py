"""Matching records to known entities by name, age, club and position.

Every record is held against every known entity, but only names that can be similar enough meet.
A pair whose similarity reaches LEAST shares a number of bigrams that follows from the two lengths,
so of each name's bigrams, rarest first, some few in front must have so many in common with the
other's; these are joined, up to three at once as one key, which few names share. Names that contain
another one are found by the rarest trigram of the shorter. Names count once, however many records
have them, and a record looks its best entity up by the attributes that must agree, so that no
name's records meet all of its entities.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.functions import exprs as X
from pitchlake.sources.shared import cut

#: The least similarity, what containing the other name counts at least, shares of the score, and when a match is confident.
LEAST, HELD, NAME, AGE, CLUB, POSITION, CONFIDENT = 0.80, 0.85, 0.60, 0.20, 0.12, 0.08, 0.88
#: Codes of the four broad positions.
BROAD = {
    "fw": ("fw", "st", "cf", "lw", "rw", "ss", "forward", "striker", "winger"),
    "mf": ("mf", "cm", "am", "dm", "lm", "rm", "mid", "midfielder"),
    "df": ("df", "cb", "lb", "rb", "lwb", "rwb", "defender", "back"),
    "gk": ("gk", "goalkeeper", "keeper"),
}
#: From this length on bigrams are joined one by one: there are many, and a longer name has rare ones.
LONG = 33


def name_similarity(a, b):
    """1 for equal folded names, 0.85 at least if one holds the other, else 1 - edit distance / longer length."""
    a, b = X.col(a), X.col(b)
    ratio = 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), F.greatest(F.lit(HELD), ratio)).otherwise(ratio)


def block_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks, the longest first, over the characters of both; 0 if under LEAST by the characters alone."""
    if 2 * sum((Counter(a) & Counter(b)).values()) < LEAST * (len(a) + len(b)):
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def _block_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return a.combine(b, block_ratio).astype("float64")


def ratio_similarity(a, b):
    """1 for equal folded names, 0.85 at least if one holds the other, else block_ratio(); what is under LEAST may be 0."""
    a, b = X.col(a), X.col(b)
    ratio = _block_ratios(a, b)
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), F.greatest(F.lit(HELD), ratio)).otherwise(ratio)


MEASURES = {"ratio": ratio_similarity, "edit": name_similarity}


# --- names that can be similar -----------------------------------------------------------------


def in_common(total: int) -> int:
    """Bigrams that two names of `total` characters together share at least, if their similarity reaches LEAST.

    2 M / total >= 0.8 of M characters in blocks; blocks are apart by one of the total - 2 M others,
    and one of b characters has b - 1 bigrams. Edit distance demands more than that.
    """
    return 3 * -(-2 * total // 5) - total - 1


@lru_cache(maxsize=1024)
def together(length: int) -> int:
    """How many bigrams make a key for names of which the shorter has this length; 0: its characters do."""
    return min(3, max(0, min(in_common(length + other) for other in range(length, length * 3 // 2 + 1))))


def level(length: int) -> int:
    return 9 if length >= LONG else together(length)


@lru_cache(maxsize=4096)
def prefixes(length: int) -> tuple[tuple[int, int, int], ...]:
    """(level, bigrams of a key, bigrams in front that are joined) for every level at which a name of this length may meet another."""
    partners: dict[int, int] = {}
    for other in range(-(-2 * length // 3), length * 3 // 2 + 1):
        at = level(min(length, other))
        partners[at] = min(partners.get(at, 1 << 30), in_common(length + other))
    return tuple((at, k := 1 if at == 9 else at, max(k, length - 1 - max(least, k) + k)) for at, least in sorted(partners.items()))


@lru_cache(maxsize=512)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def name_keys(name: str, grams: np.ndarray) -> np.ndarray:
    """The keys of a name with these bigrams, rarest first: names with a key in common may be similar, others are not."""
    out = []
    for at, k, n in prefixes(len(name)):
        if at == 0:
            out.append(_mixed(np.array(sorted({ord(c) for c in name}), np.uint64)))
        elif n <= len(grams):
            key = np.full(len(chosen := _choices(n, k)), at, np.uint64)
            for i in range(k):
                with np.errstate(over="ignore"):
                    key = _mixed(key * np.uint64(0xD6E8FEB86659FD93) + grams[chosen[:, i]])
            out.append(key)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


_GRAM = T.StructType([T.StructField("name", T.StringType()), T.StructField("h", T.LongType())])
_KEY = T.StructType([T.StructField("name", T.StringType()), T.StructField("key", T.LongType())])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name) -> (name, hash of each bigram and of which of its like it is)."""
    for batch in batches:
        names, values = [], []
        for name in batch.column(0).to_pylist():
            seen: Counter = Counter()
            for x, y in itertools.pairwise(name):
                seen[x, y] += 1
                names.append(name)
                values.append(ord(x) << 42 | ord(y) << 20 | min(seen[x, y], (1 << 20) - 1))
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(_mixed(np.array(values, np.uint64)).view(np.int64))], names=_GRAM.names)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, keys = [], []
        for name, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(name_keys(name, np.array(grams or [], np.int64).view(np.uint64)))
            names += [name] * len(keys[-1])
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))], names=_KEY.names)


def _parts(name: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - (size - 1)), lambda i: F.substring(name, i, F.lit(size))))


def _held(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(i, o): each name of inner that a longer name of outer contains; met by the inner name's rarest part of three characters, or by all of it."""
    parts = lambda d, c: d.select(F.col("name").alias(c), F.explode(F.when(F.length("name") >= 3, _parts(F.col("name"), 3)).otherwise(F.array("name"))).alias("part"))
    often = parts(outer.filter(F.length("name") >= 3), "o").groupBy("part").agg(F.count("*").alias("n"))
    least = parts(inner, "i").join(often, "part", "left").groupBy("i").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part"))["part"].alias("part"))
    least = cut(least)
    short = least.filter(F.length("part") < 3)
    there = parts(outer.filter(F.length("name") >= 3), "o").join(least.select("part").distinct(), "part", "left_semi")
    if not short.isEmpty():
        few = [outer.filter(F.length("name") > size).select(F.col("name").alias("o"), F.explode(_parts(F.col("name"), size)).alias("part")) for size in (1, 2)]
        there = there.unionByName(few[0].unionByName(few[1]).join(short.select("part").distinct(), "part", "left_semi"))
    return least.join(there, "part").filter((F.length("o") > F.length("i")) & F.col("o").contains(F.col("i"))).select("i", "o")


def similar_names(asked: DataFrame, known: DataFrame, measure: str = "ratio") -> DataFrame:
    """(name) and (name), distinct and not empty -> (n, m, sim) of all pairs whose similarity reaches LEAST."""
    both = cut(asked.select("name", F.lit(0).alias("side")).unionByName(known.select("name", F.lit(1).alias("side"))).groupBy("name").agg(F.min("side").alias("low"), F.max("side").alias("high")))
    grams = cut(both.select("name").mapInArrow(_grams, _GRAM))
    often = grams.groupBy(F.col("h").alias("k")).agg(F.count("*").alias("n"))
    ordered = grams.join(often, F.col("h") == F.col("k")).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda g: g["h"]).alias("grams"))
    keyed = both.select("name").join(ordered, "name", "left").select("name", "grams").mapInArrow(_keys, _KEY)
    keyed = cut(keyed.join(both, "name"))
    n, m = keyed.filter("low = 0").select("key", F.col("name").alias("n")), keyed.filter("high = 1").select(F.col("key").alias("k2"), F.col("name").alias("m"))
    a, b = F.length("n"), F.length("m")
    # A shared key is met once for each pair that has it; most pairs share one alone.
    fits = (F.col("key") == F.col("k2")) & (5 * F.least(a, b) >= 2 * (a + b)) & (F.col("n") != F.col("m"))
    near = n.join(m, fits).select("n", "m")
    left, right = both.filter("low = 0").select("name"), both.filter("high = 1").select("name")
    held = _held(left, right).select(F.col("i").alias("n"), F.col("o").alias("m")).unionByName(_held(right, left).select(F.col("o").alias("n"), F.col("i").alias("m")))
    same = both.filter("low = 0 and high = 1").select(F.col("name").alias("n"), F.col("name").alias("m"))
    pairs = cut(near.unionByName(held).unionByName(same).distinct())
    return pairs.withColumn("sim", MEASURES[measure]("n", "m")).filter(F.col("sim") >= LEAST)


# --- entities of similar names -----------------------------------------------------------------


def broad(position: Column | str) -> Column:
    """One of the four broad positions, 'other' for what is none of their codes; null for nothing."""
    p = F.lower(F.trim(X.col(position)))
    out = F.when(p.isNull() | (p == ""), F.lit(None).cast("string"))
    for key, codes in BROAD.items():
        out = out.when(p.isin(*codes), key)
    return out.otherwise("other")


def _described(t: DataFrame, id_col: str) -> DataFrame:
    club = F.nullif(X.plain_name("club"), F.lit(""))
    return t.select(id_col, X.plain_name("name").alias("name"), F.col("age").cast("long").alias("age"), club.alias("club"), broad("position").alias("position"))


def resolve(records: DataFrame, known: DataFrame, measure: str = "ratio") -> DataFrame:
    """(record_id, slug, score, level) of each record's best known entity, if any scores 0.80.

    Both have name, age, club, position; records have record_id, known has slug, each once. Score: 0.60 * name
    similarity ("ratio" of matching blocks or "edit" distance, at least 0.80) and 0.20, 0.12 and 0.08
    where ages are within one year, clubs equal when folded and broad positions equal; what is null or
    blank on either side agrees. The best score wins, of equal ones the smallest slug. Records and
    entities whose names fold to nothing match nothing. Repeated entities count once; records of one
    id resolve each by itself. No records or no entities give no rows.
    """
    asked = cut(_described(records, "record_id").filter("name <> ''"))
    there = cut(_described(known, "slug").filter("name <> ''").groupBy("name", "age", "club", "position").agg(F.min("slug").alias("slug")))
    names = cut(similar_names(asked.select("name").distinct(), there.select("name").distinct(), measure))
    # An entity is listed under each choice of attributes that must agree; '' stands for one that need not, a null attribute for itself.
    attributes = ("age", "club", "position")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?"))
    choices = list(itertools.product((0, 1), repeat=3))
    listed = there.select(F.col("name").alias("m"), "slug", F.explode(F.array(*[F.struct(*[(text(c) if on else F.lit("")).alias(f"k_{c}") for c, on in zip(attributes, chosen, strict=True)]) for chosen in choices])).alias("k"))
    listed = listed.select("m", "k.*", "slug").groupBy("m", *[f"k_{c}" for c in attributes]).agg(F.min("slug").alias("slug"))
    # A record asks for what each attribute may be, and for nothing of it; an attribute it lacks agrees with all.
    near_ages = F.array(*[F.concat(F.lit("="), (F.col("age") + d).cast("string")) for d in (-1, 0, 1)], F.lit("?"))
    may = {"age": near_ages, "club": F.array(text("club"), F.lit("?")), "position": F.array(text("position"), F.lit("?"))}
    profiles = asked.select("name", *attributes).distinct()
    looked = profiles.join(names, F.col("name") == F.col("n"))
    worth = dict(zip(attributes, (AGE, CLUB, POSITION), strict=True))

    def asks(c: str) -> Column:
        free = F.array(F.struct(F.lit("").alias("v"), F.when(F.col(c).isNull(), worth[c]).otherwise(0.0).alias("w")))
        return F.when(F.col(c).isNull(), free).otherwise(F.concat(free, F.transform(may[c], lambda v: F.struct(v.alias("v"), F.lit(worth[c]).alias("w")))))

    for c in attributes:
        looked = looked.withColumn(f"a_{c}", F.explode(asks(c)))
    score = F.round(F.least(NAME * F.col("sim") + F.col("a_age.w") + F.col("a_club.w") + F.col("a_position.w"), F.lit(1.0)), 4)
    looked = looked.select("name", *attributes, "m", score.alias("score"), *[F.col(f"a_{c}.v").alias(f"k_{c}") for c in attributes]).filter(F.col("score") >= LEAST)
    found = looked.join(listed, ["m", *[f"k_{c}" for c in attributes]])
    best = found.groupBy("name", *attributes).agg(F.min(F.struct((-F.col("score")).alias("s"), "slug")).alias("best"))
    agrees = F.lit(True)
    for c in ("name", *attributes):
        agrees = agrees & asked[c].eqNullSafe(best[c])
    return asked.join(best, agrees).select("record_id", F.col("best.slug").alias("slug"), (-F.col("best.s")).alias("score"), F.when(-F.col("best.s") >= CONFIDENT, "confident").otherwise("low").alias("level"))


def known_or_new(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """records with slug and is_new; a new one gets a slug from its name."""
    t = records.join(resolved.select("record_id", F.col("slug").alias("known_slug")), "record_id", "left")
    return t.select("record_id", "name", F.coalesce(F.col("known_slug").cast("string"), X.slug("name")).alias("slug"), F.col("known_slug").isNull().alias("is_new"))
