"""Scalar functions as Column expressions. All are JVM-side; rounding is half-up throughout."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- cleaning ---------------------------------------------------------------------------------


def clean_text(c: Column | str) -> Column:
    """White space collapsed and trimmed; nothing left: null."""
    return F.nullif(F.trim(F.regexp_replace(col(c), r"\s+", " ")), F.lit(""))


def clean_number(c: Column | str, digits: int = 3) -> Column:
    """'1,234.5' as a double; not a number: null."""
    return F.round(F.regexp_replace(col(c), ",", "").try_cast("double"), digits)


def clean_int(c: Column | str) -> Column:
    """'1,234' as a long, cut towards zero; not a number: null."""
    return F.regexp_replace(col(c), ",", "").try_cast("double").try_cast("long")


def money(c: Column | str) -> Column:
    """'€5.2m', '500k', '1.1bn', '12000000' in EUR; 'free', '-' and the like: null."""
    t = F.lower(F.regexp_replace(F.trim(col(c)), "[,€£$\\s]", ""))
    unit = F.when(t.endswith("bn"), 1e9).when(t.endswith("m"), 1e6).when(t.endswith("k"), 1e3).otherwise(1.0)
    return F.regexp_replace(t, "(bn|m|k)$", "").try_cast("double") * unit


def _folded_letters() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to a plain one and marks, and those with a stroke or without a dot, with their plain ones."""
    plain = {"ł": "l", "đ": "d", "ı": "i"}
    for code in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if bare != chr(code) and len(bare) == 1 and bare.isascii() and bare.islower():
            plain[chr(code)] = bare
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _folded_letters()


def unaccented(c: Column | str) -> Column:
    """Lower case, Latin letters without their accents, whether these are part of the letter or marks behind it."""
    return F.regexp_replace(F.translate(F.lower(col(c)), ACCENTED, PLAIN), r"\p{M}+", "")


def fold(c: Column | str) -> Column:
    """Lower case without accents, hyphens and underscores as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccented(c), "[-_]", " "), r"\s+", " "))


def plain_name(c: Column | str) -> Column:
    """Lower case without accents and punctuation, white space collapsed; what entities' names are compared by."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccented(c), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def slug(c: Column | str, empty: str = "unknown-player", joint: str = "-") -> Column:
    t = F.regexp_replace(unaccented(F.trim(col(c))), "[^a-z0-9]+", joint)
    return F.coalesce(F.nullif(F.regexp_replace(t, f"^{joint}+|{joint}+$", ""), F.lit("")), F.lit(empty))


def player_key(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit("unknown-player"))))


DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")


def birth_date(c: Column | str) -> Column:
    """The first of DATE_FORMATS that fits."""
    return F.coalesce(*[F.try_to_date(F.trim(col(c)), f) for f in DATE_FORMATS])


def flexible_timestamp(c: Column | str) -> Column:
    t = F.trim(col(c))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-M-d", "yyyy/M/d", "d/M/yyyy")])


def age_at(dob: Column | str, on: Column) -> Column:
    """Completed years."""
    d = col(dob)
    had = (F.month(on) > F.month(d)) | ((F.month(on) == F.month(d)) & (F.dayofmonth(on) >= F.dayofmonth(d)))
    return F.year(on) - F.year(d) - F.when(had, 0).otherwise(1)


# --- arithmetic -------------------------------------------------------------------------------


def or_default(c: Column | str, default: Column | float | int) -> Column:
    """The value, or the default where it is null or 0."""
    return F.when(col(c).isNull() | (col(c) == 0), default if isinstance(default, Column) else F.lit(default)).otherwise(col(c))


def per_90(total: Column | str, minutes: Column | str, digits: int = 3) -> Column:
    """Null where either is null or there are no minutes."""
    return F.when(col(minutes) > 0, F.round(col(total).cast("double") / col(minutes) * 90.0, digits))


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c)))


def gauss(c: Column | str, peak: float, sigma: float) -> Column:
    d = col(c) - peak
    return F.exp(-(d * d) / (2 * sigma * sigma))


def sigmoid(x: Column) -> Column:
    """1 and 0 beyond 30 either way."""
    return F.when(x > 30, 1.0).when(x < -30, 0.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def tiers(c: Column, steps: Sequence[tuple[float, str]], rest: str, missing: str | None = None) -> Column:
    """The label of the first step that the value reaches; steps descend."""
    out = F.when(c.isNull(), F.lit(missing)) if missing is not None else None
    for least, label in steps:
        out = F.when(c >= least, label) if out is None else out.when(c >= least, label)
    return out.otherwise(rest)


def below(c: Column, steps: Sequence[tuple[float, object]], rest: object, missing: object = None) -> Column:
    """The value of the first step that the column is under; steps ascend."""
    out = F.when(c.isNull(), F.lit(missing))
    for limit, value in steps:
        out = out.when(c < limit, F.lit(value))
    return out.otherwise(F.lit(rest))


def age_multiplier(age: Column | str) -> Column:
    return below(col(age), [(21, 1.10), (25, 1.05), (30, 1.00)], 0.95, 1.0)


def age_curve_score(age: Column | str) -> Column:
    """0 to 100 with its peak at 25; unknown: 50."""
    return F.coalesce(F.round(clamp(gauss(age, 25.0, 5.0) * 100.0, 0, 100), 2), F.lit(50.0))


def variation(mean: Column, deviation: Column, n: Column, floor: float) -> Column:
    """Coefficient of variation with a floor under the mean; 0 for fewer than two values."""
    return F.when(n < 2, 0.0).otherwise(deviation / F.greatest(F.abs(mean), F.lit(floor)))


# --- text and identity ------------------------------------------------------------------------


def role(position: Column | str) -> Column:
    """One of five roles by the first rule that hits; the order of the rules counts."""
    p = F.lower(col(position))
    has = lambda *words: F.coalesce(_any([p.contains(w) for w in words]), F.lit(False))
    return (
        F.when(has("forward", "striker", "winger") | p.isin("st", "cf", "lw", "rw"), "forward")
        .when(has("goalkeeper") | p.isin("gk"), "goalkeeper")
        .when(has("back", "defender") | p.isin("cb", "lb", "rb"), "defender")
        .when(has("defensive", "midfield") | p.isin("cm", "dm", "am"), "midfielder")
        .otherwise("unknown")
    )


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def initials(name: Column | str) -> Column:
    """Upper-case initials of up to four words; a single word's first letters, eight at most."""
    words = F.filter(F.split(F.regexp_replace(F.upper(col(name)), "[^A-Z0-9 ]", " "), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 1, F.array_join(F.transform(F.slice(words, 1, 4), lambda w: w.substr(1, 1)), "")).otherwise(F.substring(F.coalesce(F.get(words, F.lit(0)), F.lit("CLUB")), 1, 8))


def content_hash(columns: Sequence[str], digits: int = 64, md5: bool = False) -> Column:
    """SHA-256 (or MD5), its first hexadecimal digits, of a JSON object of the columns in order of name.

    Names and texts are quoted and escaped, null is null, so rows that differ have different texts.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.substring(F.md5(text) if md5 else F.sha2(text, 256), 1, digits)


def uuid5(namespace_hex: str, name: Column | str) -> Column:
    """Name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(col(name), "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def eur_text(c: Column | str) -> Column:
    """'1.5M', '500K' or the plain number; null: 'n/a'."""
    v = col(c)
    return F.when(v.isNull(), "n/a").when(v >= 1e6, F.concat(F.round(v / 1e6, 1).cast("decimal(20,1)").cast("string"), F.lit("M"))).when(v >= 1e3, F.concat(F.round(v / 1e3).cast("long").cast("string"), F.lit("K"))).otherwise(F.round(v).cast("long").cast("string"))


LOG10_50M = math.log10(50_000_000)
