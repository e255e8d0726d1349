"""Secret scans, in Spark expressions only.

Base patterns (assignments, access keys, long hex runs) and, beside them, candidate strings
whose Shannon entropy in a sliding window is high for their character class. The window's
entropy is kept by incremental counts: one character in, one out, and only their two terms of
the sum change. Candidates on the allow list are suppressed; base spans never are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.shared import let, quoted, running

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short is dropped as a whole, so asking for the length at once finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates start where a run starts and have a digit, or a capital behind a small letter three times; other letters alone are words.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|(?:[A-Za-z+/_-]*?[a-z][A-Z]){3})[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Characters that an entropy span keeps, at least, beside base spans that lie in it.
SHORTEST = 8
#: Bits per character that a window must reach, by class. A window of 20 has 4.32 at most.
THRESHOLDS = {"hex": 3.2, "letters": 4.0, "alnum": 3.7, "base64": 3.9}
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[0-9-]+$",  # numbers, dates, telephone numbers
    r"^(?:[A-Za-z]{1,24}[-_/])+[0-9]{1,6}$",  # paths and names that end with a number
    r"(?i)example|sample|placeholder|xxxx|0123456789|abcdefgh",
)
_FIRST, _SLOTS = ord("+"), ord("z") - ord("+") + 1


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _starts(text: Column, found: Column, pattern: str) -> Column:
    """Where each of the matches `found` starts: running sums of the gaps and of the matches between."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.transform(F.slice(gaps, 1, F.size(found)), lambda g, i: g + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
    return F.when(F.size(found) > 0, running(steps)).otherwise(F.array().cast("array<int>"))


def _located(starts: Column, found: Column, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start,kind,end>> of the matches `found`; keep says by their index which of them."""
    spans = F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(F.get(found, i))).alias("end")))
    return spans if keep is None else F.filter(spans, lambda s, i: keep(i))


def _first_not(spans: Column, holds: Callable[[Column], Column]) -> Column:
    """How many spans at the array's start hold, where all that do stand before all that do not; a binary search."""
    n = F.size(spans)
    halves = F.sequence(F.ceil(F.log2(n + 1.0)).cast("int"), F.lit(0))

    def further(at: Column, k: Column) -> Column:
        return let(at + F.pow(2.0, k).cast("int"), lambda to: F.when((to <= n) & F.coalesce(holds(F.get(spans, to - 1)), F.lit(False)), to).otherwise(at))

    return F.aggregate(halves, F.lit(0), further)


def _touched(spans: Column, start: Column, end: Column) -> Column:
    """(low, high): where the spans that have a place from start to end (exclusive) begin and end; nulls if none has.

    The spans are in order and do not overlap, so those that touch are a run of them, found by its ends.
    """
    ends = F.struct(_first_not(spans, lambda b: b["end"] <= start).alias("first"), _first_not(spans, lambda b: b["start"] < end).alias("behind"))
    some = lambda r, v: F.when(r["first"] < r["behind"], v)
    return let(ends, lambda r: F.struct(some(r, F.get(spans, r["first"])["start"]).alias("low"), some(r, F.get(spans, r["behind"] - 1)["end"]).alias("high")))


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, over windows of s ('+' to 'z' only; else 0).

    Counts are the characters of a text, one for each of '+' to 'z'; a step of the window overlays two of them.
    """
    place = lambda c: F.ascii(c) - (_FIRST - 1)
    count = lambda n, c: F.ascii(F.substring(n, place(c), F.lit(1))) - ord("0")
    put = lambda n, c, v: F.overlay(n, F.char(v + ord("0")), place(c), F.lit(1))
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def leave(acc: Column, old: Column) -> Column:
        return let(count(acc["n"], old), lambda n: F.struct(put(acc["n"], old, n - 1).alias("n"), (acc["total"] - term(n) + term(n - 1)).alias("total"), acc["best"].alias("best")))

    def enter(acc: Column, new: Column, full: Column) -> Column:
        def put_in(n: Column) -> Column:
            total = acc["total"] - term(n) + term(n + 1)
            bits = F.when(full, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(put(acc["n"], new, n + 1).alias("n"), total.alias("total"), F.greatest(acc["best"], bits).alias("best"))

        return let(count(acc["n"], new), put_in)

    def over(chars: Column) -> Column:
        left = lambda acc, i: F.when(i >= window, leave(acc, F.get(chars, i - window))).otherwise(acc)
        start = F.struct(F.lit("0" * _SLOTS).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), start, lambda acc, i: let(left(acc, i), lambda a: enter(a, F.get(chars, i), i >= window - 1)), lambda a: a["best"])

    return let(F.split(s, ""), over)


def scan(docs: DataFrame, allow: Sequence[str] = ALLOW, thresholds: dict[str, float] = THRESHOLDS, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_spans, spans.

    Spans are structs (start, kind as index into KINDS, end) in code points, end exclusive, by
    start and then kind. Matches of a kind are leftmost and do not overlap. Null text counts as
    empty: no spans. An entropy span is a whole candidate of which some window reaches its class's
    threshold; where base spans lie in it, it is what is before the first and behind the last of
    each kind's spans that touch it, if that has SHORTEST characters. Equal rows give equal rows;
    other columns of docs are not read. Work per document is in proportion to its text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(n) for n, p in patterns.items()])
    values = F.when(F.size("assign") > 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)))
    located = found.select("*", values.alias("values"), *[_starts(F.col("t"), F.col(n), p).alias(f"{n}_at") for n, p in patterns.items()])
    spans = located.select(
        "doc_id",
        "candidate",
        "candidate_at",
        let(F.col("values"), lambda v: _located(F.col("assign_at"), F.col("assign"), 0, lambda i: F.length(F.get(v, i)) >= 8)).alias("assign"),
        _located(F.col("access_at"), F.col("access"), 1).alias("access"),
        _located(F.col("hex_at"), F.col("hex"), 2).alias("hex"),
    )

    def suspicious(c: Column) -> Column:
        need = F.when(c.rlike("^[0-9a-fA-F]+$"), thresholds["hex"]).when(c.rlike("^[A-Za-z]+$"), thresholds["letters"]).when(c.rlike("^[A-Za-z0-9]+$"), thresholds["alnum"]).otherwise(thresholds["base64"])
        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | c.rlike(p)
        return F.when(allowed, F.lit(False)).otherwise(window_entropy(c, window) >= need)

    entropy = _located(F.col("candidate_at"), F.col("candidate"), 3, lambda i: suspicious(F.get("candidate", i)))
    spans = spans.withColumn("base_spans", F.array_sort(F.concat("assign", "access", "hex"))).withColumn("entropy", entropy)
    part = lambda a, b: F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end"))

    def beside(e: Column) -> Column:
        """The entropy span, or its parts in front of and behind all base spans that touch it."""

        def parts(t: list[Column]) -> Column:
            low, high = F.least(*[x["low"] for x in t]), F.greatest(*[x["high"] for x in t])
            return F.when(low.isNull(), F.array(e)).otherwise(F.filter(F.array(part(e["start"], low), part(high, e["end"])), lambda p: p["end"] - p["start"] >= SHORTEST))

        return let(F.array(*[_touched(F.col(k), e["start"], e["end"]) for k in ("assign", "access", "hex")]), lambda t: parts([F.get(t, i) for i in range(3)]))

    added = F.flatten(F.transform("entropy", lambda e: beside(e).cast(_SPANS)))
    return spans.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        "base_spans",
        F.array_sort(F.concat("base_spans", added)).alias("spans"),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """docs with every span of scan() replaced by mask; rows, order of columns and other columns stay.

    Needs an id without repeats to bring spans and rows together; null text stays null.
    """
    spans = scan(docs, **options).select(F.col("doc_id").alias("__scan_id"), F.col("spans").alias("__spans"))
    joined = docs.join(spans.dropDuplicates(["__scan_id"]), F.col("doc_id").eqNullSafe(F.col("__scan_id")), "left")
    done = F.aggregate(
        F.col("__spans"),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.col("text").substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mask)).alias("out"), s["end"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size("__spans") > 0, done).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else docs[quoted(c)] for c in docs.columns])
