"""Records from raw pages (page_id, url, html), with regular expressions on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X

CHALLENGE = ("just a moment", "cf-challenge", "captcha", "access denied", "attention required")


def text_of(html: Column) -> Column:
    """Markup as spaces, the common entities as characters, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return X.clean_text(t)


def first(html: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, pattern, group)), F.lit(""))


def title(html: Column) -> Column:
    """The name in JSON-LD, else og:title, else <title>, without what follows ' - ' or ' | '."""
    raw = F.coalesce(
        first(html, r'(?is)<script[^>]*application/ld\+json[^>]*>.*?"name"\s*:\s*"([^"]+)"'),
        first(html, r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'),
        first(html, r"(?is)<title[^>]*>(.*?)</title>"),
    )
    return X.clean_text(F.regexp_replace(raw, r"\s+[-|]\s+.*$", ""))


def labelled(text: Column, label: str, stops: tuple[str, ...]) -> Column:
    """What follows 'label:' up to the next known label."""
    stop = "|".join(stops)
    return X.clean_text(F.nullif(F.regexp_extract(text, rf"(?i)\b{label}\s*:\s*(.+?)(?=\s+(?:{stop})\s*:|$)", 1), F.lit("")))


LABELS = ("Position", "Date of birth", "Nationality", "Current club", "Market value", "Age", "Height", "Foot", "Contract expires")


def profiles(pages: DataFrame) -> DataFrame:
    text = text_of(F.col("html"))
    fields = {label.lower().replace(" ", "_"): labelled(F.col("__text"), label, LABELS) for label in LABELS}
    return pages.withColumn("__text", text).select("page_id", "url", title(F.col("html")).alias("player_name"), *[v.alias(k) for k, v in fields.items()])


def rows_of(html: Column) -> Column:
    """array of rows, each an array of cells' inner HTML."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))


def transfer_rows(pages: DataFrame) -> DataFrame:
    """Rows of at least four cells whose first looks like a season and whose third or fourth holds something."""
    t = pages.select("page_id", F.posexplode(rows_of(F.col("html"))).alias("row", "cells")).withColumn("c", F.transform("cells", lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", " "))))
    cell = lambda i: F.get("c", F.lit(i))
    something = ~cell(2).isin("-", "?", "") | ~cell(3).isin("-", "?", "")
    ok = (F.size("c") >= 4) & cell(0).rlike(r"^\d{2}/\d{2}$|^\d{4}(/\d{2,4})?$") & something
    return t.filter(ok).select("page_id", "row", *[cell(i).alias(n) for i, n in enumerate(("season", "from_club", "to_club", "fee"))])


def stat_cells(pages: DataFrame, hint: str = "stats") -> DataFrame:
    """(page_id, row, stats map) of the rows in tables whose id has the hint and not 'per90'; comments are opened first.

    Header rows, and rows where every stat is empty, are left out.
    """
    html = F.regexp_replace(F.col("html"), r"<!--|-->", "")
    tables = F.regexp_extract_all(html, F.lit(rf'(?is)<table[^>]*id="(?![^"]*per90)[^"]*{hint}[^"]*"[^>]*>(.*?)</table>'), F.lit(1))
    t = pages.select("page_id", F.posexplode(tables).alias("table", "body")).select("page_id", "table", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    keys = F.regexp_extract_all("tr", F.lit(r'(?is)<td[^>]*data-stat="([^"]+)"[^>]*>.*?</td>'), F.lit(1))
    values = F.transform(F.regexp_extract_all("tr", F.lit(r'(?is)<td[^>]*data-stat="[^"]+"[^>]*>(.*?)</td>'), F.lit(1)), lambda v: F.trim(F.regexp_replace(v, "<[^>]+>", "")))
    t = t.withColumns({"k": keys, "v": values}).filter(F.size("k") > 0)
    pairs = F.map_from_entries(F.array_distinct(F.arrays_zip("k", "v")))
    return t.withColumn("stats", pairs).filter(F.exists(F.map_values("stats"), lambda v: v != "")).select("page_id", "table", "row", "stats")


def player_stats(pages: DataFrame) -> DataFrame:
    """Stat rows with their columns' other names resolved."""
    s = F.col("stats")
    number = lambda *names: X.clean_int(F.coalesce(*[s[n] for n in names]))
    return stat_cells(pages).select(
        "page_id", "row", X.clean_text(F.coalesce(s["player"], s["player_name"])).alias("player_name"),
        number("minutes", "min").alias("minutes"), number("goals", "gls").alias("goals"), number("assists", "ast").alias("assists"), number("shots", "sh").alias("shots"), X.clean_number(s["xg"]).alias("xg"),
    )


def per_90_maps(pages: DataFrame) -> DataFrame:
    """The stats of each row whose key ends in per90 and that are not empty."""
    return stat_cells(pages).select("page_id", "row", F.map_filter("stats", lambda k, v: k.rlike("per90$") & (v != "")).alias("metrics"))


def match_header(pages: DataFrame) -> DataFrame:
    t = title(F.col("html"))
    score = r"(\d+)\s*[–-]\s*(\d+)"
    teams = r"^(.+?)\s+(?:vs\.?|\d+\s*[–-]\s*\d+)\s+(.+)$"
    raw = first(F.col("html"), r"(?is)<title[^>]*>(.*?)</title>")
    return pages.select(
        "page_id", first(F.col("url"), r"/matches/([^/?#]+)").alias("external_id"), first(F.col("html"), r'(?is)<time[^>]*datetime="([^"]+)"').alias("match_date"),
        X.clean_text(F.nullif(F.regexp_extract(raw, teams, 1), F.lit(""))).alias("home_club"), X.clean_text(F.nullif(F.regexp_extract(raw, teams, 2), F.lit(""))).alias("away_club"),
        F.regexp_extract(raw, score, 1).try_cast("int").alias("home_score"), F.regexp_extract(raw, score, 2).try_cast("int").alias("away_score"), t.alias("title"),
    )


def json_blocks(pages: DataFrame) -> DataFrame:
    """Every JSON-LD and __NEXT_DATA__ block that parses."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*(?:application/ld\+json|id="__NEXT_DATA__")[^>]*>(.*?)</script>'), F.lit(1))
    t = pages.select("page_id", F.posexplode(blocks).alias("block", "json"))
    return t.filter(F.try_parse_json("json").isNotNull()).select("page_id", "block", "json")


#: Fixed names: variables that pages assign their data to.
BLOB = r"(?:window\.__data|__DATA__|__NEXT_DATA__)\s*=\s*(?=\{)"
#: A JSON string with its escapes, a brace, or a run of anything else; nothing of it is tried twice.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}]|[^{}"]++'


def balanced(text: Column) -> Column:
    """The object that text begins with, up to the brace that closes the first; null if none does.

    Braces in strings do not count, nor do quotes behind a backslash. Each token is looked at once.
    """
    step = lambda t: F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def take(a: Column, t: Column) -> Column:
        depth = a["depth"] + step(t)
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["size"] + F.length(t)).alias("size"), (depth == 0).alias("done")))

    found = F.aggregate(F.regexp_extract_all(text, F.lit("(?s)" + _TOKEN), F.lit(0)), start, take)
    return F.when(text.startswith("{") & found["done"], text.substr(F.lit(1), found["size"]))


def embedded_objects(pages: DataFrame) -> DataFrame:
    """(page_id, block, json): the JSON objects that scripts of a page assign to the names in BLOB, numbered as they come.

    An object may have braces and '};' inside, in strings too. What is cut off or no JSON is left out.
    Pages without text give no rows.
    """
    parts = F.slice(F.split("html", BLOB, -1), 2, F.size(F.split("html", BLOB, -1)))
    t = pages.select("page_id", F.posexplode(F.transform(parts, balanced)).alias("at", "json")).filter(F.col("json").isNotNull() & F.try_parse_json("json").isNotNull())
    return t.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1).alias("block"), "json")


#: Fixed rules: target column, what its key has, what its key must not have.
ROUTES = (("goals", "goal", "conceded"), ("assists", "assist", None), ("shots", "shot", None), ("minutes", "minute", None), ("passes", "pass", None))


def routed_stats(rows: DataFrame, stats: str = "stats") -> DataFrame:
    """Columns from a stats map by parts of its keys; the last entry that fits wins."""
    entries = F.map_entries(stats)

    def pick(word: str, never: str | None) -> Column:
        def fits(e: Column) -> Column:
            key = F.lower(e["key"])
            return key.contains(word) & ~key.contains(never) if never else key.contains(word)

        return F.try_element_at(F.filter(entries, fits), F.lit(-1))["value"]

    return rows.select(*[c for c in rows.columns if c != stats], *[X.clean_int(pick(w, n)).alias(c) for c, w, n in ROUTES])


def classify(pages: DataFrame, selector: str = "<article", status: str | None = None) -> DataFrame:
    """challenge, http_error, empty_body, comment_wrapped, ok or selector_missing, in that order."""
    body = F.lower(F.coalesce("html", F.lit("")))
    hits = F.filter(F.array(*[F.when(body.contains(m), m) for m in CHALLENGE]), lambda m: m.isNotNull())
    code = F.col(status) if status else F.lit(200)
    commented = body.rlike(r"(?s)<!--[^>]*" + selector)
    kind = F.when(F.size(hits) > 0, "challenge").when(code >= 400, "http_error").when(F.trim(body) == "", "empty_body").when(commented, "comment_wrapped").when(body.contains(selector), "ok").otherwise("selector_missing")
    return pages.select("page_id", kind.alias("kind"), F.size(hits).alias("markers"))


def links(pages: DataFrame, pattern: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, href, label, position): each target once a page, where it comes first; labels of one character are no links."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(2)).alias("label")
    )
    t = pages.select("page_id", F.posexplode(found).alias("position", "a")).select("page_id", "position", "a.href", F.trim(F.regexp_replace("a.label", "<[^>]+>", "")).alias("label"))
    t = t.filter(F.col("href").rlike(pattern) & (F.length("label") > 1))
    for word in exclude:
        t = t.filter(~F.col("href").contains(word))
    w = Window.partitionBy("page_id", "href").orderBy("position")
    return t.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def diagnostics(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """rows with missing (array of required columns without a value) and status."""
    present = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    missing = F.array_compact(F.array(*[F.when(~present(c), F.lit(c)) for c in required]))
    t = rows.withColumn("missing", missing)
    return t.withColumn("status", F.when(F.size("missing") == 0, "success_complete").when(F.size("missing") < len(required), "success_partial").otherwise("schema_invalid"))
