"""Bucket tables, streams over them, and derived tables rebuilt along their dependencies."""

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import features
from pitchlake.streaming.cascade import Derived, changed_keys, rebuild
from pitchlake.streaming.refresh import TotalsStream
from pitchlake.streaming.store import BucketTable

STATS = "player_key long, seq long, match_date date, competition string, source string, minutes long, goals long, assists long, shots long, passes long, yellow long, red long, xg double"


def stats(spark, rows):
    t = spark.createDataFrame(rows, "player_key long, seq long, minutes long, goals long")
    extra = {"match_date": F.lit("2020-01-01").cast("date"), "competition": F.lit("x"), "source": F.lit("s"), "xg": F.lit(None).cast("double")} | {c: F.lit(0).cast("long") for c in ("assists", "shots", "passes", "yellow", "red")}
    return t.withColumns(extra).select(*[c.split()[0] for c in STATS.split(", ")])


@pytest.fixture
def store(spark, tmp_path):
    return BucketTable(spark, f"file://{tmp_path}/t", "k", spark.createDataFrame([], "k string, v int").schema, buckets=8, merge=3)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_append_replace_and_again(spark, store):
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    assert store.version() == -1 and store.read().count() == 0
    assert store.append(0, make(("a", 1), ("b", 1), ("c", 1), (None, 1)))
    assert not store.append(0, make(("a", 9)))
    assert rows_of(store.read().na.fill({"k": "-"})) == [("-", 1), ("a", 1), ("b", 1), ("c", 1)]
    before = store.manifest()
    one = store.touched(make(("a", 2)))
    assert len(one) == 1 and store.append(1, make(("a", 2)))
    changed = {b for b, made in store.manifest().items() if made != before.get(b)}
    assert changed == set(one) and rows_of(store.read(one).filter("k = 'a'")) == [("a", 1), ("a", 2)]
    # Replacing names its buckets; others may not be written.
    with pytest.raises(ValueError, match="other buckets"):
        store.replace(2, make(("a", 3)), [b for b in range(8) if b not in one][:1])
    assert store.version() == 1
    assert store.replace(2, store.read(one).filter("k <> 'a'"), one)
    assert store.read().filter("k = 'a'").count() == 0 and store.read().filter("k in ('b', 'c')").count() == 2
    assert store.read(version=1).filter("k = 'a'").count() == 2  # the version before is still there


def test_old_folders_go_and_appends_are_merged(spark, store):
    for v in range(8):
        store.append(v, spark.createDataFrame([("a", v), (f"z{v}", v)], "k string, v int"))
    assert store.read().count() == 16 and store.versions() == [6, 7]
    assert all(len(made) <= 4 for made in store.manifest().values())
    named = {v for k in store.versions() for made in store.manifest(k).values() for v in made}
    assert set(store._folders("data")) == named


def test_a_batch_of_one_player_touches_one_bucket(spark, tmp_path):
    whole = stats(spark, [(p, s, 90, s % 3) for p in range(40) for s in range(4)])
    stream = TotalsStream(spark, "none", f"file://{tmp_path}/work", whole.schema, buckets=16)
    stream.apply(whole, 0)
    before = stream.totals.manifest(), stream.seen.manifest()
    one = stats(spark, [(7, 100, 45, 2)])
    stream.apply(one, 1)
    for table, old in zip((stream.totals, stream.seen), before, strict=True):
        assert [b for b, made in table.manifest().items() if made != old[b]] == table.touched(one)
    want = sorted(features.player_totals(whole.unionByName(one)).collect())
    assert sorted(stream.current().collect()) == want
    now = stream.totals.manifest(), stream.seen.manifest()
    stream.apply(one, 1)
    assert (stream.totals.manifest(), stream.seen.manifest()) == now and sorted(stream.current().collect()) == want
    # A batch that broke off between the two tables is finished when it runs again.
    more = stats(spark, [(8, 101, 45, 2), (900, 102, 1, 1)])
    stream.seen.append(2, more)
    stream.apply(more, 2)
    assert sorted(stream.current().collect()) == sorted(features.player_totals(whole.unionByName(one).unionByName(more)).collect())


def test_changed_keys_spread(spark):
    source = lambda *rows: spark.createDataFrame(list(rows), "player_key long, v int")
    built = []

    def summed(t):
        built.append(sorted(r.player_key for r in t.select("player_key").distinct().collect()))
        return t.groupBy("player_key").agg(F.sum("v").cast("int").alias("s"))

    tables = [
        Derived("sums", ("rows",), summed),
        Derived("shares", ("sums",), lambda s: s.crossJoin(s.agg(F.sum("s").alias("all"))).select("player_key", (F.col("s") / F.col("all")).alias("share")), whole=True),
        Derived("labels", ("shares", "names"), lambda s, n: s.select("player_key", (F.col("share") > 0.3).alias("large")).crossJoin(n)),
        Derived("other", ("names",), lambda n: n.select(F.lit(1).cast("long").alias("player_key"), "name")),
    ]
    names = spark.createDataFrame([("x",)], "name string")
    old, new = source((1, 1), (2, 2), (3, 3), (4, 4)), source((1, 1), (2, 2), (3, 30), (5, 1))
    stored = {}
    for t in tables:
        stored[t.name] = t.build(*[{"rows": old, "names": names, **stored}[n] for n in t.needs])
    keys = spark.createDataFrame([(3,), (4,), (5,)], "player_key long")
    built.clear()
    now, touched = rebuild(tables, {"rows": new, "names": names}, {"rows": keys}, stored)
    full = {}
    for t in tables:
        full[t.name] = t.build(*[{"rows": new, "names": names, **full}[n] for n in t.needs])
        assert rows_of(now[t.name].select(*full[t.name].columns)) == rows_of(full[t.name])
    assert built[0] == [3, 5]
    assert rows_of(touched["sums"]) == [(3,), (4,), (5,)] and rows_of(touched["shares"]) == [(1,), (2,), (3,), (4,), (5,)]
    assert "other" not in touched  # names have not changed
    assert changed_keys(old, old, "player_key").count() == 0
