"""Seeded clusters against plain Python, and embedded objects of pages."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import models, pages


def drawn(seed, step, key):
    return (int(hashlib.md5(f"{seed}:{step}:{key}".encode()).hexdigest()[:13], 16) + 1.0) / (1 << 52)


def plain(rows, k, rounds=100, seed=42):
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    centres = []
    for step in range(k):
        races = []
        for key, v in rows.items():
            u, d = drawn(seed, step, key), min((apart(v, c) for c in centres), default=1)
            races.append((-math.log(u) / d if d else math.inf, u, key, v))
        centres.append(min(races)[3])
    first = list(centres)
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for v in rows.values():
            groups[min(range(k), key=lambda j: (apart(v, centres[j]), j))].append(v)
        moved = [[(2 * sum(c) + len(g)) // (2 * len(g)) for c in zip(*g, strict=True)] if g else old for g, old in zip(groups, centres, strict=True)]
        if moved == centres:
            break
        centres = moved
    return first, centres, {key: min(range(k), key=lambda j: (apart(v, centres[j]), j)) for key, v in rows.items()}


def test_seeds_centres_and_clusters_match_plain_python(spark):
    r = random.Random(1)
    rows = {i: [r.randrange(1_000_000) for _ in range(8)] for i in range(300)} | {900 + i: [5] * 8 for i in range(30)}
    t = spark.createDataFrame(list(rows.items()), "key long, v array<bigint>")
    first, centres, clusters = plain(rows, 5)
    assert models.first_centres(t, 5) == first
    found, got = models.seeded_clusters(t)
    assert got == centres and {x.key: x.cluster for x in found.collect()} == clusters
    assert models.seeded_clusters(t.repartition(7))[1] == centres
    few, _ = models.seeded_clusters(t.filter("key < 4"))
    assert sorted(x.cluster for x in few.collect()) == [0, 1, 2, 3]
    same = spark.createDataFrame([(i, [1, 1]) for i in range(9)], "key long, v array<bigint>")
    assert {x.cluster for x in models.seeded_clusters(same, 3)[0].collect()} == {0}
    assert models.seeded_clusters(t.limit(0))[0].count() == 0


def test_features_stay_in_their_ranges(spark):
    t = spark.createDataFrame([(0.6, None, 99.0, 40.0, 0.2, 0.1, 4000, None), (None,) * 8, (-1.0, 0.0, 3.0, 80.0, 0.8, 0.5, 1500, 38)], "goals_per_90 double, assists_per_90 double, shots_per_90 double, passes_per_90 double, xg_per_90 double, xa_per_90 double, minutes int, age int")
    got = [list(r.v) for r in t.select(models.in_ranges(t).alias("v")).collect()]
    assert got == [[500000, 0, 1000000, 500000, 250000, 200000, 1000000, 304348], [0, 0, 0, 0, 0, 0, 0, 304348], [0, 0, 500000, 1000000, 1000000, 1000000, 500000, 1000000]]


def test_intervals_hold_most_values(spark):
    """The error of the log decides the width; distrust widens it; about two thirds of the samples lie within."""
    r = random.Random(4)
    rows = [(float(a := r.randint(17, 34)), s := r.uniform(40, 100), p := r.random(), 5.0 + s / 50 + p - abs(a - 25) / 20 + r.gauss(0, 0.2)) for _ in range(400)]
    t = spark.createDataFrame(rows, "age double, score double, prestige double, label double")
    model = models.fit_value_model(t, ["age", "score", "prestige"], trees=12)
    error = models.log_error(model, t)
    assert 0.1 < error < 0.5 and models.log_error(model, t.limit(0)) == 0.35
    low, high = models.interval(F.pow(F.lit(10.0), F.col("prediction")), error, F.lit(1.0))
    truth = F.pow(F.lit(10.0), F.col("label"))
    assert 0.6 < model.transform(t).select(((truth >= low) & (truth <= high)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0] < 0.8
    one = spark.range(1).select(*models.interval(F.lit(1e6), 0.2, F.lit(0.5)), models.value_confidence(F.lit(None).cast("double"), F.lit(5.0), F.lit(True)), models.value_confidence(F.lit(0.9), F.lit(5.0), F.lit(True)), models.value_confidence(F.lit(0.4), F.lit(None).cast("double"), F.lit(False))).first()
    assert [one[0], one[1]] == [round(1e6 * 10**-0.25), round(1e6 * 10**0.25)] and list(one)[2:] == [0.95, 1.0, 0.4]


def test_objects_end_where_their_brace_closes(spark):
    whole = ['{"a": "};"}', '{"a": {"b": "\\\\"}, "c": "}\\""}', "{}", json.dumps({"x": [{"y": "{" * 50}] * 200})]
    cut = ['{"a": 1', '{"a": "}', "", "x{}", '{"a": "\\"}']
    t = spark.createDataFrame([(s,) for s in [*(w + "; more } and \"" for w in whole), *cut]], "s string")
    assert [r.b for r in t.select(pages.balanced(F.col("s")).alias("b")).collect()] == whole + [None] * len(cut)
    page = "<p>{</p><script>window.__data = " + whole[1] + ";</script>x __DATA__={bad};" + '__NEXT_DATA__= {"n": 1} window.__data={"open": {'
    found = pages.embedded_objects(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "window.__data = [1]")], "page_id long, html string")).collect()
    assert [tuple(r) for r in found] == [(1, 0, whole[1]), (1, 1, '{"n": 1}')]


def test_a_long_object_takes_time_in_proportion(spark):
    blob = json.dumps({"rows": [{"k": f"v{i}}}{{", "d": {"e": [1, 2, {"f": '\\"}'}]}} for i in range(20_000)]})
    t = spark.createDataFrame([(1, "window.__data = " + blob + ";")], "page_id long, html string")
    assert pages.embedded_objects(t).first().json == blob


def test_trees_are_grown_on_bins_with_weights(spark, monkeypatch):
    rows = spark.range(20000).selectExpr("id", "cast(20 + id % 5 as double) as age", "cast(id * 7919 % 20000 as double) as score", "0.85d as same", "age / 10 + floor(score / 625) / 8 + id % 3 as label")
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, t: seen.append(t) or fit(self, t))
    model = models.fit_value_model(rows, ["age", "score", "same"], trees=8)
    size, weight, label = seen[0].agg(F.count("*"), F.sum("weight"), F.sum(F.col("label") * F.col("weight"))).head()
    assert size <= 5 * models.BINS * models.LOTS and weight == 20000 and label == pytest.approx(rows.agg(F.sum("label")).head()[0])
    by_row = model.transform(rows).agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) * (F.col("label") - F.col("prediction"))))).head()[0]
    assert models.log_error(model, rows) == pytest.approx(by_row) and by_row < 1.5
    many = models.fit_success_model(rows.withColumn("label", (F.col("age") >= 23).cast("double")), ["age", "score"], trees=4)
    assert seen[1].agg(F.sum("weight")).head()[0] == 20000 and seen[1].filter("label not in (0.0, 1.0)").count() == 0
    found = {r.age: r.success for r in models.success(many, rows.filter("id < 5").select("id", "age", "score")).collect()}
    assert found[20.0] < 0.5 < found[24.0]
