"""The library's operators on small hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.operators import clubs, decisions, features, graph, lookup, models, pages, quality, resolution, scores, serving, similarity, timeseries, warehouse
from pitchlake.sources import documents
from pitchlake.streaming.refresh import TotalsStream, refresh_totals

STATS = "player_key long, seq long, match_date date, competition string, source string, minutes long, goals long, assists long, shots long, passes long, yellow long, red long, xg double"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head()


def stats(spark, rows):
    """rows of (player, day, minutes, goals); the rest is filled in."""
    return spark.createDataFrame([(p, i, dt.date(2020, 1, 1) + dt.timedelta(days=d), "liga", "A", m, g, 0, 2 * g, 20, 0, 0, None) for i, (p, d, m, g) in enumerate(rows)], STATS)


def test_scalars(spark):
    lit = F.lit
    got = one(spark, X.per_90(lit(10), lit(1000)), X.per_90(lit(10), lit(None).cast("int")), X.per_90(lit(0), lit(0)), X.money(lit("€5.2m")), X.money(lit("500k")), X.money(lit("12000000")), X.money(lit("free")), X.money(lit("1.1bn")))
    assert tuple(got) == (0.9, None, None, 5.2e6, 5e5, 1.2e7, None, pytest.approx(1.1e9))
    born = lambda s: X.birth_date(lit(s))
    got = one(spark, X.age_at(born("2001-01-01"), lit("2026-01-01").cast("date")), born("01/02/1990"), born("Jan 5, 1999"), born("5 January 1999"), born("nonsense"))
    assert tuple(got) == (25, dt.date(1990, 2, 1), dt.date(1999, 1, 5), dt.date(1999, 1, 5), None)
    got = one(spark, X.fold(lit("  José-Ñúñez_X ")), X.slug(lit("Élan, Vital!")), X.slug(lit("!!")), X.clean_text(lit("  a \t b ")), X.clean_text(lit("  ")), X.clean_int(lit("1,234.9")), X.sigmoid(lit(40.0)), X.eur_text(lit(1_540_000.0)), X.eur_text(lit(540_000.0)))
    assert tuple(got) == ("jose nunez x", "elan-vital", "unknown-player", "a b", None, 1234, 1.0, "1.5M", "540K")
    import uuid

    got = one(spark, X.uuid5("6ba7b8109dad11d180b400c04fd430c8", lit("a:b")), X.role(lit("Left-Back")), X.role(lit("Centre Forward")), X.initials(lit("Real Club de Futbol X")), X.age_curve_score(lit(None).cast("int")))
    assert tuple(got) == (str(uuid.uuid5(uuid.NAMESPACE_DNS, "a:b")), "defender", "forward", "RCDF", 50.0)


def test_totals_consistency_and_kpi(spark):
    s = stats(spark, [(1, d, 90, 1) for d in range(5)] + [(2, 0, 0, 0), (3, 0, 90, 2), (3, 5, 45, 0)])
    t = {r.player_key: r for r in features.player_totals(s).collect()}
    assert t[1].goals_per_90 == 1.0 and t[2].goals_per_90 is None and t[2].minutes_bucket == "none"
    c = {r.player_key: r.consistency for r in features.consistency(s).collect()}
    assert c[1] == 100.0 and c[2] == 0.0 and c[3] == 75.0
    players = spark.createDataFrame([(1, "forward", dt.date(2000, 1, 1))], "player_key long, position string, dob date")
    k = {r.player_key: r for r in features.kpi(s, players, F.lit("2020-06-01").cast("date")).collect()}
    assert k[1].base_kpi == round(0.45 + 2 * 0.2 + 20 * 0.15 + 0.2, 3) and k[1].age_adjusted_kpi == round(k[1].base_kpi * 1.10, 3) and k[2].age is None
    form = features.rolling_form(stats(spark, [(1, d, 90, g) for d, g in enumerate((1, 2, 3, 4, 5))]), ("goals",), (3,)).head()
    assert form.goals_last_3 == 4.0
    assert features.player_totals(s.filter("seq > 99")).count() == 0


def test_series(spark):
    s = stats(spark, [(1, d, 10, 0) for d in range(8)] + [(1, 20, 90, 9)] + [(2, d, 90, int(d >= 5)) for d in range(10)])
    found = {(r.player_key, r.metric, r.kind) for r in timeseries.spikes(s).collect()}
    assert (1, "goals", "spike") in found and (1, "minutes", "spike") in found and not any(p == 2 and k == "drop" for p, _, k in found)
    drift = {r.player_key: r for r in timeseries.career_drift(s).collect()}
    assert drift[2].direction == "improving" and drift[2].goals_drift == 1.0 and drift[1].direction == "stable"
    gaps = {r.player_key: (r.max_gap, r.mean_gap) for r in timeseries.gap_days(s).collect()}
    assert gaps[2] == (1.0, 1.0) and gaps[1][0] == 13.0
    assert {r.player_key: r.trend for r in timeseries.minutes_trend(s, 5.0).collect()} == {1: "ascending", 2: "stable"}
    slope = {r.player_key: r.slope for r in timeseries.score_slope(s).collect()}
    assert slope[2] > 0
    h = spark.createDataFrame([(1, k, c, v, 20 + k) for k, (c, v) in enumerate([("a", 10.0), ("a", 20.0), ("b", 5.0), ("a", 1.0)])], "player_key long, ord int, club string, value double, age int")
    assert [(r.club, r.rows, r.peak, r.mid_age, r.change) for r in timeseries.value_spells(h).orderBy("spell").collect()] == [("a", 2, 20.0, 21, 1.0), ("b", 1, 5.0, 22, 0.0), ("a", 1, 1.0, 23, 0.0)]


def test_scores(spark):
    s = stats(spark, [(1, d, 90, 1) for d in range(10)] + [(2, d, 90 if d % 2 else 5, 3 * (d % 3 == 0)) for d in range(10)] + [(3, 0, 20, 0)])
    players = spark.createDataFrame([(i, "P", "forward", "A", dt.date(1999, 1, 1), 1e6) for i in (1, 2, 3)], "player_key long, player_name string, position string, club string, dob date, market_value double")
    on = F.lit("2020-06-01").cast("date")
    risk = {r.player_key: r for r in scores.risk(s, players, on, features.consistency(s)).collect()}
    assert risk[2].volatility > risk[1].volatility and risk[3].injury > 0
    index = {r.player_key: r for r in scores.confidence(s, players).collect()}
    assert index[1].agreement == 0.65 and index[3].flag == "LOW_SAMPLE" and index[1].internal == 1.0
    below = {r.k: r.share_below for r in scores.share_below(spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, 9.0)], "k int, v double"), "v").collect()}
    assert below == {1: 0.0, 2: 0.25, 3: 0.25, 4: 0.75}
    with pytest.raises(ValueError):
        scores.Weights(performance=0.9)
    rules = spark.createDataFrame([(0, "serie a", 15.0), (1, "serie a (brazil)", 8.0), (2, "liga", 10.0)], "ord int, key string, value double")
    names = spark.createDataFrame([("Serie A (Brazil)",), ("La Liga",), ("serie a women",), ("none",), (None,)], "c string")
    assert [r.v for r in lookup.ordered_lookup(names, "c", rules, "v", 0.0).orderBy("c").collect()] == [0.0, 10.0, 8.0, 0.0, 15.0]


def test_clubs_and_decisions(spark):
    base = spark.createDataFrame([("A", 2, 10.0, 50.0, True), ("B", 4, 5.0, 25.0, True)], "club string, players long, mean_kpi double, mean_consistency double, live boolean")
    got = {r.club: r for r in clubs.against_baseline(base, "A").collect()}
    assert got["B"].mean_kpi_delta == -5.0 and got["B"].players_ratio == 2.0 and got["A"].is_baseline
    cols = "player_key long, age int, gap_pct double, score double, potential double, p1 double, fit double, confidence double, blended_value double, direction string, magnitude double, risk double, kpi double"
    rows = [(1, 20, 180.0, 80.0, 98.0, 0.9, 0.9, 1.0, 1e6, "improving", 0.5, 10.0, 10.0), (2, 33, -5.0, 40.0, 40.0, 0.1, 0.1, 0.5, 6e7, "declining", 1.0, 90.0, 9.0), (3, None, None, 50.0, 50.0, None, None, None, None, None, None, None, None)]
    assert {r.player_key: r.decision for r in decisions.decisions(spark.createDataFrame(rows, cols)).collect()} == {1: "BUY", 2: "SELL", 3: "HOLD"}


def test_nearest_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(60)], "key long, v array<double>")
    want = sorted(similarity.nearest(v, 3).collect())
    assert sorted(similarity.nearest(v, 3, block_rows=16).collect()) == want and len(want) == 180
    assert similarity.nearest(v.limit(1), 3).count() == 0


def test_graph(spark):
    t = spark.createDataFrame([("a", "b", 100.0), ("a", "b", 50.0), ("b", "c", 10.0), ("c", "c", 5.0)], "from_club string, to_club string, fee double")
    p = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.9)], "club string, prestige double")
    e = graph.edges(t, p)
    assert {(r.src, r.dst, r.moves) for r in e.collect()} == {("a", "b", 2), ("b", "c", 1)}
    ranks = {r.node: r["rank"] for r in graph.pagerank(e, 60).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["b"] > ranks["a"]
    assert {r.start: r.route for r in graph.routes(e, p).collect()} == {"a": "a > b > c", "b": "b > c", "c": "c"}


def test_pages(spark):
    html = """<html><title>Foo Bar - Profile | Site</title><body>Position: Winger Age: 21 Current club: Foo FC
    <!-- <table id="stats_x"><tr><th>h</th></tr><tr><td data-stat="player"><a>Jo</a></td><td data-stat="min">90</td><td data-stat="gls">1,000</td><td data-stat="xg_per90">.5</td></tr><tr><td data-stat="player"></td></tr></table> -->
    <table id="per90_x"><tr><td data-stat="player">No</td></tr></table><table><tr><td>19/20</td><td>A</td><td>B</td><td>free</td></tr><tr><td>x</td><td>A</td><td>B</td><td>1</td></tr></table>
    <a href="/p/1">One</a><a href="/p/1">again</a><a href="/q/2">x</a><script type="application/ld+json">{"a": 1}</script><script id="__NEXT_DATA__">{bad</script></body></html>"""
    p = spark.createDataFrame([(1, "https://e.org/matches/m7/x", html), (2, "u", ""), (3, "u", "Just a moment... captcha"), (4, "u", None)], "page_id long, url string, html string")
    prof = pages.profiles(p.filter("page_id = 1")).head()
    assert (prof.player_name, prof.position, prof.age) == ("Foo Bar", "Winger", "21")
    assert [tuple(r) for r in pages.player_stats(p).select("player_name", "minutes", "goals").collect()] == [("Jo", 90, 1000)]
    assert pages.per_90_maps(p).head().metrics == {"xg_per90": ".5"}
    assert [r.season for r in pages.transfer_rows(p).collect()] == ["19/20"]
    assert [(r.href, r.label) for r in pages.links(p, "^/p").collect()] == [("/p/1", "One")]
    assert pages.json_blocks(p).count() == 1
    assert [r.kind for r in pages.classify(p, "<body").orderBy("page_id").collect()] == ["ok", "empty_body", "challenge", "empty_body"]
    m = spark.createDataFrame([({"Goals": "2", "goals conceded": "9", "Total shots": "4"},)], "stats map<string,string>")
    assert tuple(pages.routed_stats(m).select("goals", "shots", "minutes").head()) == (2, 4, None)
    assert pages.diagnostics(spark.createDataFrame([("a", ""), ("a", "b")], "x string, y string"), ("x", "y")).select("status").collect()[0][0] == "success_partial"


def test_quality_and_warehouse(spark):
    s = stats(spark, [(1, 0, 90, 1), (1, 1, 500, 20), (2, 2, 0, 1)])
    v = {r.seq: r for r in quality.validate_stats(s).collect()}
    assert v[0].valid and not v[1].valid and "minutes_above_range" in v[1].issues and "goals_without_minutes" in v[2].anomalies
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(2, "B"), (3, "c")], "k int, x string")
    assert sorted(map(tuple, warehouse.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    merged = warehouse.merge_fields(spark.createDataFrame([("s", 1, "a", None), ("s", 2, "", 5), (None, 3, "z", 1)], "slug string, ord int, n string, v int"), "slug", "ord")
    assert sorted(map(tuple, merged.collect()), key=str) == [("s", "a", 5), (None, "z", 1)] or sorted(map(tuple, merged.collect()), key=str) == [(None, "z", 1), ("s", "a", 5)]
    names = spark.createDataFrame([("Real Madrid",), ("Royal Mons",), (" Real  Madrid ",), (None,)], "n string")
    assert sorted(r.short_code for r in warehouse.club_dimension([names]).collect()) == ["RM", "RM2"]
    assert {r["table"]: r.state for r in quality.readiness(spark, "/root/testdata/sf0.001", {"nation": ("n_name",), "nothing": ()}).collect()} == {"nation": "ready", "nothing": "missing"}


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"profile": {"player_name": " John  Doe", "market_value": "€1m"}, "transfers": [{"season": "19/20", "from_club": "A", "to_club": "B", "fee": "€1.0m"}], "performance_stats": [{"games_played": 0}, {"games_played": 3, "goals": 1}]}')
    (tmp_path / "b.json").write_text("{broken")
    good, bad = documents.read_documents(spark, f"file://{tmp_path}", documents.PLAYER)
    assert good.count() == 1 and bad.count() == 1
    p = documents.players(good).head()
    assert (p.player_name, p.market_value_eur) == ("John Doe", 1e6)
    assert documents.normalized_transfers(documents.document_transfers(good)).head().fee_eur == 1e6
    assert documents.season_stats(good).count() == 1
    assert {r.slug for r in documents.inventory(spark, f"file://{tmp_path}", "x").collect()} == {"a", "b"}
    assert documents.write_verified(good.select("file"), f"file://{tmp_path}/out") == 1


def test_share_below_with_one_value_far_off(spark):
    """Ranges follow the values: one of 10^12 leaves the others in many ranges."""
    values = [float(i % 700) / 7 for i in range(3000)] + [1e12, -1e9]
    t = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "k int, v double")
    got = {r.k: r.share_below for r in scores.share_below(t, "v", parts=16).collect()}
    assert got.pop(len(values)) is None
    assert all(abs(got[i] - sum(w < v for w in values) / len(values)) < 1e-12 for i, v in enumerate(values))
    assert scores.share_below(t.filter("v is null"), "v").count() == 1 and scores.share_below(t.limit(0), "v").count() == 0


def test_resolution_and_serving(spark):
    known = spark.createDataFrame([("kendry-paez", "Kendry Páez", 17, "IDV", "midfielder"), ("moises", "Moisés Caicedo", 22, None, None)], "slug string, name string, age int, club string, position string")
    records = spark.createDataFrame([(1, "kendry paez", 17, "idv", None), (2, "Nobody Known", 30, None, None), (3, "M Caicedo", 22, None, None)], "record_id long, name string, age int, club string, position string")
    found = {r.record_id: r for r in resolution.resolve(records, known).collect()}
    assert found[1].slug == "kendry-paez" and found[1].level == "confident" and 2 not in found
    assert {r.record_id: r.is_new for r in resolution.known_or_new(records, resolution.resolve(records, known)).collect()}[2]
    t = spark.createDataFrame([(i, f"Páez {i}", float(i % 3)) for i in range(9)], "k int, player_name string, v double")
    got, total = serving.page_with_total(serving.named(t, "paez"), [serving.sort_key("-v"), F.col("k")], 1, 3)
    assert total == 9 and [r.k for r in got.collect()] == [5, 8, 1]
    assert [r.winner for r in serving.side_by_side(t, "k", 1, 2, ["v"]).collect()] == ["second"]


def test_adjusted_neighbours_are_those_of_all_others(spark):
    """30 nearer players of another class and five a little farther of the same one, which win."""
    at = {0: 0.0} | {i: 0.01 + i * 0.001 for i in range(1, 31)} | {i: 0.10 + (i - 31) * 0.001 for i in range(31, 36)}
    kind = {i: "a" if i == 0 or i > 30 else None if i == 7 else "b" for i in at}
    vectors = spark.createDataFrame([(i, [x]) for i, x in at.items()], "key long, v array<double>")
    about = spark.createDataFrame(list(kind.items()), "key long, class string")
    like = F.when(F.col("ta") == F.col("tb"), 1.0).otherwise(0.3)
    got = {(r.key, r.rank): (r.other, r.adjusted) for r in similarity.nearest_adjusted(vectors, about, like, 5, block_rows=10).collect()}
    for i in at:
        same = lambda j, i=i: 1.0 if kind[i] == kind[j] and kind[i] is not None else 0.3
        want = sorted((round(0.85 * round(abs(at[i] - at[j]), 6) + 0.15 * (1 - same(j)), 6), j) for j in at if j != i)[:5]
        assert all(abs(got[i, n + 1][1] - d) < 2e-6 for n, (d, _) in enumerate(want))
    assert {got[0, n][0] for n in range(1, 6)} == set(range(31, 36))


def test_registered_jobs_are_whole(spark, monkeypatch):
    from pitchlake.plans import data_queries

    sf, seen = "/root/testdata/sf0.001", {}
    assert [c for c in data_queries.cluster_profile(spark, sf).columns if c[1:].isdigit()] == [f"d{i}" for i in range(64)]

    class Caught(Exception):
        pass

    def fit(self, _):
        seen[type(self.getStages()[-1]).__name__] = (self.getStages()[-1].getMaxIter(), self.getStages()[-1].getMaxDepth())
        raise Caught

    monkeypatch.setattr(models.Pipeline, "fit", fit)
    monkeypatch.setattr(data_queries, "training_set", lambda *_: spark.createDataFrame([(20.0, 50.0, 0.5, 1.0, 6.0)], "age double, score double, prestige double, trajectory double, label double"))
    monkeypatch.setattr(data_queries, "edges_of", lambda *_: None)
    monkeypatch.setattr(graph, "pagerank", lambda _, rounds: (_ for _ in ()).throw(Caught(rounds)))
    for run in (data_queries.market_value, data_queries.pathway_success):
        with pytest.raises(Caught):
            run(spark, sf)
    assert seen == {"GBTRegressor": (300, 4), "GBTClassifier": (200, 4)}
    with pytest.raises(Caught, match="60"):
        data_queries.pagerank(spark, sf)


def test_models(spark):
    rows = spark.createDataFrame([(i, float(i % 2 * 10 + i * 0.01), 1.0) for i in range(20)], "k long, x double, y double")
    assert len({r.cluster for r in models.k_means(rows, ["x", "y"], 2).filter("k % 2 = 0").collect()}) == 1
    assert models.k_means(rows.limit(2), ["x"], 5).select("cluster").distinct().count() == 2


def test_refresh_equals_rebuild_and_stream(spark, tmp_path):
    s = stats(spark, [(1, 0, 90, 1), (2, 1, 45, 0), (1, 2, 90, 2), (3, 3, 10, 0)])
    whole = sorted(features.player_totals(s).collect())
    stored = features.player_totals(s.filter("seq < 2"))
    assert sorted(refresh_totals(s, stored, s.filter("seq >= 2").select("player_key").distinct()).collect()) == whole
    for k in range(2):
        s.filter(f"seq div 2 = {k}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = TotalsStream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/work", s.schema)
    last = stream.run()
    assert last >= 0 and sorted(spark.read.parquet(stream.path(last)).select(*features.player_totals(s).columns).collect()) == whole


def test_registry_matches_duckdb_on_the_smallest_tables(spark):
    import os

    import duckdb

    from pitchlake.plans import all_queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    sql = all_queries.oracles()
    for name in ("player_totals", "kpi", "risk", "valuation", "edges", "stat_tables", "row_validation"):
        got, want = all_queries.queries()[name](spark, sf), db.execute(sql[name]).fetchdf()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        text = lambda rows: sorted(tuple("" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
        assert text(got.select(*columns).collect()) == text(want[columns].astype(object).where(want[columns].notna(), None).values.tolist()), name


def test_first_rows_neighbours_enrichment_and_stored_rows(spark):
    from pitchlake.operators import serving

    players = spark.createDataFrame([(1, "Ana"), (2, "Bo"), (3, None)], "player_key long, player_name string")
    near = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 3, 0.7)], "key long, rank int, other long, distance double")
    asked = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "player_key long")
    got = {(r.player_key, r.state, r.other) for r in serving.neighbours_of(asked, players, players.filter("player_key = 1"), near, 1).collect()}
    assert got == {(1, "ok", 2), (2, "no_vector", None), (9, "unknown", None), (None, "unknown", None)}
    rows = spark.createDataFrame([(1, "", "x"), (2, None, None), (7, None, "y")], "other long, club string, position string")
    lookup = spark.createDataFrame([(1, "C", "p", 5.0), (2, None, "q", None)], "other long, club string, position string, score double")
    got = {r.other: (r.club, r.position, r.score) for r in serving.enriched(rows, lookup, "other", ["score"], ["club", "position"]).collect()}
    assert got == {1: ("C", "x", 5.0), 2: (None, "q", None), 7: (None, "y", None)}
    text = spark.createDataFrame([(1, "old"), (2, None)], "player_key long, report string")
    made = spark.createDataFrame([(1, "new"), (2, "new"), (3, None)], "player_key long, report string")
    got = {tuple(r) for r in serving.stored_or_made(players.select("player_key"), text, made, "report").collect()}
    assert got == {(1, "old", "stored"), (2, "new", "generated")}
    assert serving.first_named(players, "b", [F.col("player_key")]).head().player_key == 2
    assert serving.enriched(rows.limit(0), lookup, "other", ["score"], ["club"]).count() == 0


def test_club_names_types_and_bounds(spark):
    from pitchlake.operators import clubs, quality, timeseries

    aliases = {"man utd": "Manchester United", "united": "Some United"}
    t = spark.createDataFrame([(1, " MAN UTD "), (2, "Leeds United"), (3, "  Ajax "), (4, "  "), (5, None), (6, "the man utd united")], "i int, c string")
    got = {r.i: (r.a, r.b) for r in t.select("i", clubs.canonical_club(F.col("c"), aliases).alias("a"), clubs.canonical_club(F.col("c"), aliases, False).alias("b")).collect()}
    assert got == {1: ("Manchester United",) * 2, 2: ("Some United", "Leeds United"), 3: ("Ajax", "Ajax"), 4: (None, None), 5: (None, None), 6: ("Manchester United", "the man utd united")}
    rows = spark.createDataFrame([("1", "2001-02-03"), ("x", "never"), (None, None)], "n string, d string")
    assert [r.type_issues for r in quality.type_issues(rows, {"n": "int", "d": "date"}).collect()] == [[], ["n_not_int", "d_not_date"], []]
    stats = spark.createDataFrame([(1, 96, 6, 0), (2, 121, 0, 0), (3, 90, 11, 5)], "player_key long, minutes int, goals int, assists int")
    got = {r.player_key: (r.issues, r.anomalies) for r in quality.validate_stats(stats).collect()}
    assert got[1] == ([], ["goals_unusual", "minutes_unusual"]) and got[2] == (["minutes_above_range"], ["minutes_unusual"]) and got[3] == (["goals_above_range"], ["goals_unusual", "assists_unusual"])
    spiked = spark.createDataFrame([(1, 5, "goals", "spike", 4.0), (1, 2, "goals", "drop", -4.0)], "player_key long, seq long, metric string, kind string, z double")
    drift = spark.createDataFrame([(2, "stable", 0.1)], "player_key long, direction string, magnitude double")
    got = {r.player_key: (r.anomaly_count, r.direction, r.total_anomalies, [a.seq for a in r.anomalies or []]) for r in timeseries.drift_report(spark.createDataFrame([(1,), (2,), (2,)], "player_key long"), spiked, drift).collect()}
    assert got == {1: (2, None, 2, [2, 5]), 2: (0, "stable", 2, [])}


def test_reports_are_made_once_where_they_are_read_twice(spark, monkeypatch):
    from pitchlake.plans import page_queries

    rows = spark.createDataFrame([(7, "a"), (17, None), (70, "b"), (3, "c")], "player_key long, report string")
    cuts = []
    monkeypatch.setattr(page_queries, "reports", lambda *_: rows)
    monkeypatch.setattr(page_queries, "_names", lambda *_: rows.select("player_key", F.col("player_key").cast("string").alias("player_name")))
    monkeypatch.setattr(page_queries, "cut", lambda t: cuts.append(t) or t)
    assert {tuple(r) for r in page_queries.report_stored_or_generated(spark, "").collect()} == {(7, "a", "generated"), (70, "b", "stored")}
    assert len(cuts) == 1
    asked = []
    monkeypatch.setattr(page_queries, "success_of", lambda s, d, keys: asked.append(keys) or keys.withColumn("success", F.lit(0.5)))
    monkeypatch.setattr(page_queries, "_names", lambda *_: spark.createDataFrame([(1, "x77"), (2, "y")], "player_key long, player_name string"))
    assert [r.player_key for r in page_queries.pathway_learning_page(spark, "").collect()] == [1] and asked[0].count() == 1
