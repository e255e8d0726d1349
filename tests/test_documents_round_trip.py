"""Documents a line each, and tables published together or not at all."""

import os

import pytest

from pitchlake.sources import documents


def test_lines_with_broken_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"profile": {"player_name": "A"}, "transfers": null, "performance_stats": [{"games_played": 0}, {"games_played": 2, "goals": null}, null]}\n{"profile": null}\n{cut\n[1]\n"text"\n\n{"profile": {"player_name": "B", "extra": 1}}\n')
    (tmp_path / "b.json").write_text("")
    good, bad = documents.read_documents(spark, f"file://{tmp_path}", documents.PLAYER, lines=True)
    assert sorted(r.player_name for r in documents.players(good).collect()) == ["A", "B"]
    assert bad.count() == 4
    assert [(r.player_name, r.games_played, r.goals) for r in documents.season_stats(good).collect()] == [("A", 2, None)]
    assert documents.document_transfers(good).count() == 0 and documents.match_stats(spark.createDataFrame([], documents.MATCH).withColumn("file", documents.F.lit(""))).count() == 0


def test_union_keeps_what_each_source_has(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(3, 4.0), (3, 4.0)], "k int, y double")
    assert sorted(map(str, documents.union_stats(a, b).collect())) == sorted(["Row(k=1, x=2, y=None)", "Row(k=3, x=None, y=4.0)", "Row(k=3, x=None, y=4.0)"])


def test_both_tables_or_none(spark, tmp_path, monkeypatch):
    a, b = spark.range(3).toDF("a"), spark.range(0).toDF("b")
    report = documents.publish({"a": a, "b": b}, f"file://{tmp_path}/one")
    assert sorted(map(tuple, report.collect())) == [("a", 3, "published"), ("b", 0, "published")]
    assert documents.published(spark, f"file://{tmp_path}/one", "a").count() == 3
    verified = documents.write_verified

    def fails(df, path):
        if path.endswith("/b"):
            raise ValueError("rows differ")
        return verified(df, path)

    monkeypatch.setattr(documents, "write_verified", fails)
    report = documents.publish({"a": a, "b": b}, f"file://{tmp_path}/two")
    assert sorted(map(tuple, report.collect())) == [("a", 3, "withheld"), ("b", -1, "withheld")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not published"):
        documents.published(spark, f"file://{tmp_path}/two", "a")


def test_documents_to_read_are_compressed_and_not_gathered_in_three_files(spark):
    from pitchlake.plans import document_queries

    sf = "/root/testdata/sf0.001"
    docs = document_queries.player_documents(spark, sf).repartition(7)
    path = document_queries._written(docs, spark, files=None, compression="gzip").removeprefix("file://")
    plain = document_queries._written(docs, spark, broken=False).removeprefix("file://")
    size = lambda p, end: [os.path.getsize(f"{p}/{f}") for f in os.listdir(p) if f.endswith(end)]
    assert len(size(path, ".json.gz")) == 7 and len(size(plain, ".json")) == 3 and sum(size(path, ".gz")) * 3 < sum(size(plain, ".json"))
    good, bad = documents.read_documents(spark, path, documents.PLAYER, lines=True)
    assert (good.count(), bad.count()) == (docs.count(), 2)
    assert any(f.endswith(".json.gz") for r in document_queries.read_players(spark, sf).select("file").distinct().collect() for f in r)
