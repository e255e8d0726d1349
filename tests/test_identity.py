"""Upserts by alternative keys against plain Python."""

import random

from pyspark.sql import functions as F

from pitchlake.operators import identity

KEYS = (("ext",), ("day", "club"))
NEW = "line long, ext string, day int, club string, score long, note string"
OLD = "id string, ext string, day int, club string, score long, note string"


def plain(old, new):
    stored = {r[0]: dict(zip(("ext", "day", "club", "score", "note"), r[1:], strict=True)) for r in old}
    texts = lambda r: [(i, "|".join(str(r[c]) for c in k)) for i, k in enumerate(KEYS) if all(r[c] is not None for c in k)]
    known = {}
    for i, r in stored.items():
        for t in texts(r):
            known[t] = min(known.get(t, i), i)
    rows = {r[0]: dict(zip(("ext", "day", "club", "score", "note"), r[1:], strict=True)) for r in new}
    told, fresh = {}, {}
    for line, r in rows.items():
        hit = [known[t] for t in sorted(texts(r)) if t in known]
        told[line] = (None, "failed") if not texts(r) else (None, "conflict") if len(set(hit)) > 1 else (hit[0], "update") if hit else (None, "insert")
        if told[line][1] == "insert":
            fresh[line] = texts(r)
    groups = {line: {line} for line in fresh}
    for a in fresh:
        for b in fresh:
            if set(fresh[a]) & set(fresh[b]) and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[a]:
                    groups[x] = groups[a]
    for line in fresh:
        told[line] = ("new:" + min(t for x in groups[line] for t in fresh[x])[1], "insert")
    for line in sorted(rows):
        i, action = told[line]
        if action in ("update", "insert"):
            at = stored.setdefault(i, dict.fromkeys(("ext", "day", "club", "score", "note")))
            at.update({c: v for c, v in rows[line].items() if v is not None})
    return stored, told


def test_upserts_match_plain_python(spark):
    seen = set()
    for seed in range(3):
        r = random.Random(seed)
        some = lambda values, r=r: r.choice([None, *values])
        old = [(f"o{i}", some([f"e{i}"]), r.randrange(8), r.choice("ABC"), r.randrange(9), None) for i in range(10)]
        new = [(i, some([f"e{r.randrange(14)}", f"f{r.randrange(9)}"]), some(range(30)), some("ABC"), some(range(100)), some(["x", "y"])) for i in range(60)]
        table, told = identity.upsert_by(spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW), "line", KEYS, "id")
        stored, want = plain(old, new)
        assert {x.line: (x.id, x.action) for x in told.collect()} == want
        assert {x.id: {c: x[c] for c in ("ext", "day", "club", "score", "note")} for x in table.collect()} == stored
        seen |= {a for _, a in want.values()}
        report = identity.upsert_report(told, "t").first()
        actions = [a for _, a in want.values()]
        inserted = len({i for i, a in want.values() if a == "insert"})
        assert (report.attempted, report.inserted, report.updated, report.skipped, report.failed) == (60, inserted, actions.count("update") + actions.count("insert") - inserted, actions.count("conflict"), actions.count("failed"))
        assert report.status == "success_partial"
        assert [x.line for x in identity.error_rows(told, "line", 4).collect()] == sorted(i for i, (_, a) in want.items() if a in ("conflict", "failed"))[:4]
    assert seen == {"update", "insert", "conflict", "failed"}


def test_a_long_chain_and_a_key_that_most_rows_have(spark):
    """40 rows, each sharing one key with the next, and 200 that share one key."""
    chain = [(i, f"c{i // 2}", (i + 1) // 2, "A", i, None) for i in range(40)]
    many = [(100 + i, "hot", None, None, i, None) for i in range(200)]
    found = {r.line: r.first for r in identity.connected(spark.createDataFrame(chain + many, NEW), "line", KEYS).collect()}
    assert {found[i] for i in range(40)} == {0} and {found[100 + i] for i in range(200)} == {100}


def test_nothing_new_and_nothing_stored(spark):
    old, none = [("o1", "e", 1, "A", 2, None)], []
    table, told = identity.upsert_by(spark.createDataFrame(old, OLD), spark.createDataFrame(none, NEW), "line", KEYS, "id")
    assert [tuple(r) for r in table.select("id", "ext", "day", "club", "score", "note").collect()] == old and told.count() == 0
    assert identity.upsert_report(told, "t").first().status == "success_complete"
    table, told = identity.upsert_by(spark.createDataFrame(none, OLD), spark.createDataFrame([(1, None, 1, "A", 5, "x"), (1, None, 1, "A", 5, "x")], NEW).distinct(), "line", KEYS, "id")
    assert [tuple(r) for r in table.select("id", "score").collect()] == [("new:1|A", 5)]
    t = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert [tuple(r) for r in identity.smallest(t, ["k"], 2, ["k"]).collect()] == [(1, 1), (2, 2)] and identity.smallest(t.filter(F.lit(False)), ["k"], 2, ["k"]).count() == 0
