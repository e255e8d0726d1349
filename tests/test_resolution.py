"""Entity resolution against all pairs in plain Python."""

import random
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.operators import resolution

SCHEMA = "name string, age int, club string, position string, n string, key long, side int"


def table(spark, id_col, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], f"{id_col} long, {SCHEMA}")


def similarity(a, b, measure):
    if a == b:
        return 1.0
    if measure == "ratio":
        s = SequenceMatcher(None, a, b).ratio()
    else:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        s = 1.0 - row[-1] / max(len(a), len(b), 1)
    return max(s, 0.85) if a in b or b in a else s


def plain(name):
    bare = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c)).lower()
    return " ".join("".join(c for c in bare if c.isalnum() or c in "_ \t\n").split())


def drawn(seed, n, letters, words=(1, 3), size=(1, 9)):
    r = random.Random(seed)
    names = [" ".join("".join(r.choice(letters) for _ in range(r.randint(*size))) for _ in range(r.randint(*words))) for _ in range(n)]
    for name in list(names):  # a variant of each with a few characters changed, dropped, put in or moved
        c = list(name)
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(c) + 1)
            r.choice([lambda: c.insert(at, r.choice(letters)), lambda: c.pop(min(at, len(c) - 1)) if len(c) > 1 else None, lambda: c.reverse() if r.random() < 0.02 else None])()
        names.append("".join(c))
    return [n for n in dict.fromkeys(" ".join(n.split()) for n in names) if n]


def all_pairs(asked, known, measure):
    return {(a, b) for a in asked for b in known if similarity(a, b, measure) >= 0.80}


def test_all_similar_names_are_found(spark):
    """Short and long names, few and many letters, names that share no word or hold each other."""
    for seed, letters, words, size in ((1, "ab", (1, 2), (1, 6)), (2, "abcdefghij", (1, 3), (2, 9)), (3, "aeimnorst", (3, 9), (4, 8))):
        names = drawn(seed, 90, letters, words, size)
        asked, known = names[::2] + names[:9], names[1::2] + names[:5]
        one, two = (spark.createDataFrame([(n,) for n in sorted(set(x))], "name string") for x in (asked, known))
        for measure in ("ratio", "edit"):
            found = resolution.similar_names(one, two, measure).collect()
            assert len(found) == len({(r.n, r.m) for r in found})
            assert {(r.n, r.m) for r in found} == all_pairs(asked, known, measure)
            assert all(abs(r.sim - similarity(r.n, r.m, measure)) < 1e-12 for r in found)


def test_the_ratio_is_that_of_matching_blocks_on_ten_thousand_pairs(spark):
    names = drawn(7, 100, "abcdefgh", (1, 3), (2, 7))
    pairs = [(a, b) for a in names[:100] for b in names[:100]]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", resolution.ratio_similarity("a", "b").alias("s")).collect()
    assert len(got) == 10_000
    for r in got:
        want = similarity(r.a, r.b, "ratio")
        assert r.s == want if want >= 0.80 else r.s < 0.80


def test_bigrams_that_similar_names_share_at_least():
    names = drawn(4, 300, "abc", (1, 2), (2, 7))
    close = 0
    for a in names:
        for b in names:
            if a < b and SequenceMatcher(None, a, b).ratio() >= 0.80:
                ga, gb = (sorted(x[i : i + 2] for i in range(len(x) - 1)) for x in (a, b))
                shared = sum(min(ga.count(g), gb.count(g)) for g in set(ga))
                assert shared >= resolution.in_common(len(a) + len(b))
                close += 1
    assert close > 300


def best(record, known):
    out = (0.0, None)
    for slug, name, age, club, position in sorted(known):
        a, b = plain(record[1]), plain(name)
        if not a or not b or (s := similarity(a, b, "ratio")) < 0.80:
            continue
        group = lambda p: next((k for k, codes in resolution.BROAD.items() if p.lower().strip() in codes), None)
        ok = (
            record[2] is None or age is None or abs(record[2] - age) <= 1,
            not plain(record[3]) or not plain(club) or plain(record[3]) == plain(club),
            not record[4] or not position or group(record[4]) == group(position),
        )
        score = round(min(s * 0.60 + 0.20 * ok[0] + 0.12 * ok[1] + 0.08 * ok[2], 1.0), 4)
        if score > out[0]:
            out = (score, slug)
    return out if out[0] >= 0.80 else None


def test_best_entities_match_a_loop_over_all(spark):
    r = random.Random(5)
    names = drawn(6, 60, "aeimnorst", (1, 3), (2, 8)) + ["Kendry Páez", "kendry  paez", "O'Neil, J.", "oneil j", "Świątek", "swiatek", "", None, "   "]
    some = lambda values: r.choice([None, *values])
    rows = lambda n: [(i, r.choice(names), some([18, 19, 20, 21, 30]), some(["IDV", "idv ", "Ajax", ""]), some(["ST", "forward", "cm", "Keeper", "gk", "coach", "trainer", ""])) for i in range(n)]
    known, records = rows(150), rows(120)
    known += [known[0], known[1]]
    found = {x.record_id: (x.score, x.slug) for x in resolution.resolve(table(spark, "record_id", records), table(spark, "slug", known)).collect()}
    want = {rec[0]: b for rec in records if (b := best(rec, known))}
    assert found == want and len(want) > 60


def test_nothing_to_match(spark):
    some, none = [(1, "Ana", None, None, None)], []
    assert resolution.resolve(table(spark, "record_id", none), table(spark, "slug", some)).count() == 0
    assert resolution.resolve(table(spark, "record_id", some), table(spark, "slug", none)).count() == 0
    nameless = [(1, None, 20, "x", "gk"), (2, "", 20, "x", "gk"), (3, "!?", 20, "x", "gk")]
    assert resolution.resolve(table(spark, "record_id", nameless), table(spark, "slug", nameless)).count() == 0


def test_a_name_that_a_third_of_all_rows_have(spark):
    """Records of one name look their entities up by what must agree; no pair of them is made."""
    known = [(i, "John Smith" if i % 3 == 0 else f"name {i:05d} x", i % 40, f"club {i % 9}", "gk") for i in range(3000)]
    records = [(i, "Jon Smith" if i % 3 == 0 else f"nome {i:05d} y", i % 40, f"club {i % 9}", "st") for i in range(600)]
    found = {x.record_id: x.slug for x in resolution.resolve(table(spark, "record_id", records), table(spark, "slug", known)).collect() if x.record_id % 3 == 0}
    assert len(found) == 200
    for i, slug in found.items():
        assert abs(known[slug][2] - i % 40) <= 1 and known[slug][3] == f"club {i % 9}"
        assert slug == min(k for k in range(0, 3000, 3) if abs(k % 40 - i % 40) <= 1 and k % 9 == i % 9)


def test_accents_and_punctuation(spark):
    names = ["Żółć Łódź", "Ďáblice Řečice", "Őry Űllő", "Nguyễn Thị Ạnh", "José", "A.B. O'Neil-Ño"]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.plain_name("n").alias("p")).collect()]
    assert got == ["zolc lodz", "dablice recice", "ory ullo", "nguyen thi anh", "jose", "ab oneilno"]
    rows = spark.createDataFrame([("x=1|y=2", None), ("x=1", "y=2"), (None, "x"), ("\\N", "x"), ('"', "")], "a string, b string")
    hashes = [r.h for r in rows.select(X.content_hash(["b", "a"]).alias("h")).collect()]
    assert len(set(hashes)) == 5
    assert rows.select(F.length(X.content_hash(["a"], 12, md5=True)).alias("n")).first().n == 12
