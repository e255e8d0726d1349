"""SentencePiece spans, spelling variants and clusters on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from pitchlake.llm import centroids, kernel, queries, sentence_pieces, spelling

MODEL_FILE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids int, begins string, ends string, word string, n long, key long, more int, root string"


def table(spark, rows):
    """rows of (doc_id, text); every other column has a name that operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "b", "e", "w", 7, 8, 9, "r") for i, t in rows], SCHEMA)


# --- op 11 ------------------------------------------------------------------------------------

LETTERS = list("abcdeth  \n\t▁éÀ日本🙂ﬁｱ́<s>.,'")
MAPPED = LETTERS + list("¨ＡＢ　 ﷺ́̈eAÅ​①㌀ｶﾞ가가")


def drawn(seed, n, letters, most=50):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, most))) for _ in range(n)]


def test_ids_and_byte_spans_are_the_librarys():
    model, library = sentence_pieces.Model.read(MODEL_FILE), sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    texts = ["", None, " ", "  ", "▁", "a ", "\x00a\x00", "x" * 40_000, "Hello  world \n ﬁ é́", *drawn(3, 600, LETTERS), *(t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall())]
    data, offsets = kernel.text_bytes(pa.array(texts))
    for by_word in (True, False):
        use = sentence_pieces.Encoder(model)
        assert use.by_word
        use.by_word = by_word
        first, ids, low, high = use.encode(data, offsets, None, None)
        for i, t in enumerate(texts):
            want = library.encode(t or "", return_type="proto").pieces
            own = slice(first[i], first[i + 1])
            assert ids[own].tolist() == [p.id for p in want]
            assert list(zip(low[own].tolist(), high[own].tolist(), strict=True)) == [(p.begin, p.end) for p in want]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("escape", [True, False])
@pytest.mark.parametrize("extra", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_character_maps_normalise_and_align_as_the_library_does(rule, escape, extra, prefix):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=extra)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    rules = sentence_pieces.Rules(proto.normalizer_spec.precompiled_charsmap, prefix, extra, escape, False)
    texts = ["", " ", "   ", "▁ ", "¨", "​", "ﬁ ＡＢ  é", *drawn(5, 400, MAPPED, 30)]
    data, offsets = kernel.text_bytes(pa.array(texts))
    out, bounds, sources = sentence_pieces.normalized(data, offsets, rules)
    for i, t in enumerate(texts):
        want, places = library.normalize(t, with_offsets=True)
        got = out[bounds[i] : bounds[i + 1]].tobytes().decode()
        own = sources[bounds[i] + i : bounds[i + 1] + i + 1]
        assert got == want
        assert [len(t.encode()[: int(own[len(got[:k].encode())])].decode()) for k in range(len(got) + 1)] == places


def test_a_model_with_a_character_map_projects_spans_to_what_was_replaced():
    """The given model with a compiled map put in: ids of normalised text, spans of the original."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL_FILE, "rb") as f:
        proto.ParseFromString(f.read())
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    whole = proto.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=whole)
    plain = sentence_pieces.Model.read(MODEL_FILE).plain
    model = sentence_pieces.Model(whole, plain, sentence_pieces.Rules(proto.normalizer_spec.precompiled_charsmap, True, True, True, False), True)
    texts = drawn(7, 400, MAPPED)
    data, offsets = kernel.text_bytes(pa.array(texts))
    first, ids, low, high = sentence_pieces.Encoder(model).encode(data, offsets, None, None)
    for i, t in enumerate(texts):
        want = library.encode(t, return_type="proto").pieces
        own = slice(first[i], first[i + 1])
        assert ids[own].tolist() == [p.id for p in want]
        assert list(zip(low[own].tolist(), high[own].tolist(), strict=True)) == [(p.begin, p.end) for p in want]


def test_encoding_and_decoding_odd_rows(spark):
    rows = [(5, None), (1, ""), (2, " \t\n"), (3, "naïve café 日本語 🙂"), (3, "naïve café 日本語 🙂"), (None, "one two"), (None, None), (9, "long word " * 20_000)]
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE), sentence_pieces.Model.read(MODEL_FILE)
    encoded = sentence_pieces.encode(table(spark, rows), model)
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r)[:4] for r in sentence_pieces.digests(encoded, model).collect()) == want
    texts = sentence_pieces.decode(encoded, model).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, texts)) == collections.Counter((i, t or "") for i, t in rows)
    spans = encoded.filter("doc_id = 3").first()
    raw = rows[3][1].encode()
    assert b"".join(raw[a:b] for a, b in zip(spans.begins, spans.ends, strict=True)) == raw
    bare = sentence_pieces.encode(table(spark, [(1, "")]), model, False, False).first()
    assert (bare.ids, bare.begins) == ([], [])
    assert sentence_pieces.digests(sentence_pieces.encode(table(spark, []), model), model).count() == 0


def test_every_text_of_a_table_comes_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in queries.op11_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == docs.count()
    for r in docs.collect():
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# --- op 12 ------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_words(rows, least_n=5):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_n}


def plain_variants(counts, times=5):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    best = {w: min(others, key=lambda o: (-counts[o], o)) for w, others in near.items() if others}
    form = {w: o for w, o in best.items() if counts[o] >= times * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def test_checksums_of_joined_texts():
    heads, words = [b"", b"12:", b"-7:"], [b"", b"a", b"abcdef", b"x" * 64]
    head, word = (np.array([zlib.crc32(h) for h in heads for _ in words], np.uint32), np.array([zlib.crc32(w) for _ in heads for w in words], np.uint32))
    got = spelling.followed_crc(head, word, np.array([len(w) for _ in heads for w in words]))
    assert got.tolist() == [zlib.crc32(h + w) for h in heads for w in words]


def test_variants_of_a_table_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_spelling_variants(spark, sf)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == plain_variants(plain_words(rows))


def test_words_of_odd_rows(spark):
    odd = "Élanées ÀÉÎÕÜÿ×÷ naïvement Naïvement don't snake_case " * 3
    rows = [(1, odd), (2, odd), (2, odd), (None, odd), (None, None), (3, ""), (4, "z" * 5000 + " " + "z" * 5000), (5, "zebras " * 7000)] + [(i, "planted planted") for i in range(100, 900)]
    found = {(r.word, r.n) for r in spelling.vocabulary(table(spark, rows)).collect()}
    assert found == set(plain_words(rows).items())
    assert dict(found)["planted"] < 1600  # some lost a code point
    assert spelling.group(table(spark, [])).count() == 0
    assert spelling.group(table(spark, [(1, None), (2, "short one")])).count() == 0


@pytest.mark.parametrize("pairs", [1, 8, 4096])
def test_hot_chunks_are_cut_again_and_lose_no_pair(spark, pairs):
    """Words with one half in common, of equal and unequal length, in a key that all of them share."""
    r = random.Random(11)
    words = {f"common{''.join(r.choice('abcd') for _ in range(r.choice((5, 6))))}" for _ in range(250)} | {f"{''.join(r.choice('ab') for _ in range(r.choice((5, 6))))}common" for _ in range(60)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "é" * 7, "é" * 6}
    tables = spelling.Tables()
    got = spelling.near_pairs(spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long"), tables, pairs).collect()
    tables.remove()
    assert len(got) == len({(p.a, p.b) for p in got})
    assert {frozenset((p.a, p.b)) for p in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_forms_ties_and_chains(spark):
    counts = {"letters": 5, "lettersx": 25, "letterxx": 125, "lettexxx": 625, "aetters": 25, "zetters": 24, "unalike": 5}
    found = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {(w, f[0], f[1], counts[w], f[2], f[3]) for w, f in found.items()} == plain_variants(counts)
    assert found["letters"][:2] == ("aetters", "aetters")  # equal counts: the smaller word
    assert found["lettersx"][1] == "lettexxx"
    assert found["unalike"] == (None, "unalike", 0, None)


# --- op 13 ------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, v string, x int, cluster string, distance string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "v", 1, "c", "d") for i, e in rows], VECTORS)


def plain_clusters(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in kept[:k]]
    squared = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(cents)), key=lambda c: (squared(v, cents[c]), c))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        cents = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(cents)]
    out = [(i, c := nearest(v), squared(v, cents[c])) for i, v in kept]
    by = collections.Counter()
    for _, c, d in out:
        by[c] += d
    return collections.Counter((i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out)


def test_clusters_match_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = queries.op13_centroid_clusters(spark, sf)
    got = collections.Counter(map(tuple, found.collect()))
    assert got == plain_clusters(rows)
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    sql = duckdb.sql(centroids.CLUSTER_SQL)
    at = [sql.columns.index(c) for c in found.columns]
    assert collections.Counter(tuple(r[i] for i in at) for r in sql.fetchall()) == got


def test_odd_vectors(spark):
    r = random.Random(2)
    good = [(i, [r.uniform(-2, 2) for _ in range(64)]) for i in range(40)] + [(i, [float(i % 3)] * 64) for i in range(40, 90)]
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [float("nan")] * 64), (206, [float("inf")] + [0.0] * 63)]
    rows = good + odd + [(None, [0.5] * 64), good[0], good[0], (300, [-1e-9] * 64)]
    got = collections.Counter(map(tuple, centroids.with_inertia(*centroids.cluster(vectors(spark, rows))).collect()))
    assert got == plain_clusters(rows)
    beyond = centroids.with_inertia(*centroids.cluster(vectors(spark, [*good, (400, [1e30] * 64)]))).filter("vec_id = 400").collect()
    assert [tuple(x) for x in beyond] == [(400, None, None, None, None, None)]
    few = centroids.with_inertia(*centroids.cluster(vectors(spark, good[:3]))).collect()
    assert collections.Counter(map(tuple, few)) == plain_clusters(good[:3])
    assert centroids.with_inertia(*centroids.cluster(vectors(spark, odd))).count() == 0
    assert centroids.with_inertia(*centroids.cluster(vectors(spark, []))).count() == 0


def test_the_tournament_finds_the_nearest_and_the_smaller_of_ties():
    rng = np.random.default_rng(4)
    c = rng.integers(-2, 3, (9, 4))
    c[5] = c[1]
    v = rng.integers(-3, 4, (4000, 4))
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    assert centroids.tournament(v, *centroids.bisectors(c)).tolist() == d.argmin(1).tolist()
    far = centroids.largest(64) - 1
    ends = np.array([[far] * 64, [-far] * 64], np.int64)
    assert centroids.tournament(ends, *centroids.bisectors(ends)).tolist() == [0, 1]
    assert int(((ends[0] - ends[1]) ** 2).sum()) == 64 * (2 * far) ** 2 < 1 << 63
