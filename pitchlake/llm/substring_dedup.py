"""Exact substring dedup over a log-structured fingerprint index.

A window is WINDOW words in a row. Its fingerprint, or key, is the smallest hash among its runs of
KEY_WORDS words, so that equal windows have equal keys while a text has far fewer keys than
windows. The index is a folder: sorted runs of keys by hash bucket and shard of documents, which
are never changed; the texts of each batch, for later ones; a manifest. Each new batch's keys are merged with the
runs' keys to find those that two documents share, then kept as a run of their own, and runs are
compacted when there are FAN of them and another one comes. What shares a key is verified window by window, by 128-bit
hashes of all WINDOW words that are made from the texts anew. An index can be opened again later
and given the next batch; only texts of shards that share keys with it are then read again.

A shard is a range of document ids of about SHARD_BYTES, and shards are numbered by id: of the
shards that have a window, the first has its smallest document. Between tasks go keys and window
hashes, at most one of each for a shard, and shards meet in a tree of at most NODE at a time, so
that a passage in a third of all documents is not a large group anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel
from pitchlake.llm.ranges import ranged
from pitchlake.llm.shared import exists, remove, shared_dir

WINDOW, KEY_WORDS = 13, 4
#: Text of a shard, about; shards, or nodes of shards, that meet at once; runs before they are compacted; batches.
SHARD_BYTES, NODE, FAN, BATCHES = 4 << 20, 1024, 2, 3
#: Bits of a hash that make the bucket of a shard's keys and of its verified windows.
KEY_BITS, FULL_BITS = 6, 8

_ROW = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("hashes", T.BinaryType())])
_MANIFEST = "version long, bits int, shards long, runs array<string>, texts array<string>"
_TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.LongType())])
_RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])
#: kind of rows: keys of batches before, keys of the batch, shared keys, verified windows, windows that an earlier shard has.
OLD, NEW, SHARED, FULL, EARLIER = range(5)
_MANY = np.uint64(1)


def window_keys(h: np.ndarray) -> np.ndarray:
    """For each window over the word hashes h: the smallest hash of its runs of KEY_WORDS words, mixed again; the lowest bit is free."""
    g = kernel.run_hashes(h, KEY_WORDS)
    need, have = WINDOW - KEY_WORDS + 1, 1
    if len(g) < need:
        return np.zeros(0, np.uint64)
    while 2 * have <= need:
        g, have = np.minimum(g[:-have], g[have:]), 2 * have
    g = np.minimum(g[: len(g) - (need - have)], g[need - have :]) if need > have else g
    # The smallest of ten has small leading bits, which the bucket is made of.
    with np.errstate(over="ignore"):
        return kernel.mix(g) & ~_MANY


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the columns differs from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _known(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted `among`; equal neighbours are looked up once."""
    if not len(among) or not len(x):
        return np.zeros(len(x), bool)
    new = _changes(x)
    some = x[new]
    hit = among[np.minimum(np.searchsorted(among, some), len(among) - 1)] == some
    return hit[np.cumsum(new) - 1]


def _cuts(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    edges = np.append(np.flatnonzero(_changes(x)), len(x))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _dealt(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Ascending hashes (64 bits, or rows of two) by the top bits of their first value."""
    first = hashes if hashes.ndim == 1 else hashes[:, 0]
    top = (first >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
    for a, b in _cuts(top):
        yield int(top[a]), hashes[a:b].tobytes()


def _wide(blobs: list[np.ndarray]) -> np.ndarray:
    """Rows of two 64-bit values from blobs of them."""
    return np.concatenate(blobs).reshape(-1, 2) if blobs else np.zeros((0, 2), np.uint64)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def _table(rows: list[tuple], schema: T.StructType = _ROW) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)])


def _parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(shard, kind, hashes) of the rows of a table of _ROW."""
    return table.column("shard").to_numpy(), table.column("kind").to_numpy(), [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("hashes")]


def _of_kind(table: pa.Table, kind: int) -> list[np.ndarray]:
    return _parts(table.filter(pc.equal(table.column("kind"), kind)))[2]


def tree(rows: DataFrame, shards: int, bits: int, up: Callable, top: Callable, down: Callable, node: int | None = None) -> DataFrame:
    """Brings together what shards say about a hash and gives each shard an answer, NODE shards at a time.

    up(bits) merges a table of rows of one bucket and of up to NODE shards into rows of one node, in
    buckets of `bits` bits; top answers to all shards of a bucket; down answers to the shards of a node,
    given the answer to the node, by buckets of `bits` bits. No group has more than NODE rows of a hash.
    """
    node = node or NODE
    if shards <= node:
        return rows.groupBy("bucket").applyInArrow(top, _ROW)
    rows = rows.withColumn("node", F.floor(F.col("shard") / node))
    nodes = -(-shards // node)
    finer = min(node, nodes).bit_length()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return _table([(bucket, key[1].as_py(), kind, blob) for kind, hashes in up(table) for bucket, blob in _dealt(hashes, bits + finer)])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return down(left.drop_columns(["node"]), right.drop_columns(["own"]), bits + finer) if left.num_rows else _table([])

    # Both uses of rows are dealt alike, so Spark shuffles them once.
    upper = rows.groupBy("bucket", "node").applyInArrow(merge, _ROW)
    answers = tree(upper, nodes, bits + finer, up, top, down, node).withColumn("own", F.shiftright("bucket", finer))
    return rows.groupBy("bucket", "node").cogroup(answers.groupBy("own", "shard")).applyInArrow(answer, _ROW)


# --- keys that two documents share ------------------------------------------------------------


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, shard, whether two rows of the shard have it, whether the shard is new), by key."""
    shard, kind, blobs = _parts(table)
    keys = np.concatenate(blobs)
    of = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
    order = np.argsort(keys & ~_MANY, kind="stable")
    keys, of = keys[order], of[order]
    return keys & ~_MANY, shard[of], (keys & _MANY).astype(bool), (kind == NEW)[of]


def _to_shards(keys: np.ndarray, of: np.ndarray, bucket: int, kind: int) -> pa.Table:
    order = np.argsort(of, kind="stable")
    keys, of = keys[order], of[order]
    return _table([(bucket, int(of[a]), kind, keys[a:b].tobytes()) for a, b in _cuts(of)])


def _shared_up(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    keys, _, many, new = _keys(table)
    first = np.flatnonzero(_changes(keys))
    if len(first):
        many = np.logical_or.reduceat(many, first) | (np.diff(np.append(first, len(keys))) > 1)
        new = np.logical_or.reduceat(new, first)
        keys = keys[first] | many.astype(np.uint64)
        yield from ((NEW, keys[new]), (OLD, keys[~new]))


def _shared_top(table: pa.Table) -> pa.Table:
    keys, of, many, new = _keys(table)
    first = np.flatnonzero(_changes(keys))
    if not len(first):
        return _table([])
    size = np.diff(np.append(first, len(keys)))
    hit = np.repeat(((size > 1) | np.logical_or.reduceat(many, first)) & np.logical_or.reduceat(new, first), size)
    return _to_shards(keys[hit], of[hit], table.column("bucket")[0].as_py(), SHARED)


def _shared_down(table: pa.Table, answer: pa.Table, bits: int) -> pa.Table:
    keys, of, _, _ = _keys(table)
    shared = _of_kind(answer, SHARED) if answer.num_rows else []
    hit = _known(keys, np.unique(np.concatenate(shared))) if shared else np.zeros(len(keys), bool)
    return _to_shards(keys[hit], of[hit], table.column("bucket")[0].as_py(), SHARED)


def keys_of(docs: DataFrame, bits: int) -> DataFrame:
    """(shard, text) -> rows of kind NEW: for each shard, the keys of its windows, ascending and by bucket.

    A key's lowest bit says that two rows of the shard have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column(0).to_numpy()
            found: dict[int, list[np.ndarray]] = {}
            order = np.argsort(shard, kind="stable")
            own = shard[order]
            text = batch.column(1).take(pa.array(order))
            for a, data, offsets in kernel.chunks(text):
                starts, ends, first = kernel.word_bounds(data, offsets)
                keys = window_keys(kernel.word_hashes(data, starts, ends))
                at = np.flatnonzero(kernel.in_texts(first, WINDOW))
                doc = np.searchsorted(first, at, "right") - 1
                keys = keys[at]
                pick = _changes(keys, doc)
                keys, doc = keys[pick], doc[pick]
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                one = _changes(keys, doc)
                keys, of = keys[one], own[a + doc[one]]
                for s in np.unique(of):
                    found.setdefault(int(s), []).append(keys[of == s])
            rows = []
            for s, lists in found.items():
                keys = np.sort(np.concatenate(lists))
                new = _changes(keys)
                keys = keys[new] | (np.diff(np.append(np.flatnonzero(new), len(new))) > 1).astype(np.uint64)
                rows += [(bucket, s, NEW, part) for bucket, part in _dealt(keys, bits)]
            yield _batch(rows, _ROW)

    return docs.filter("shard >= 0").select("shard", "text").mapInArrow(run, _ROW)


def write_run(keys: DataFrame, path: str, *by: str) -> None:
    """Writes rows of keys in order of bucket and shard, in a folder for each value of `by`."""
    keys.sortWithinPartitions(*by, "bucket", "shard").write.option("compression", "uncompressed").partitionBy(*by).parquet(path)


class Index:
    """Sorted runs of window keys, the texts they come from (if kept) and a manifest, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, bits: int = KEY_BITS, fan: int = FAN):
        """Opens the index at path, or begins one there (in a new folder, if none is given)."""
        self.spark, self.fan = spark, fan
        self.path = path or shared_dir(spark)
        self.version, self.bits, self.shards, self.runs, self.texts = 0, bits, 0, [], []
        if exists(spark, f"{self.path}/manifest"):
            last = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.col("version").desc()).head()
            self.version, self.bits, self.shards, self.runs, self.texts = last["version"], last["bits"], last["shards"], list(last["runs"]), list(last["texts"])

    def _commit(self) -> None:
        """A new line of the manifest; what it does not name is no part of the index."""
        self.version += 1
        row = [(self.version, self.bits, self.shards, self.runs, self.texts)]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(*runs)

    def read_texts(self) -> DataFrame:
        """(doc_id, text, shard) of all that was added."""
        return self.spark.read.schema(_TEXTS).parquet(*self.texts) if self.texts else self.spark.createDataFrame([], _TEXTS)

    def _free(self, name: str) -> str:
        path = f"{self.path}/{name}-{self.version}"
        if exists(self.spark, path):  # left behind by a writer that did not reach its commit
            remove(self.spark, path)
        return path

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds docs (doc_id, text, shard; shards from self.shards on, below 0: not compared) and their texts; see add_run()."""
        texts, run = self._free("texts"), self._free("run")
        docs.select("doc_id", "text", "shard").write.option("compression", "zstd").parquet(texts)
        batch = self.spark.read.schema(_TEXTS).parquet(texts)
        write_run(keys_of(batch, self.bits), run)
        return self.add_run(run, batch.agg(F.coalesce(F.max("shard"), F.lit(-1))).head()[0] + 1, texts)

    def add_run(self, run: str, shards: int, texts: str | None = None) -> DataFrame:
        """Adds a run that write_run() wrote; `shards` is one more than its last shard.

        Returns rows of kind SHARED: by shard, the keys that a document of the batch shares with
        another document. All shards that share them are named, those of former batches too.
        """
        if len(self.runs) >= self.fan:
            self.compact()
        met = self.read([run])
        if self.runs:
            met = met.unionByName(self.read(self.runs).withColumn("kind", F.lit(OLD)))
        self.shards = max(self.shards, shards)
        path = self._free("shared")
        tree(met, self.shards, self.bits, _shared_up, _shared_top, _shared_down).write.option("compression", "uncompressed").parquet(path)
        self.runs, self.texts = [*self.runs, run], [*self.texts, *([texts] if texts else [])]
        self._commit()
        return self.read([path])

    def compact(self) -> None:
        """Merges all runs into one, a row for each bucket and shard; the old ones go when it is in the manifest."""

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            rows, shard = [], table.column("shard").to_numpy()
            for s in np.unique(shard):
                keys, _, many, _ = _keys(table.filter(pa.array(shard == s)))
                # The lowest bit is set where it was, or where rows of a shard met in one key.
                at = np.flatnonzero(_changes(keys))
                if len(at):
                    many = (np.diff(np.append(at, len(keys))) > 1) | np.logical_or.reduceat(many, at)
                    rows.append((key[0].as_py(), int(s), NEW, (keys[at] | many.astype(np.uint64)).tobytes()))
            return _table(rows)

        old, path = self.runs, self._free("compact")
        by_node = self.read(old).groupBy("bucket", F.floor(F.col("shard") / NODE).alias("node"))
        write_run(by_node.applyInArrow(merge, _ROW), path)
        self.runs = [path]
        self._commit()
        for run in old:
            remove(self.spark, run)

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
        """The rows of deduplicate() for one more batch: what was added before counts as having smaller ids."""
        if self.runs and not self.texts:
            raise ValueError("the index was made without texts, so that later batches cannot be verified")
        low = self.shards
        shared = self.add(sharded(docs, id_col, text_col, low))
        own = (F.col("shard") >= low) | (F.col("shard") < 0)
        sharing = shared.select(F.col("shard").alias("s")).distinct()
        texts = self.spark.read.schema(_TEXTS).parquet(self.texts[-1])
        if len(self.texts) > 1:
            old = self.spark.read.schema(_TEXTS).parquet(*self.texts[:-1])
            texts = texts.unionByName(old.join(sharing, F.col("shard") == F.col("s"), "left_semi").filter("shard >= 0"))
        done = verify(texts, shared, self.shards, with_text, own)
        return done if with_text else done.drop("kept")


# --- windows, verified ------------------------------------------------------------------------


def _windows(data: np.ndarray, offsets: np.ndarray, shared: np.ndarray) -> tuple:
    """Words of a chunk, and of its windows with a shared key: first word, text, two hashes of all words."""
    starts, ends, first = kernel.word_bounds(data, offsets)
    low, high = kernel.word_digests(data, starts, ends)
    hit = _known(window_keys(low), shared) & kernel.in_texts(first, WINDOW)
    at = np.flatnonzero(hit)
    full = np.stack([kernel.exact_runs(h, at, WINDOW) for h in (low, high)], 1)
    return starts, ends, first, at, np.searchsorted(first, at, "right") - 1, full


def _ascending(full: np.ndarray) -> np.ndarray:
    """The different rows, ascending."""
    full = full[np.lexsort((full[:, 1], full[:, 0]))]
    return full[_changes(full[:, 0], full[:, 1])]


def _earlier_up(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    yield FULL, _ascending(_wide(_of_kind(table, FULL)))


def _earlier_top(table: pa.Table) -> pa.Table:
    return _earlier(table, np.zeros((0, 2), np.uint64))


def _earlier_down(table: pa.Table, answer: pa.Table, bits: int) -> pa.Table:
    full = _ascending(_wide(_of_kind(table, FULL)))
    return _earlier(table, full[answered(full, answer, bits)])


def _earlier(table: pa.Table, before: np.ndarray) -> pa.Table:
    """To each shard, which of its windows an earlier shard has or are in `before`: a bit for each, in their order."""
    shard, _, blobs = _parts(table)
    size = [len(b) // 2 for b in blobs]
    full = _wide([before.ravel(), *blobs])
    of = np.repeat(np.append(-1, shard), [len(before), *size])
    order = np.lexsort((of, full[:, 1], full[:, 0]))
    again = np.empty(len(full), bool)
    again[order] = ~_changes(full[order, 0], full[order, 1])
    bits = np.split(again[len(before) :], np.cumsum(size)[:-1])
    return _table([(b.as_py(), int(s), EARLIER, np.packbits(x).tobytes()) for b, s, x in zip(table.column("bucket"), shard, bits, strict=True)])


def answered(full: np.ndarray, answer: pa.Table, bits: int) -> np.ndarray:
    """For ascending windows that were sent in buckets of `bits` bits, the bits that came back."""
    out = np.zeros(len(full), bool)
    mine = answer.filter(pc.equal(answer.column("kind"), EARLIER))
    back = dict(zip(mine.column("bucket").to_pylist(), mine.column("hashes").to_pylist(), strict=True))
    top = (full[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
    for a, b in _cuts(top):
        out[a:b] = np.unpackbits(np.frombuffer(back[int(top[a])], np.uint8), count=b - a).astype(bool)
    return out


def verify(docs: DataFrame, shared: DataFrame, shards: int, with_text: bool = False, own: F.Column | None = None) -> DataFrame:
    """(doc_id, text, shard) with shared keys by shard -> doc_id, n_words, n_removed, kept_sha256, kept.

    A word goes if a window covers it whose words also start in a document with a smaller id. own:
    which rows are wanted; the others only tell what they have.
    """

    def hashes(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = _of_kind(right, SHARED)
        if not keys or not left.num_rows:
            return _table([])
        keys = np.unique(np.concatenate(keys))
        full = [_ascending(_windows(data, offsets, keys)[-1]) for _, data, offsets in kernel.chunks(left.column("text"))]
        shard = left.column("shard")[0].as_py()
        return _table([(b, shard, FULL, part) for b, part in _dealt(_ascending(np.concatenate(full)), FULL_BITS)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _RESULT)
        keys = _of_kind(right, SHARED)
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        # Rows by id, so that of rows with a window the first has its smallest id.
        left = left.sort_by([("doc_id", "ascending")])
        ids = left.column("doc_id").combine_chunks()
        number = ids.fill_null(0).to_numpy()
        parts = [(a, *_windows(data, offsets, keys), data) for a, data, offsets in kernel.chunks(left.column("text"))]
        full = np.concatenate([p[6] for p in parts])
        row = np.concatenate([p[0] + p[5] for p in parts]).astype(np.int64)
        order = np.lexsort((row, full[:, 1], full[:, 0]))
        lead = np.flatnonzero(_changes(full[order, 0], full[order, 1]))
        size = np.diff(np.append(lead, len(order)))
        earlier = answered(full[order[lead]], right, FULL_BITS)
        # A window goes if another shard has it before or its first row has a smaller id.
        gone = np.empty(len(order), bool)
        gone[order] = np.repeat(earlier, size) | (number[np.repeat(row[order[lead]], size)] < number[row[order]])
        rows, done = [], 0
        for a, starts, ends, first, at, _, _, data in parts:
            covered = np.zeros(len(starts) + 1, np.int64)
            hit = at[gone[done : done + len(at)]]
            done += len(at)
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + WINDOW, -1)
            kept = np.cumsum(covered)[:-1] == 0
            text, put, _ = kernel.joined(data, starts[kept], ends[kept])
            upto = np.concatenate([[0], np.cumsum(kept)])
            for k in range(len(first) - 1):
                low, high = upto[first[k]], upto[first[k + 1]]
                words = text[put[low] : put[high] - 1] if high > low else b""
                n = int(first[k + 1] - first[k])
                rows.append((ids[a + k].as_py(), n, n - int(high - low), hashlib.sha256(words).hexdigest(), words.decode() if with_text else None))
        return _table(rows, _RESULT)

    # Ids that are null have a shard of their own for each row's hash; no keys are kept for them.
    docs = docs.withColumn("shard", F.when(F.col("shard") < 0, -1 - F.pmod(F.xxhash64("text"), F.lit(1024))).otherwise(F.col("shard")))
    found = docs.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(hashes, _ROW)
    earlier = tree(found, shards, FULL_BITS, _earlier_up, _earlier_top, _earlier_down)
    wanted = docs if own is None else docs.filter(own)
    return wanted.groupBy("shard").cogroup(shared.unionByName(earlier).groupBy("shard")).applyInArrow(finish, _RESULT)


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 0) -> DataFrame:
    """(doc_id, text, shard): ranges of ids of about SHARD_BYTES, numbered from `first` on; -1 for null ids.

    The ranges are cut where the ids' percentiles by bytes are, and evenly by id between these.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).head()
    mean = max(1, int(size) // max(1, n))
    weighed = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / mean))).alias("i"))
    (rows,) = ranged(weighed.select("doc_id"), rows, rows=max(1, SHARD_BYTES // mean), out="shard")
    return rows.withColumn("shard", F.when(F.col("shard") >= 0, F.col("shard") + first).otherwise(F.col("shard")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept: the remaining words, joined by spaces) for every row.

    Documents go into an index in `batches` ranges of ascending id; windows are judged on the
    input, not on what is left. Null text has no words. Rows with a null id neither lose words nor
    take any from others; rows that share an id do not take words from each other. Ids must be
    whole numbers: others are cast, and what cannot be cast is null. An empty table gives no
    rows. Other columns are not read. Verification runs once, behind the last batch.
    """
    spark = docs.sparkSession
    index, rows = Index(spark), sharded(docs, id_col, text_col)
    shards = rows.agg(F.coalesce(F.max("shard"), F.lit(-1))).head()[0] + 1
    # All batches' keys are made in one pass over the texts; each batch's are a run of their own.
    keys = keys_of(rows, index.bits).withColumn("batch", F.floor(F.col("shard") * batches / max(1, shards)))
    write_run(keys, f"{index.path}/runs", "batch")
    shared = spark.createDataFrame([], _ROW)
    for k in range(batches):
        run = f"{index.path}/runs/batch={k}"
        if exists(spark, run):
            shared = shared.unionByName(index.add_run(run, -(-(k + 1) * shards // batches)))
    done = verify(rows, shared, shards, with_text)
    return done if with_text else done.drop("kept")


DEDUP_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), x AS (
  SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL
), v AS (
  SELECT r, doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s FROM x
), m AS (
  SELECT s, min(doc_id) AS least FROM v GROUP BY s HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM v JOIN m USING (s) WHERE doc_id > least
), p AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d
), k AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM p ANTI JOIN gone USING (r, j) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
