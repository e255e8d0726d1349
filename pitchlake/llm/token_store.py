"""Token ids as binary files: one zstandard frame per document, one shared dictionary.

A store is a folder with three Parquet tables. `dictionary` has the dictionary, its SHA-256 and
the tokenizer file's SHA-256. `segments` has, in order of document id, runs of frames: the bytes
of the frames one behind the other, and an index with each document's id, the end of its frame,
its number of ids, the run's first token within its partition and its smallest and largest id, by
which a reader of one document skips files and row groups. `parts` has the tokens of each
partition. Spark's writers commit the files, so a lost executor's tasks simply run again; a
short document is read from its segment's slice alone.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel
from pitchlake.llm.shared import shared_dir

END_ID = 0
LEVEL = 1
#: Compressed bytes after which a segment ends.
SEGMENT_BYTES = 256 << 10
#: The dictionary is trained on so many texts, of each so many code points in a row, and has at most so many bytes.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 16 << 10, 64 << 10
#: Pieces of text whose ids a worker remembers, at most, and the bytes of such a piece; beyond, the newer half of that number stays.
MEMO, MEMO_BYTES = 200_000, 64
#: Bytes of text that are encoded at once, or one text.
CHUNK_BYTES = 2 << 20

_SEGMENT = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("first_token", T.LongType()),
        T.StructField("least_id", T.LongType()),
        T.StructField("most_id", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.ArrayType(T.LongType())),
        T.StructField("dict_sha256", T.StringType()),
        T.StructField("frames", T.BinaryType()),
    ]
)

#: Bytes that are whole visible characters, and lead bytes of 2, 3 and 4 byte characters that surely are no white space.
_VISIBLE, _TWO, _THREE, _FOUR = (np.isin(np.arange(256), list(r)) for r in (range(33, 127), range(0xC3, 0xE0), range(0xE4, 0xF0), range(0xF0, 0xF5)))
_MARK = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: One token of the pattern: Latin letters (but for the two signs among them), a space before them or not; or ASCII punctuation.
_ONE = re.compile(rb"(?: ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+|[!-/:-@\[-`{-~]+)")
_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]


def piece_starts(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where texts may be cut so that their pieces' ids in a row are the texts' ids.

    A byte-level BPE tokenizer's pattern ends a token before a single space that stands between two
    characters other than white space, around such a line feed, and between a letter and ASCII
    punctuation. Texts with a special token's string are not cut.
    """
    n = len(data)
    tail = (data & 0xC0) == 0x80
    begins = _VISIBLE[data] | _TWO[data] | _THREE[data] | _FOUR[data]
    ends = _VISIBLE[data]
    ends[1:] |= tail[1:] & _TWO[data[:-1]]
    ends[2:] |= tail[2:] & _THREE[data[:-2]]
    ends[3:] |= tail[3:] & _FOUR[data[:-3]]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    at = np.flatnonzero(((data[1:-1] == 32) | (data[1:-1] == 10)) & ends[:-2] & begins[2:]) + 1 if n > 2 else np.zeros(0, np.int64)
    at = at[~head[at] & ~head[at + 1]]
    # A letter: an ASCII one, or two bytes from U+00C0 to U+024F but for the signs of times and division.
    letter = _LETTER[data]
    letter[1:] |= tail[1:] & ((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))))
    behind = np.flatnonzero(_MARK[data[1:]] & letter[:-1]) + 1
    at = np.concatenate([at, behind[~head[behind]]])
    if special:
        plain, whole = data.tobytes(), set()
        for s in special:
            k = plain.find(s)
            while k >= 0:
                whole.add(int(np.searchsorted(offsets, k, "right")) - 1)
                k = plain.find(s, k + 1)
        for text in whole:
            at = at[(at < offsets[text]) | (at >= offsets[text + 1])]
    head[at] = True
    head[at[data[at] == 10] + 1] = True
    head[n] = False
    return np.flatnonzero(head)


class Encoder:
    """Encodes texts as the tokenizers library does, remembering the ids of pieces.

    Texts are cut by piece_starts(), each distinct piece of a chunk of texts is looked up once and,
    if it is new, goes through the library. Tokenizers of other kinds take texts whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ask = self.library.model.tokenize
        self.end = np.array([end_id], "<u4").tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        )
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        # Byte-level models write each byte as a character: printable ones as they are, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.shown = "".join(other.get(b, chr(b)) for b in range(256))
        self.memo: dict[bytes, bytes] = {}

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; those of short ones are remembered."""
        ask, shown, memo, out = self.ask, self.shown, self.memo, []
        for piece, ids in zip(pieces, map(memo.get, pieces), strict=True):
            if ids is None:
                if _ONE.fullmatch(piece):  # the library's model alone is asked
                    found = [t.id for t in ask(codecs.charmap_decode(piece, "strict", shown)[0])]
                else:
                    found = self.library.encode(piece.decode(), add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
                if len(piece) <= MEMO_BYTES:
                    memo[piece] = ids
            out.append(ids)
        return out

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        for _, data, offsets in kernel.chunks(texts, CHUNK_BYTES):
            starts = piece_starts(data, offsets, self.special) if self.by_piece else np.unique(offsets[:-1][np.diff(offsets) > 0])
            bounds = np.append(starts, len(data)).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            found = self.learn(cut.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat, low = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
            own = cut.indices.to_numpy()
            n = size[own]
            upto = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(low[own] - upto[:-1], n) + np.arange(upto[-1])] if len(own) else flat
            edges = upto[np.searchsorted(starts, offsets)].tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield ids[a:b].tobytes() + self.end
            if len(self.memo) > MEMO:
                self.memo = dict(islice(self.memo.items(), len(self.memo) - MEMO // 2, None))

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.column(pa.array(texts, pa.string())))


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int = END_ID) -> Encoder:
    return Encoder(path, end_id)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A dictionary from the id arrays of SAMPLE_DOCS different texts, those with the smallest hashes.

    Of a longer text a slice of SAMPLE_CHARS code points counts, at a place that its hash decides, so
    that what the driver gets is bounded. Where zstandard cannot train on so few samples, the
    arrays themselves, one behind the other, are the dictionary's content.
    """
    hashed = docs.filter(F.octet_length("text") > 0).select("text", F.xxhash64("text").alias("h"))
    # First the hashes alone, so that no task sends texts that are not chosen.
    last = [r[0] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).collect()]
    place = F.pmod("h", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    chosen = hashed.filter(F.col("h") <= last[-1]).select("h", F.col("text").substr(place, F.lit(SAMPLE_CHARS)).alias("slice")).groupBy("h").agg(F.min("slice").alias("slice")).orderBy("h").collect() if last else []
    samples = encoder(tokenizer, end_id).encode([r["slice"] for r in chosen])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        content = b"".join(samples) or np.array([end_id] * 4, "<u4").tobytes()
        return content[-DICTIONARY_BYTES:]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of docs to path, by ascending id (null ids first, rows of one id by text).

    Null and empty texts are stored as the end id alone; equal rows are stored as often as they
    come; an empty table gives a store without segments. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(rows, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    with open(tokenizer, "rb") as f:
        spark.createDataFrame([(1, digest, bytearray(dictionary), hashlib.sha256(f.read()).hexdigest(), end_id)], "version int, dict_sha256 string, dictionary binary, tokenizer_sha256 string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = encoder(tokenizer, end_id).column
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(sent.value)).compress
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        frames: list[bytes] = []
        counts: list[int] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal seq, first, size
            named = [i for i in ids if i is not None]
            columns = [part, seq, first, min(named, default=None), max(named, default=None), ids[:], np.cumsum([len(f) for f in frames]).tolist(), counts[:], digest, b"".join(frames)]
            out = pa.record_batch([pa.array([c], t) for c, t in zip(columns, _ARROW, strict=True)], names=_SEGMENT.names)
            seq, first, size = seq + 1, first + sum(counts), 0
            ids.clear(), frames.clear(), counts.clear()
            return out

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), column(batch.column(1)), strict=True):
                frames.append(press(blob))
                counts.append(len(blob) // 4)
                ids.append(doc_id)
                size += len(frames[-1])
                if size >= SEGMENT_BYTES:
                    yield segment()
        if ids:
            yield segment()

    packed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(pack, _SEGMENT)
    packed.write.option("compression", "uncompressed").parquet(f"{path}/segments")
    tokens = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    index = spark.read.schema(_SEGMENT).parquet(f"{path}/segments").groupBy("part").agg(F.sum(tokens).alias("tokens"))
    index.coalesce(1).write.parquet(f"{path}/parts")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").head()
    if hashlib.sha256(bytes(row["dictionary"])).hexdigest() != row["dict_sha256"]:
        raise ValueError(f"the dictionary in {path} is damaged")
    return row["dict_sha256"], bytes(row["dictionary"])


def _frames(digest: str, dictionary: bytes, batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int], memoryview, list[int]]]:
    names = batch.schema.names
    column = {n: batch.column(names.index(n)) for n in ("first_token", "doc_ids", "ends", "n_tokens", "dict_sha256", "frames")}
    for k in range(batch.num_rows):
        if column["dict_sha256"][k].as_py() != digest:
            raise ValueError("a segment was written with another dictionary")
        yield (*[column[n][k].as_py() for n in ("first_token", "doc_ids", "ends")], memoryview(column["frames"][k].as_buffer()), column["n_tokens"][k].as_py())


_DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


def read(spark: SparkSession, path: str, only: int | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the store.

    start counts the ids of all documents before it. only: one document's id; segments that
    cannot have it are not decompressed.
    """
    digest, dictionary = _dictionary(spark, path)
    sent = spark.sparkContext.broadcast(dictionary)
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    if only is not None:
        segments = segments.filter((F.col("least_id") <= only) & (F.col("most_id") >= only) & F.array_contains("doc_ids", F.lit(only)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(sent.value)).decompress
        for batch in batches:
            parts = batch.column(batch.schema.names.index("part"))
            for k, (start, ids, ends, frames, counts) in enumerate(_frames(digest, sent.value, batch)):
                out, at = [], 0
                for doc_id, end, n in zip(ids, ends, counts, strict=True):
                    if only is None or doc_id == only:
                        blob = open_frame(frames[at:end])
                        if len(blob) != 4 * n:
                            raise ValueError(f"document {doc_id}: {len(blob)} bytes, {n} ids")
                        out.append((doc_id, parts[k].as_py(), start, n, zlib.crc32(blob), blob if with_ids else None))
                    at, start = end, start + n
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_DOCUMENT.names)

    # One row for each partition of the writing job: their number, not the corpus, bounds what is sent.
    tokens = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = spark.read.parquet(f"{path}/parts").select(F.col("part").alias("of"), F.coalesce(tokens, F.lit(0)).alias("before"))
    found = segments.mapInArrow(unpack, _DOCUMENT).join(F.broadcast(before), F.col("part") == F.col("of"))
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to a store in the shared folder and reads every document back."""
    path = shared_dir(docs.sparkSession)
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
