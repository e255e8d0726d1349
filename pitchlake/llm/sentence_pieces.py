"""SentencePiece encoding that keeps every piece's place in the original text, and decoding.

A text is normalised here: from each place on, the longest prefix that the model's compiled character
map knows is replaced, anything else is kept code point by code point, white space is treated as the
model says, and each byte that comes out records where its source begins. The library, with its own
normalisation switched off, then only splits normalised text into pieces, and each piece's bytes are
projected to the span of original bytes that they come from.

The compiled map is a double-array trie of the prefixes' bytes, whose leaves hold where, in the
strings behind it, the replacement begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm import kernel

#: The character that stands for a space in pieces, and its bytes.
SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)
#: Bytes of text that are encoded at once, or one text; each distinct word among them goes through the library once.
CHUNK_BYTES = 4 << 20
#: Kinds of pieces in a model file.
_UNKNOWN, _CONTROL, _USER_DEFINED, _BYTE = 2, 3, 4, 6


@dataclass(frozen=True)
class CharMap:
    """A compiled character map: units of the trie, the replacements' bytes and where each string in them ends."""

    units: np.ndarray
    strings: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(compiled: bytes) -> CharMap | None:
        if not compiled:
            return None
        size = int.from_bytes(compiled[:4], "little")
        strings = np.frombuffer(compiled, np.uint8, offset=4 + size)
        return CharMap(np.frombuffer(compiled, "<u4", size // 4, 4), strings, np.flatnonzero(strings == 0))

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, place of the replacement) of the longest known prefix from each place `at` on that ends by `stop`; 0 bytes: none.

        All places take their steps through the trie together; few are left after the first.
        """
        size, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        jump = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        rows, here = np.arange(len(at)), np.full(len(at), int(jump(self.units[:1].astype(np.int64))[0]), np.int64)
        step = 0
        while len(rows):
            rows, here = (x[at[rows] + step < stop[rows]] for x in (rows, here))
            byte = data[at[rows] + step].astype(np.int64)
            here = here ^ byte
            ok = here < len(self.units)
            unit = self.units[np.where(ok, here, 0)].astype(np.int64)
            ok &= (unit & 0x800000FF) == byte
            rows, here, unit = rows[ok], here[ok] ^ jump(unit[ok]), unit[ok]
            step += 1
            leaf = (unit >> 8) & 1 == 1
            size[rows[leaf]], place[rows[leaf]] = step, self.units[here[leaf]].astype(np.int64) & 0x7FFFFFFF
        return size, place


@dataclass(frozen=True)
class Rules:
    """How a model normalises."""

    compiled: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool
    as_suffix: bool


@lru_cache(maxsize=8)
def _char_map(compiled: bytes) -> CharMap | None:
    return CharMap.of(compiled)


def _units(data: np.ndarray, offsets: np.ndarray, chars: CharMap | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes that come out, the unit of each, each unit's first source byte, each unit's text); a unit is what is replaced or kept at once."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    if chars is None:
        return data, np.cumsum((data & 0xC0) != 0x80) - 1, starts, text
    size, place = chars.longest(data, starts, offsets[text + 1])
    own = np.diff(np.append(starts, len(data)))
    inside, until = np.zeros(len(starts), bool), 0
    for i in np.flatnonzero(size > own).tolist():  # prefixes of several code points hide those that begin in them
        if starts[i] >= until:
            until = int(starts[i] + size[i])
            inside[i + 1 : np.searchsorted(starts, until)] = True
    starts, text, size, place, own = (x[~inside] for x in (starts, text, size, place, own))
    known = size > 0
    length = np.where(known, chars.ends[np.minimum(np.searchsorted(chars.ends, place), len(chars.ends) - 1)] - place, own)
    base = np.where(known, place + len(data), starts)
    unit = np.repeat(np.arange(len(starts)), length)
    first = np.cumsum(length) - length
    return np.concatenate([data, chars.strings])[np.arange(len(unit)) + (base - first)[unit]], unit, starts, text


def normalized(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of texts, sources) of normalised texts.

    sources has, for each byte, where in its text the source of it begins, and one entry more for each
    text, behind its bytes: where what was consumed ends. An empty text stays empty.
    """
    n = len(offsets) - 1
    out, unit, starts, text_of_unit = _units(data, offsets, _char_map(rules.compiled))
    text, source = text_of_unit[unit], starts[unit] - offsets[text_of_unit[unit]]
    consumed, skipped = np.diff(offsets), np.zeros(n, np.int64)
    alive = consumed > 0
    if rules.remove_extra:
        blank = out == 32
        new = np.ones(len(out), bool)
        new[1:] = unit[1:] != unit[:-1]
        head = np.flatnonzero(new)
        # Spaces at a unit's start go if what came before in the text ends with a space, or if nothing did.
        before = np.ones(len(head), bool)
        if len(head):
            before[1:] = blank[head[1:] - 1] | (text[head[1:]] != text[head[1:] - 1])
        rank = np.cumsum(new) - 1
        solid = np.maximum.accumulate(np.where(~blank, np.arange(len(out)), -1)) if len(out) else np.zeros(0, np.int64)
        leading = blank & (solid < head[rank])
        keep = ~(leading & before[rank])
        whole = np.bincount(unit[keep], minlength=len(starts)) == 0
        first_kept = np.full(n, -1, np.int64)
        # Units that are spaces alone, in front of everything else, are skipped before the prefix is put.
        one_space = (np.bincount(unit, minlength=len(starts)) == 1) & whole
        not_skipped = np.flatnonzero(~one_space)
        for t, u in zip(text_of_unit[not_skipped][::-1].tolist(), not_skipped[::-1].tolist(), strict=True):
            first_kept[t] = u
        alive &= first_kept >= 0
        skipped = np.where(first_kept >= 0, starts[np.maximum(first_kept, 0)] - offsets[:-1], consumed) if len(starts) else skipped
        out, text, source = out[keep], text[keep], source[keep]
        gone = ~alive[text]
        out, text, source = out[~gone], text[~gone], source[~gone]
    if rules.dummy_prefix:
        rows = np.flatnonzero(alive)
        put = np.searchsorted(text, rows, "right" if rules.as_suffix else "left")
        if not rules.as_suffix:
            out, text, source = np.insert(out, put, 32), np.insert(text, put, rows), np.insert(source, put, skipped[rows])
    if rules.escape:
        width = np.where(out == 32, 3, 1)
        first = np.cumsum(width) - width
        wide = np.repeat(out, width)
        spaces = first[out == 32]
        for i in range(3):
            wide[spaces + i] = _SPACE[i]
        out, text, source = wide, np.repeat(text, width), np.repeat(source, width)
    ends = np.where(alive, consumed, 0)
    if rules.remove_extra:
        mark = SPACE.encode() if rules.escape else b" "
        bounds, kept = np.searchsorted(text, np.arange(n + 1)), np.ones(len(out), bool)
        for t in range(n):
            b = int(bounds[t + 1])
            while b - len(mark) >= bounds[t] and out[b - len(mark) : b].tobytes() == mark:
                b -= len(mark)
                ends[t] = source[b]
            kept[b : bounds[t + 1]] = False
        out, text, source = out[kept], text[kept], source[kept]
    if rules.dummy_prefix and rules.as_suffix:
        mark = _SPACE if rules.escape else np.array([32], np.uint8)
        rows = np.repeat(np.flatnonzero(alive), len(mark))
        put = np.searchsorted(text, rows, "right")
        out, source, text = np.insert(out, put, np.tile(mark, len(rows) // len(mark))), np.insert(source, put, ends[rows]), np.insert(text, put, rows)
    bounds = np.searchsorted(text, np.arange(n + 1))
    return out, bounds, np.insert(source, bounds[1:], ends)


@dataclass(frozen=True)
class Model:
    """A model file: its bytes, the same without normalisation, its rules, and whether the ends of words end pieces."""

    whole: bytes
    plain: bytes
    rules: Rules
    by_word: bool

    @staticmethod
    def read(path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            whole = f.read()
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(whole)
        if any(p.type == _USER_DEFINED for p in m.pieces):
            raise ValueError("models with user-defined symbols, which normalisation leaves alone, are not supported")
        spec, trained = m.normalizer_spec, m.trainer_spec
        rules = Rules(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, trained.treat_whitespace_as_suffix)
        pieces = [p.piece for p in m.pieces if p.type not in (_UNKNOWN, _CONTROL, _BYTE)]
        # No piece has the space character behind another one: then none goes beyond a word, and words are split apart.
        by_word = rules.escape and all(SPACE not in p.lstrip(SPACE) for p in pieces) and (trained.byte_fallback or SPACE in pieces)
        spec.precompiled_charsmap, spec.normalization_rule_tsv = b"", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        return Model(whole, m.SerializeToString(), rules, by_word)


class Encoder:
    """Encodes chunks of texts; one for each worker and model."""

    def __init__(self, model: Model):
        from sentencepiece import SentencePieceProcessor

        self.rules, self.by_word = model.rules, model.by_word
        self.split, self.library = SentencePieceProcessor(model_proto=model.plain), SentencePieceProcessor(model_proto=model.whole)
        n = self.split.get_piece_size()
        kind = [0 if self.split.is_control(i) else 1 if self.split.is_byte(i) else -1 if self.split.is_unknown(i) else 2 for i in range(n)]
        #: Bytes of normalised text that each id stands for; -1: to be asked.
        self.bytes_of = np.array([len(self.split.id_to_piece(i).encode()) if k == 2 else k for i, k in enumerate(kind)], np.int64)

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in a row, the bytes of normalised text of each)."""
        found = self.split.encode([w.decode() for w in words], num_threads=1)
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
        size = self.bytes_of[ids]
        if (size < 0).any():
            first = np.cumsum(count) - count
            for i in np.unique(np.searchsorted(first, np.flatnonzero(size < 0), "right") - 1).tolist():
                size[first[i] : first[i] + count[i]] = [len(p.surface.encode()) for p in self.split.encode(words[i].decode(), return_type="proto").pieces]
        return count, ids, size

    def _word_starts(self, out: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        head = np.zeros(len(out) + 1, bool)
        head[bounds] = True
        if self.by_word and len(out) >= 3:
            mark = np.zeros(len(out) + 3, bool)
            mark[3:-2] = (out[:-2] == _SPACE[0]) & (out[1:-1] == _SPACE[1]) & (out[2:] == _SPACE[2])
            head[:-1] |= mark[3:] & ~mark[:-3]
        head[-1] = False
        return np.flatnonzero(head)

    def encode(self, data: np.ndarray, offsets: np.ndarray, begin: int | None, end: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first id of each text and one more, ids, begins, ends) of a chunk of texts; spans are bytes of the text."""
        n = len(offsets) - 1
        out, bounds, sources = normalized(data, offsets, self.rules)
        starts = self._word_starts(out, bounds)
        ids, size, text = (np.zeros(0, np.int64) for _ in range(3))
        if len(starts):
            ends = np.append(starts, len(out))
            kind, width = (pa.binary(), np.int32) if len(out) < 1 << 31 else (pa.large_binary(), np.int64)
            coded = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(np.ascontiguousarray(out))]).dictionary_encode()
            count, ids, size = self._look_up(coded.dictionary.to_pylist())
            which = coded.indices.to_numpy()
            first = (np.cumsum(count) - count)[which]
            count = count[which]
            at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            ids, size = ids[at], size[at]
            text = np.repeat(np.searchsorted(bounds, starts, "right") - 1, count)
        until = np.cumsum(size)
        low, high = sources[until - size + text], sources[until + text]
        length = np.diff(offsets)
        for value, behind in ((begin, False), (end, True)):
            if value is not None:
                put = np.searchsorted(text, np.arange(n), "right" if behind else "left")
                edge = length if behind else np.zeros(n, np.int64)
                ids, low, high, text = np.insert(ids, put, value), np.insert(low, put, edge), np.insert(high, put, edge), np.insert(text, put, np.arange(n))
        return np.searchsorted(text, np.arange(n + 1)), ids.astype(np.int32), low, high


@lru_cache(maxsize=4)
def encoder(model: Model) -> Encoder:
    return Encoder(model)


def encode(docs: DataFrame, model: Model, add_begin: bool = True, add_end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends) of every row of docs: the pieces' ids and the original bytes [begin, end) of each.

    ids are the library's for the whole text. A byte of a code point that the model has no piece for
    is one piece; the code point's span is that of its last byte, the others' are empty where it
    begins, as are all but the last of the pieces that come from one replaced prefix. Begin and end
    ids have empty spans at the text's ends. Null text counts as empty; a null id stays; repeated rows
    give repeated rows; other columns are not read. Texts are worked on in chunks of CHUNK_BYTES,
    a longer one by itself.
    """
    list_of = lambda: T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", list_of()), T.StructField("begins", list_of()), T.StructField("ends", list_of())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(model)
        begin, end = use.library.bos_id() if add_begin else None, use.library.eos_id() if add_end else None
        for batch in batches:
            for at, data, offsets in kernel.chunks(batch.column(1), CHUNK_BYTES):
                first, *values = use.encode(data, offsets, begin, end)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(v.astype(np.int32))) for v in values]
                yield pa.record_batch([batch.column(0).slice(at, len(offsets) - 1), *lists], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded with the library's text of each row's ids; no ids, null or empty, give an empty text. Columns: those of encoded, text."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(model).library
        for batch in batches:
            texts = [use.decode(ids) if ids else "" for ids in (x.as_py() for x in batch.column(at))]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digests(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of encode()'s rows.

    ids and spans (begin, end of each piece in turn) are hashed as little-endian unsigned 32-bit integers.
    """
    import hashlib

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), *[T.StructField(f"{c}_sha256", T.StringType()) for c in ("ids", "decoded", "spans")]])

    def hashed(values: bytes) -> str:
        return hashlib.sha256(values).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(model).library
        for batch in batches:
            first = batch.column(1).offsets.to_numpy()
            ids, low, high = (batch.column(i).values.to_numpy() for i in (1, 2, 3))
            spans = np.stack([low, high], axis=1).astype("<u4")
            told = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = ids[a:b]
                told.append((b - a, hashed(own.astype("<u4").tobytes()), hashed(use.decode(own.tolist()).encode() if b > a else b""), hashed(spans[a:b].tobytes())))
            yield pa.record_batch([batch.column(0), *[pa.array(c) for c in (zip(*told, strict=True) if told else ([],) * 4)]], schema=pa.schema(list(zip(schema.names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True))))

    return encoded.mapInArrow(run, schema)
