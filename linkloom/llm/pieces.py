"""SentencePiece encoding and decoding with exact source offsets.

The text is normalised here, by longest-prefix matching through the model's compiled character map (a
double-array trie), and each normalised byte remembers the source bytes it came from. The library merges
the pieces; their lengths, laid over the normalised bytes, project every piece to a span of source bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import documents, text_bytes

MARK = "▁".encode()


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: the trie's units, then the replacements, each ended by a zero byte."""

    def __init__(self, raw: bytes):
        size = struct.unpack_from("<I", raw)[0] if raw else 0
        self.units = struct.unpack_from(f"<{size // 4}I", raw, 4) if raw else ()
        self.texts = raw[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key that ``data`` has at ``at``: its length and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Normaliser:
    """The model's normaliser, with the source span of every byte that it makes."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        trainer = dict(_fields(next((v for k, v in _fields(model) if k == 2), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        self.suffix = bool(trainer.get(24, 0))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes; for each the first source byte and the one after the last."""
        if self.map.units or self.squeeze or self.suffix:
            return self._general(data)
        # No character is mapped: spaces become marks, and one goes first.
        src = np.frombuffer(data, np.uint8)
        if not len(src):
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = np.where(src == 32, len(MARK), 1) if self.escape else np.ones(len(src), np.int64)
        start = np.repeat(np.arange(len(src)), wide)
        out = data.replace(b" ", MARK) if self.escape else data
        if self.prefix:
            lead = MARK if self.escape else b" "
            out, start = lead + out, np.concatenate([np.zeros(len(lead), np.int64), start])
            return out, start, np.concatenate([np.zeros(len(lead), np.int64), start[len(lead) :] + 1])
        return out, start, start + 1

    def _general(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                size, text = hit
            else:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                text = data[at : at + size]
            # A replacement of several bytes spans all its key.
            for k in range(len(text)):
                parts.append((text[k : k + 1], at, at + size))
            at += size
        space = MARK if self.escape else b" "
        if self.squeeze:
            kept: list[tuple[bytes, int, int]] = []
            for p in parts:
                if p[0] == b" " and (not kept or kept[-1][0] == b" "):
                    continue
                kept.append(p)
            while kept and kept[-1][0] == b" ":
                kept.pop()
            parts = kept
        if not parts:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = [(space if b == b" " else b, i, j) for b, i, j in parts]
        if self.prefix:
            lead = (space, parts[0][1], parts[0][1]) if not self.suffix else (space, parts[-1][2], parts[-1][2])
            out = [*out, lead] if self.suffix else [lead, *out]
        start = np.concatenate([np.full(len(b), i, np.int64) for b, i, _ in out])
        end = np.concatenate([np.full(len(b), j, np.int64) for b, _, j in out])
        return b"".join(b for b, _, _ in out), start, end


class Pieces:
    """A model with its normaliser: ids, their source spans, and back."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.normalise = Normaliser(f.read())
        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sizes = np.array([1 if p.is_byte(i) else -1 if p.is_unknown(i) else 0 if p.is_control(i) else len(p.id_to_piece(i).encode()) for i in range(p.get_piece_size())])

    def spans(self, data: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First source byte and the one after the last, of each piece; control pieces span nothing."""
        plain, start, end = self.normalise(data)
        sizes = self.sizes[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
        if (sizes < 0).any():
            # What an unknown piece covers is known from the library's own pieces only.
            words = iter(self.library.encode(data.decode(), out_type=str))
            sizes = np.array([0 if self.library.is_control(i) else len(next(words).encode()) if s != 1 or not self.library.is_byte(i) else (next(words), 1)[1] for i, s in zip(ids, sizes, strict=True)], np.int64)
        stop = np.cumsum(sizes)
        if len(stop) and stop[-1] != len(plain):
            raise ValueError(f"pieces cover {stop[-1]} of {len(plain)} normalised bytes")
        first = stop - sizes
        begin = np.r_[start, len(data)][np.minimum(first, len(start))]
        return np.where(sizes > 0, begin, begin), np.where(sizes > 0, np.r_[end, len(data)][np.maximum(stop - 1, 0)], begin)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, n_tokens, ids, starts, ends, decoded) of every row: ids with begin and end, byte spans, text.

    Null counts as empty (two ids, no text); each row stands for itself, so repeated rows and ids give
    repeated results; an empty table gives an empty result. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    cols = f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, starts array<int>, ends array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for key, data, ids, text in _coded(model, batches):
            begin, end = zip(*(model.spans(d, i) for d, i in zip(data, ids, strict=True)), strict=True) if spans and data else ([None] * len(ids),) * 2
            yield pa.RecordBatch.from_arrays([key, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(begin, pa.list_(pa.int32())), pa.array(end, pa.list_(pa.int32())), pa.array(text)], names=[id_col, "n_tokens", "ids", "starts", "ends", "decoded"])

    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, cols)


def _coded(model: Pieces, batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.Array, list[bytes], list[list[int]], list[str]]]:
    """Keys, texts, ids and decoded texts, of a few MB of text at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
        cut = np.flatnonzero(np.diff(size // most)) + 1
        for i, j in zip([0, *cut], [*cut, b.num_rows], strict=True):
            data = b.column(1).slice(i, j - i).to_pylist()
            ids = model.library.encode([d.decode() for d in data], add_bos=True, add_eos=True, num_threads=1)
            yield b.column(0).slice(i, j - i), data, ids, model.library.decode(ids, num_threads=1)


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, covered[, ids]): as encoded(), with digests made where it runs.

    covered counts the source bytes that lie in the span of some piece.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for key, data, ids, text in _coded(model, batches):
            rows = []
            for d, i, t in zip(data, ids, text, strict=True):
                begin, end = model.spans(d, i)
                covered = int(np.maximum(end - np.maximum(begin, np.r_[0, np.maximum.accumulate(end)[:-1]]), 0).sum())
                rows.append((len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), covered))
            n, one, two, three = zip(*rows, strict=True)
            more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(one), pa.array(two), pa.array(three, pa.int64()), *more], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "covered", "ids"][: 5 + len(more)])

    cols = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, cols)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(documents(spark, sf_dir), model_path(), with_ids=False)
