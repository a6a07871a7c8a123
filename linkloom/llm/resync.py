"""Token counts of huge documents by overlap resynchronisation.

A document longer than CHUNK characters is cut into chunks that overlap. Each chunk is encoded by itself,
with the offset of every token. Two neighbours are spliced at a token boundary that both have in the
overlap and that is *proven* stable: no piece of the vocabulary holds the two characters on its sides next
to each other, so no merge crosses it, whatever stands around; what lies on either side is then encoded as
in the whole text. Where an overlap has no such boundary, it is doubled, at last to the whole rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import documents, text_bytes
from linkloom.llm.pieces import MARK, Normaliser, model_path

#: Characters of a chunk and of the first overlap.
CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096


class Counter:
    """Counts a model's tokens. Models that map or squeeze characters, whose pieces' places are not those of the text, are refused."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        with open(path, "rb") as f:
            n = Normaliser(f.read())
        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        own = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        self.inside = {x[k : k + 2] for x in own for k in range(len(x) - 1)}
        self.sizes = np.array([0 if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) else len(p.id_to_piece(i)) for i in range(p.get_piece_size())])
        self.bytes = np.array([p.is_byte(i) for i in range(p.get_piece_size())])
        if n.map.units or n.squeeze or n.suffix or not n.prefix or not n.escape:
            raise ValueError("chunks can be spliced for models only that keep every character and mark spaces")

    def starts(self, text: str, ids: list[int]) -> dict[int, int]:
        """Offset in ``text`` at which a token starts: number of tokens before. Starts inside a character are left out."""
        mark = MARK.decode()
        out, at, rest = {}, -1, 0
        for n, i in enumerate(ids):
            if self.bytes[i]:
                if rest:
                    rest -= 1
                    continue
                out[at] = n
                rest = len(text[at].encode()) - 1 if at >= 0 else 0
                at += 1
            else:
                out[at] = n
                at += int(self.sizes[i]) if self.sizes[i] else 1
        if at != len(text):
            raise ValueError(f"tokens cover {at} of {len(text)} characters: {mark}")
        return out

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge can cross the boundary before ``at``."""
        return 0 < at < len(text) and text[at - 1 : at + 1].replace(" ", MARK.decode()) not in self.inside

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.library.encode(text, num_threads=1))
        total, begin, skip = 0, 0, 0
        # skip: the offset in the text up to which tokens are counted already
        ids = self.library.encode(text[: self.chunk], num_threads=1)
        stop = self.chunk
        starts = self.starts(text[:stop], ids)
        while stop < len(text):
            wide = self.overlap
            while True:
                after = max(begin, stop - wide)
                until = min(len(text), max(stop, after + self.chunk))
                more = self.library.encode(text[after:until], num_threads=1)
                other = self.starts(text[after:until], more)
                common = [k for k in range(stop - 1, max(after, skip), -1) if k - begin in starts and k - after in other and self.stable(text, k)]
                if common:
                    k = common[0]
                    total += starts[k - begin] - (starts[skip - begin] if skip > begin else 0)
                    begin, stop, ids, starts, skip = after, until, more, other, k
                    break
                self.widened += 1
                if after == begin:
                    # Nothing in all the chunk: it grows to the right instead.
                    stop = min(len(text), stop + self.chunk)
                    ids = self.library.encode(text[begin:stop], num_threads=1)
                    starts = self.starts(text[begin:stop], ids)
                    if stop == len(text):
                        break
                wide *= 2
        return total + len(ids) - (starts[skip - begin] if skip > begin else 0)

    def counts(self, texts: list[str]) -> list[int]:
        """Of all texts; those of one chunk are encoded together."""
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, ids in zip(short, self.library.encode([texts[i] for i in short], num_threads=1) if short else [], strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.count(t)
        return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; null counts as empty, which has no tokens.

    Each row stands for itself, so repeated rows give repeated results; an empty table gives an empty
    result. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.column(1).slice(i, 256)
                data = part.to_pylist()
                n = counter.counts([d.decode() for d in data])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array([len(d) for d in data], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_resync_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), model_path())
