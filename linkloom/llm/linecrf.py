"""Quality rules with line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate; Viterbi
decoding finds the best labelling, and the share of words in content lines decides whether the text stays.

Lines have no labels of their own; a bounded sample of documents has. So the field is trained by expectation-
maximisation with a constraint on each document: of a good one at least GOOD_SHARE of the words are expected in content
lines, of a bad one at most BAD_SHARE. The likeliest labels of the lines, their posteriors moved just as far as the
constraint asks, are what the next gradient steps on the likelihood aim at. It starts from plain marks of boilerplate
lines, to which weights that the sample says nothing about return; which lines of a document are which, and how labels
follow each other, is learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import documents, text_bytes

#: Labelled documents of each class that the field is fitted on, first ones by hash.
SAMPLE = 2000
#: Least share of words in content lines of a document that stays.
CONTENT_SHARE = 0.5
MIN_WORDS = 50
#: Expected shares of words in content lines that training holds good and bad documents to.
GOOD_SHARE, BAD_SHARE = 0.6, 0.3
BLANK = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
NOTICE = re.compile(rb"licen[sc]ed? under|all rights reserved|copyright|released under|cookie|subscribe|privacy policy|terms of (?:use|service)|click here|sign up|log ?in", re.I)
LINK = re.compile(rb"https?://|www\.|\S@\S+\.\S")
N_FEATURES = 24
BOILERPLATE, CONTENT = 0, 1


def _without(data: bytes, chars: bytes) -> int:
    """How many of ``chars`` there are."""
    return len(data) - len(data.translate(None, chars))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window that the text has twice or more, its first place included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    size = len(number)
    key = ids[:-2] * size + ids[1:-1]
    if size >= 1 << 20:  # the pair is numbered anew, so that the triple fits in 63 bits
        key = np.unique(key, return_inverse=True)[1]
    key = key * size + ids[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[back] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - _without(text, BLANK)
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += bool(line.split())
        else:
            seen.add(line)
    return len(words), chars, _without(text, SYMBOLS), again, repeated_words(words)


def line_features(text: bytes) -> tuple[list[list[int]], list[int]]:
    """For each line with a word, the features that hold and its number of words."""
    lines = [(x, w) for x in text.split(b"\n") if (w := x.split())]
    seen: set[bytes] = set()
    out, sizes = [], []
    for k, (line, words) in enumerate(lines):
        n, letters = len(words), _without(line, LETTERS)
        f = [0, 1 if n <= 2 else 2 if n <= 5 else 3 if n <= 10 else 4]
        symbols = _without(line, SYMBOLS) / n
        f.append(5 if symbols == 0 else 6 if symbols < 0.15 else 7 if symbols < 0.5 else 8)
        if line.count(b"|") / n > 0.2:
            f.append(9)
        if line.count(b"!") / n > 0.4:
            f.append(10)
        upper = _without(line, UPPER)
        f.append(11 if upper > 0.5 * letters else 12 if upper > 0.2 * letters else 13)
        if n > 3:
            beside = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1)
            f.append(14 if beside > 0.3 else 15 if beside > 0.1 else 16)
            if len(set(words)) < 0.35 * n:
                f.append(17)
        if _without(line, DIGITS) > 0.3 * len(line):
            f.append(18)
        if NOTICE.search(line):
            f.append(19)
        if LINK.search(line):
            f.append(20)
        if line.rstrip()[-1:] in (b".", b"?", b"!", b":", b'"'):
            f.append(21)
        if line in seen:
            f.append(22)
        if k == 0 or k == len(lines) - 1:
            f.append(23)
        seen.add(line)
        out.append(f)
        sizes.append(n)
    return out, sizes


class Lines:
    """The lines of several texts, stepped through together: the k-th lines of all that have one."""

    def __init__(self, texts: list[list[list[int]]]):
        length = np.array([len(t) for t in texts], np.int64)
        self.matrix = np.zeros((int(length.sum()), N_FEATURES))
        for row, f in enumerate(f for t in texts for f in t):
            self.matrix[row, f] = 1
        self.text = np.repeat(np.arange(len(texts)), length)
        self.start = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        self.first, size = self.start[order], length[order]
        self.alive = [int((size > k).sum()) for k in range(int(size[0]) if len(size) else 0)]

    def posteriors(self, score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each line's posterior of both labels, expected number of each move, each line's log partition sum of its text)."""
        first, alive = self.first, self.alive
        fore, back = np.empty_like(score), np.zeros_like(score)
        for k, n in enumerate(alive):
            at = first[:n] + k
            fore[at] = score[at] if k == 0 else score[at] + np.logaddexp(fore[at - 1, :1] + move[0], fore[at - 1, 1:] + move[1])
        for k in range(len(alive) - 2, -1, -1):
            at = first[: alive[k + 1]] + k
            nxt = score[at + 1] + back[at + 1]
            back[at] = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
        both = fore + back
        norm = np.logaddexp(both[:, 0], both[:, 1])
        moves = np.zeros((2, 2))
        for k in range(len(alive) - 1):
            at = first[: alive[k + 1]] + k
            joint = fore[at][:, :, None] + move + (score[at + 1] + back[at + 1])[:, None, :] - norm[at][:, None, None]
            moves += np.exp(joint).sum(axis=0)
        return np.exp(both - norm[:, None]), moves, norm

    def moves(self, label: np.ndarray) -> np.ndarray:
        """How often each label follows each in a text."""
        same = self.text[1:] == self.text[:-1]
        return np.bincount((2 * label[:-1] + label[1:])[same], minlength=4).reshape(2, 2).astype(float)

    def constrained(self, score: np.ndarray, move: np.ndarray, words: np.ndarray, good: np.ndarray) -> np.ndarray:
        """The lines' posteriors with a score added to the content label of all lines of a text, just enough for its share."""
        total = np.bincount(self.text, words, len(good))

        def held(offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            moved = score.copy()
            moved[:, CONTENT] += offset[self.text]
            p = self.posteriors(moved, move)[0]
            return p, np.bincount(self.text, words * p[:, CONTENT], len(good)) / total

        zero, far = np.zeros(len(good)), np.where(good, 30.0, -30.0)
        met = lambda share: np.where(good, share >= GOOD_SHARE, share <= BAD_SHARE)
        free = met(held(zero)[1])
        near = zero.copy()
        for _ in range(10):
            middle = (near + far) / 2
            ok = met(held(middle)[1])
            near, far = np.where(ok, near, middle), np.where(ok, middle, far)
        return held(np.where(free, zero, far))[0]


class LineField:
    """Two labels: a weight for each feature and label, and for each pair of neighbouring labels."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def by_hand(cls) -> LineField:
        """Where no labelled document is to be had: marks of boilerplate with plain weights."""
        emit = np.zeros((N_FEATURES, 2))
        emit[0, CONTENT] = 1.0
        for k in (8, 9, 10, 11, 14, 17, 18, 19, 22):
            emit[k, BOILERPLATE] = 2.0
        return cls(emit, np.array([[0.5, 0.0], [0.0, 0.5]]))

    @classmethod
    def fitted(cls, texts: list[list[list[int]]], words: list[list[int]], labels: list[int], rounds: int = 6, steps: int = 15, rate: float = 0.1, decay: float = 1e-3) -> LineField:
        """Of texts with their lines' features and numbers of words, and whether each is good: constrained EM."""
        if len(set(labels)) < 2:
            return cls.by_hand()
        lines, good = Lines(texts), np.array(labels) == 1
        size = np.array([n for t in words for n in t], float)
        own = cls.by_hand()
        emit, move = own.emit, own.move
        se, sm = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
        # Texts of both kinds weigh the same, whatever their numbers of lines.
        lines_of = np.array([(good[lines.text] == k).sum() for k in (False, True)], float)
        weight = (len(size) / 2 / np.maximum(lines_of, 1))[good[lines.text].astype(int)]
        for _ in range(rounds):
            label = lines.constrained(lines.matrix @ emit, move, size, good).argmax(axis=1)
            target, pairs = np.eye(2)[label], lines.moves(label)
            for _ in range(steps):
                p, expect, _ = lines.posteriors(lines.matrix @ emit, move)
                ge = lines.matrix.T @ (weight[:, None] * (target - p)) / len(size) - decay * (emit - own.emit)
                gm = (pairs - expect) / len(size) - decay * (move - own.move)
                se += ge**2
                sm += gm**2
                emit = emit + rate * ge / np.sqrt(se)
                move = move + rate * gm / np.sqrt(sm)
        return cls(emit, move)

    def decode(self, features: list[list[int]]) -> list[int]:
        """The best labels, by Viterbi's algorithm."""
        if not features:
            return []
        e, ((m00, m01), (m10, m11)) = self.emit.tolist(), self.move.tolist()
        a, b, back = 0.0, 0.0, []
        for k, f in enumerate(features):
            s0, s1 = sum(e[j][0] for j in f), sum(e[j][1] for j in f)
            if k:
                from0, from1 = a + m00 < b + m10, a + m01 < b + m11
                back.append((from0, from1))
                a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
            else:
                a, b = s0, s1
        out = [int(b >= a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, flag: str = "quality") -> DataFrame:
    """(doc_id, text, flag) of at most ``per_class`` labelled documents of each class, first by hash.

    Of a document with several labels the least counts; rows of one id are that document, repeated.
    """
    known = labels.filter(F.col(flag).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(flag).cast("int")).alias(flag))
    ids = None
    for value in (0, 1):
        some = known.filter(F.col(flag) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    # At most 2 * per_class ids: a proven bound.
    return docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", flag)


def fit_field(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> LineField:
    """The field of a bounded sample of labelled documents; by_hand() if a class has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [line_features(t) for t in b.column(1).to_pylist()]
            lines = pa.array([[sum(1 << f for f in x) for x in r] for r, _ in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lines, pa.array([n for _, n in rows], pa.list_(pa.int32()))], names=["doc_id", "quality", "lines", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = labelled_sample(docs, labels, per_class).mapInArrow(run, f"doc_id {kind}, quality int, lines array<int>, words array<int>").collect()
    got = sorted((r.doc_id, r.quality, r.lines, r.words) for r in got if r.lines)
    return LineField.fitted([[[k for k in range(N_FEATURES) if x >> k & 1] for x in lines] for _, _, lines, _ in got], [w for *_, w in got], [q for _, q, _, _ in got])


def quality_rules(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """The base figures, base_failed, content_share and kept, for every row of ``docs``.

    A null text has no words and fails the base rules. content_share is 0 for a text without words. Rows
    stand for themselves; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    cols = f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean, n_lines int, n_content_lines int, content_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                own = base(t)
                failed = own[0] < MIN_WORDS or 100 * own[4] > 50 * own[0]
                features, sizes = line_features(t)
                marks = field.decode(features)
                part = sum(n for n, y in zip(sizes, marks, strict=True) if y) / own[0] if own[0] else 0.0
                rows.append((*own, failed, not failed and part >= share, len(marks), sum(marks), part))
            if rows:
                types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int32()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True))], names=[id_col, *names, "base_failed", "kept", "n_lines", "n_content_lines", "content_share"])

    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, cols)


def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules(docs, fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
