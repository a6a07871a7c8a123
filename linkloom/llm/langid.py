"""Language identification with interpolated Kneser-Ney character models.

Each language's model holds character 1- to 4-grams. Counts of 4-grams come from every training text, in
one distributed aggregation; the lower orders' continuation counts follow from the distinct 4-grams. Grams
are 64-bit keys (16 bits a character) in sorted arrays, found by binary search. A text goes to the
language with the lowest cross-entropy a character; it is rejected where that is far above what the
language's own text has, given its length.

No gram is left out, however many there are. Models are cut into slices by the two middle characters of a
4-gram: all that its probability needs of orders 3 and 4 lies in its slice, and the pairs that orders 1 and 2
come from are in every slice. Slices are held one after the other; the texts' sums go along as a column.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import documents, written

ORDER = 4
#: 4-grams of all languages that a slice of the models holds, on average: bounds what is broadcast.
GRAMS_AT_ONCE = 4_000_000
#: Absolute discount of every order.
DISCOUNT = 0.75
#: Rejected: so many standard errors above the language's own mean cross-entropy, and this much besides.
REJECT_Z, REJECT_NATS = 6.0, 0.35
#: Characters after which more text makes the score no surer.
SURE_AT = 40
#: Characters counted or scored at once.
AT_ONCE = 1 << 22
SPACE = 32
#: Codes without letters, the surrogates and the private ones: letters above U+FFFF go there, those of a script each to its own.
WIDE, WIDE_CODES = 0xD800, 0x2100
#: Odd multiplier that spreads pairs of characters; a 32-bit number times it stays below 2 ** 63.
SPREAD = 0x5BD1E995
_LOW = np.array([chr(c).isalpha() for c in range(0x3000)])


def codes(text: str | None) -> np.ndarray:
    """Lower-cased letters as 16-bit codes; each run of anything else is one space; none at the ends.

    Letters above U+FFFF that lie a multiple of WIDE_CODES apart share a code: never two of one script, but for the
    rare ideographs beyond the first 8,448 of their extension.
    """
    if not text:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _LOW[np.minimum(c, len(_LOW) - 1)]
    high = np.flatnonzero(c >= len(_LOW))
    if len(high):
        kinds, back = np.unique(c[high], return_inverse=True)
        letter[high] = np.array([chr(k).isalpha() for k in kinds])[back]
    c = np.where(letter, np.where(c > 0xFFFF, WIDE + (c - 0x10000) % WIDE_CODES, c), SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = c[keep]
    if len(c) and c[-1] == SPACE:
        c = c[:-1]
    return c.astype(np.uint64)


def grams(c: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each character, with spaces before the text, and one for the space after it."""
    if not len(c):
        return np.zeros(0, np.uint64)
    x = np.concatenate([np.full(ORDER - 1, SPACE, np.uint64), c, np.array([SPACE], np.uint64)])
    key = x[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        key |= x[ORDER - 1 - k : len(x) - k] << np.uint64(16 * k)
    return key


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``texts`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            held = 0

            def out() -> Iterator[pa.RecordBatch]:
                for lang, parts in by.items():
                    key, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
                by.clear()

            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g = grams(codes(text.as_py()))
                by.setdefault(lang, []).append(g)
                held += len(g)
                if held > AT_ONCE:
                    yield from out()
                    held = 0
            yield from out()

    part = texts.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slice_of(key: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each 4-gram, from its two middle characters; in_slice() says the same."""
    return ((key >> np.uint64(16) & np.uint64(0xFFFFFFFF)) * np.uint64(SPREAD) >> np.uint64(20)) % np.uint64(slices)


def in_slice(k: int, slices: int) -> Column:
    middle = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(middle * F.lit(SPREAD), 20) % F.lit(slices) == k


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, i, -1)


class Model:
    """One language: for each order sorted grams with their probabilities, sorted contexts with their weights.

    ``keys`` are the 4-grams of a slice. ``pairs`` are the 2-grams of the whole language with the number of
    characters before each; without them they come from the keys.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        tables = [(keys, counts.astype(float))]
        for n in range(ORDER - 1, 0, -1):
            low = tables[-1][0] & np.uint64((1 << 16 * n) - 1)
            tables.append(pairs if n == 2 and pairs else _sums(low, np.ones(len(low))))
        below = None
        self.floor = 1.0 / (len(tables[-1][0]) + 1)
        for n, (k, c) in enumerate(reversed(tables), 1):
            context = k >> np.uint64(16)
            ctx, total = _sums(context, c)
            kinds = _sums(context, np.ones(len(k)))[1]
            weight = DISCOUNT * kinds / total
            where = _at(ctx, context)
            lower = self.floor if below is None else below(k & np.uint64((1 << 16 * (n - 1)) - 1))
            self.orders.append((k, np.maximum(c - DISCOUNT, 0) / total[where] + weight[where] * lower, ctx, weight))
            below = self.probability
        p = np.log(self.probability(keys))
        #: Of the language's own 4-grams: their number, their log-probabilities' sum, and that of the squares.
        self.moments = np.array([counts.sum(), (counts * p).sum(), (counts * p * p).sum()], float)

    def probability(self, key: np.ndarray) -> np.ndarray:
        """Of the last character after the others, by the orders made so far."""
        p = np.full(len(key), self.floor)
        for n, (keys, prob, ctx, weight) in enumerate(self.orders, 1):
            own = key & np.uint64((1 << 16 * n) - 1) if n < ORDER else key
            i, h = _at(keys, own), _at(ctx, own >> np.uint64(16))
            if len(keys):
                p = np.where(i >= 0, prob[i], np.where(h >= 0, weight[h] * p, p))
        return p


Table = tuple[np.ndarray, np.ndarray]


class Identifier:
    """A slice of all languages' models: their log-probabilities of every 4-gram that any of them has."""

    def __init__(self, counts: dict[str, Table], pairs: dict[str, Table], k: int, slices: int):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.k, self.slices, self.langs = k, slices, sorted(pairs)
        self.models = [Model(*counts.get(x, none), pairs[x]) for x in self.langs]
        self.keys = np.unique(np.concatenate([m.orders[-1][0] for m in self.models])) if pairs else none[0]
        self.logs = np.stack([np.log(m.probability(self.keys)) for m in self.models], axis=1).astype(np.float32) if pairs else np.zeros((0, 0), np.float32)

    def scores(self, key: np.ndarray) -> np.ndarray:
        i = _at(self.keys, key)
        out = self.logs[i].astype(np.float64) if len(self.keys) else np.zeros((len(key), len(self.langs)))
        miss = np.flatnonzero(i < 0)
        if len(miss):
            kinds, back = np.unique(key[miss], return_inverse=True)
            out[miss] = np.log(np.stack([m.probability(kinds) for m in self.models], axis=1))[back]
        return out

    def sums(self, key: np.ndarray) -> np.ndarray:
        """Each language's log-probability of those of a text's 4-grams that are of this slice."""
        total = np.zeros(len(self.langs))
        for at in range(0, len(key) if self.langs else 0, 1 << 18):
            part = key[at : at + (1 << 18)]
            total += self.scores(part if self.slices == 1 else part[slice_of(part, self.slices) == self.k]).sum(axis=0)
        return total


def verdict(langs: list[str], own: np.ndarray, total: np.ndarray, n: int) -> tuple[str, float, float | None, bool]:
    """(language, score from 0 to 1, cross-entropy, rejected) of a text of n 4-grams.

    ``own`` holds each language's moments, ``total`` each language's log-probability of the text.
    """
    if not n or not langs:
        return "und", 0.0, None, True
    h = -total / n
    best = int(np.argmin(h))
    count, first, second = own[best]
    mean, sd = -first / count, np.sqrt(max(0.0, second / count - (first / count) ** 2))
    rejected = h[best] > mean + REJECT_NATS + REJECT_Z * sd / np.sqrt(n)
    odds = np.exp(-(h - h[best]) * min(n, SURE_AT))
    return langs[best], float(1 / odds.sum()) * (0.5 if rejected else 1.0), float(h[best]), bool(rejected)


def _by_lang(rows: DataFrame) -> dict[str, Table]:
    """The rows (lang, gram, n) as sorted arrays of each language."""
    got = rows.toArrow()
    lang, gram, n = (got.column(c) for c in ("lang", "gram", "n"))
    out = {}
    for x in pa.compute.unique(lang).to_pylist():
        mask = pa.compute.equal(lang, x)
        key = gram.filter(mask).to_numpy().view(np.uint64)
        order = np.argsort(key)
        out[x] = key[order], n.filter(mask).to_numpy()[order]
    return out


class Trained(NamedTuple):
    """All languages' 4-grams as a written table, their pairs, and into how many slices the models are cut."""

    grams: DataFrame
    pairs: dict[str, Table]
    slices: int

    def part(self, k: int) -> Identifier:
        return Identifier(_by_lang(self.grams.filter(in_slice(k, self.slices)) if self.slices > 1 else self.grams), self.pairs, k, self.slices)


def train(texts: DataFrame, at_once: int = GRAMS_AT_ONCE) -> Trained:
    """Models of all languages in ``texts`` (lang, text); rows with a null language or text are left out.

    The driver gathers the pairs of characters, at most the square of the alphabet a language, and one
    slice of about ``at_once`` 4-grams at a time.
    """
    grams = written(gram_counts(texts.filter("lang IS NOT NULL AND text IS NOT NULL AND lang <> 'und'")), "grams")
    triples = grams.select("lang", F.col("gram").bitwiseAND(F.lit((1 << 48) - 1)).alias("gram")).distinct()
    pairs = triples.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 32) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return Trained(grams, _by_lang(pairs), max(1, -(-grams.count() // at_once)))


def identified(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) of every row of ``docs``.

    A null text, or one without letters, is ``und`` with score 0; ties go to the first language by name.
    Rows stand for themselves; an empty table gives an empty result; only id and text are read. With more
    than one slice the texts are written again for each but the last, with their sums so far.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<double>").alias("sums"))
    langs, own = sorted(trained.pairs), np.zeros((len(trained.pairs), 3))

    def added(b: pa.RecordBatch, here: Identifier) -> Iterator[tuple[np.ndarray, int]]:
        for text, before in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            key = grams(codes(text.as_py()))
            yield here.sums(key) + (np.array(before) if before else 0.0), len(key)

    for k in range(trained.slices):
        part = trained.part(k)
        own = own + np.array([m.moments for m in part.models]).reshape(own.shape)
        # Pickled by value, like the task: executors have no copy of this package.
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(part))

        def on(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            here = pickle.loads(shared.value)
            for b in batches:
                sums = pa.array([x.tolist() for x, _ in added(b, here)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sums], names=["id", "text", "sums"])

        if k < trained.slices - 1:
            rows = written(rows.mapInArrow(on, f"id {kind}, text string, sums array<double>"), "sums")
            shared.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = pickle.loads(shared.value)
        for b in batches:
            if b.num_rows:
                found = [verdict(langs, own, x, n) for x, n in added(b, here)]
                cols = zip(zip(*found, strict=True), [pa.string(), pa.float64(), pa.float64(), pa.bool_()], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in cols)], names=[id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def op2_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    trained = train(docs.filter(F.coalesce(fold, F.lit(0)) != 2).select("lang", "text"))
    out = identified(docs, trained)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
