"""Quality classifier from overlapping weak labellers.

Heuristic labellers vote good, bad or nothing on every document, for two hidden facts: whether it is junk
and whether it is toxic. Expectation-maximisation over the counts of the vote patterns, of which there are
few, whatever the number of documents, estimates how often each labeller is right. The posteriors label a
bounded sample, on which a sparse linear scorer over hashed features is trained; it scores every text.

Given labels have no vote. Two of the labellers look for words, two for stems, that mark toxic documents of one
half each of a bounded labelled sample: without labels these abstain.
"""

from __future__ import annotations

import operator
import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import documents, text_bytes, written
from linkloom.llm.linecrf import BLANK, LETTERS, SYMBOLS, UPPER, _without, repeated_words

#: Documents that the scorer is trained on, and labelled documents that the lexicon is drawn from, by hash.
SAMPLE, LEXICON_SAMPLE = 12_000, 12_000
HASH_BITS = 18
ABSTAIN, GOOD, BAD = 0, 1, 2
JUNK = ("symbols", "upper", "bangs", "beside", "pipes", "repeats", "variety", "letters", "prose")
TOXIC = ("insults", "words of half 0", "words of half 1", "stems of half 0", "stems of half 1")
#: Words in a window over which the variety of words is taken, so that it doesn't fall with a text's length.
WINDOW = 500
#: Kept: a probability of being bad below this.
THRESHOLD = 0.5
INSULTS = frozenset(b"idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns".split())
#: First bytes of a word that count as a feature of their own.
STEM = 4
#: ASCII letters are lower-cased; what else is ASCII parts words.
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Starting values that keep the hashes of words, stems and names apart.
OF_WORD, OF_STEM, OF_NAME = 0, 0x5E3D, 0x7A11
STEPS = {"symbols": (0.02, 0.1, 0.3, 0.6), "upper": (0.1, 0.2, 0.35, 0.5), "bangs": (0.05, 0.3), "beside": (0.02, 0.1, 0.3), "pipes": (0.02, 0.2), "repeats": (0.1, 0.3, 0.5), "variety": (0.2, 0.4, 0.6), "letters": (0.5, 0.7)}


def style(text: bytes) -> dict[str, float]:
    """Shares that tell prose from junk, of the whole text."""
    words = text.split()
    n = max(1, len(words))
    size = max(1, len(text) - _without(text, BLANK))
    letters = max(1, _without(text, LETTERS))
    return {
        "n": float(len(words)),
        "symbols": _without(text, SYMBOLS) / n,
        "upper": _without(text, UPPER) / letters,
        "bangs": text.count(b"!") / n,
        "beside": sum(map(operator.eq, words, words[1:])) / n,
        "pipes": text.count(b"|") / n,
        "repeats": repeated_words(words) / n,
        "variety": sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)) / n,
        "letters": letters / size,
    }


def junk_votes(s: dict[str, float]) -> list[int]:
    """The heuristic labellers' votes on junk, in the order of JUNK."""
    if not s["n"]:
        return [ABSTAIN] * len(JUNK)
    bad = [s["symbols"] > 0.3, s["upper"] > 0.5, s["bangs"] > 0.3, s["beside"] > 0.2, s["pipes"] > 0.2, s["n"] >= 20 and s["repeats"] > 0.5, s["n"] >= 20 and s["variety"] < 0.25, s["letters"] < 0.6]
    prose = s["symbols"] < 0.05 and s["upper"] < 0.2 and s["beside"] < 0.05 and s["bangs"] < 0.1 and s["repeats"] <= 0.5
    # Each kind of junk trips one labeller or two: the others then have nothing to say, only the last vouches.
    return [BAD if x else ABSTAIN for x in bad] + [GOOD if prose else ABSTAIN]


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(FOLD).split())


def stems(words: set[bytes]) -> set[bytes]:
    return {w[:STEM] for w in words if len(w) > STEM}


class Lexicon(NamedTuple):
    """Words and stems of toxic texts: those of each half of the labelled sample."""

    words: tuple[frozenset[bytes], frozenset[bytes]] = (frozenset(), frozenset())
    stems: tuple[frozenset[bytes], frozenset[bytes]] = (frozenset(), frozenset())

    def hits(self, words: set[bytes], stems: set[bytes]) -> int:
        return len((self.words[0] | self.words[1]) & words) + len((self.stems[0] | self.stems[1]) & stems)

    def votes(self, words: set[bytes], stems: set[bytes]) -> list[int]:
        """In the order of TOXIC. An empty list has nothing to say."""
        listed = [(own, words) for own in self.words] + [(own, stems) for own in self.stems]
        return [ABSTAIN if INSULTS.isdisjoint(words) else BAD] + [ABSTAIN if not own else GOOD if own.isdisjoint(has) else BAD for own, has in listed]


def hashed(text: bytes, lexicon: Lexicon) -> np.ndarray:
    """Distinct feature numbers of a text: its words, their stems, its style and its lexicon hits in steps."""
    words, s = words_of(text), style(text)
    parts = stems(words)
    names = [f"{k}>{x}" for k, xs in STEPS.items() for x in xs if s[k] > x]
    hits = lexicon.hits(words, parts)
    names += [f"lexicon>{k}" for k in (0, 1) if hits > k]
    if not INSULTS.isdisjoint(words):
        names.append("insult")
    crc = zlib.crc32
    every = [*map(crc, words), *(crc(x, OF_STEM) for x in parts), *(crc(x.encode(), OF_NAME) for x in names)]
    return np.unique(np.concatenate([[1], 2 + np.array(every, np.int64) % ((1 << HASH_BITS) - 2)]).astype(np.int64))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of bad for each pattern, votes' probabilities [labeller, class, vote], prior).

    Labellers are taken to err independently, given the class; all get pseudo-counts in favour of being
    right, with which the first round begins.
    """
    n, m = patterns.shape
    total = max(1.0, float(counts.sum()))
    pseudo = np.zeros((m, 2, 3))
    pseudo[:, 0] = (0.02, 0.06, 0.02)
    pseudo[:, 1] = (0.02, 0.02, 0.06)
    theta = pseudo / pseudo.sum(axis=2, keepdims=True)
    prior = 0.1
    post = np.zeros(n)
    for _ in range(rounds):
        log = np.log(theta)
        bad = np.log(prior) + sum(log[j, 1, patterns[:, j]] for j in range(m))
        good = np.log1p(-prior) + sum(log[j, 0, patterns[:, j]] for j in range(m))
        new = 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))
        for j in range(m):
            for v in range(3):
                own = patterns[:, j] == v
                theta[j, 1, v] = (counts * new)[own].sum() / total + pseudo[j, 1, v] * 0.05
                theta[j, 0, v] = (counts * (1 - new))[own].sum() / total + pseudo[j, 0, v] * 0.05
        theta /= theta.sum(axis=2, keepdims=True)
        prior = float(np.clip((counts * new).sum() / total, 1e-4, 0.9))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return new if n else post, theta, prior


class Scorer:
    """Sparse weights over hashed features; proximal gradient steps with per-weight rates (FTRL)."""

    def __init__(self, weights: np.ndarray, lexicon: Lexicon):
        self.weights, self.lexicon = weights, lexicon

    @classmethod
    def trained(cls, rows: list[np.ndarray], target: np.ndarray, lexicon: Lexicon, epochs: int = 10, rate: float = 0.3, l1: float = 4.0, l2: float = 0.5) -> Scorer:
        z, sq = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
        w = np.zeros(1 << HASH_BITS)
        order = np.random.default_rng(7)
        weight = np.where(target > 0.5, max(1.0, 0.25 * len(target) / max(1.0, target.sum())), 1.0)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                f = rows[i]
                own = np.where(np.abs(z[f]) <= l1, 0.0, -(z[f] - np.sign(z[f]) * l1) / ((1.0 + np.sqrt(sq[f])) / rate + l2))
                g = weight[i] * (1 / (1 + np.exp(-np.clip(own.sum(), -30, 30))) - target[i])
                step = (np.sqrt(sq[f] + g * g) - np.sqrt(sq[f])) / rate
                z[f] += g - step * own
                sq[f] += g * g
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(sq)) / rate + l2))
        return cls(w, lexicon)

    def probability(self, text: bytes) -> float:
        features = hashed(text, self.lexicon)
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum(), -30, 30))))


def lexicon(docs: DataFrame, labels: DataFrame, sample: int = LEXICON_SAMPLE) -> Lexicon:
    """Words and stems that toxic documents of a bounded labelled sample have and clean ones lack, for each half of it.

    A document with several labels is toxic if one says so. Rows of one id are that document, repeated.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = written(some.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("half")), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(0).to_pylist()]
            names = [[*(b"w" + x for x in w), *(b"s" + x for x in stems(w))] for w in words]
            both = [pa.array([x for r, x in zip(names, b.column(k).to_pylist(), strict=True) for _ in r], pa.int32()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([x for r in names for x in r], pa.binary()), *both], names=["name", "toxic", "half"])

    # At most ``sample`` rows of three numbers: a proven bound.
    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic", "half")
    seen = texts.mapInArrow(run, "name binary, toxic int, half int").groupBy("name", "half").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    # An entry is in 2 % of the toxic documents of its half or more: at most fifty times a document's words.
    sizes = {r.half: r["count"] for r in ids.filter("toxic = 1").groupBy("half").count().collect()}
    least = F.when(F.col("half") == 0, max(5, sizes.get(0, 0) // 50)).otherwise(max(5, sizes.get(1, 0) // 50))
    found = [(bytes(r.name), r.half) for r in seen.filter((F.col("bad") >= least) & (F.col("bad") >= 0.95 * F.col("n"))).collect()]
    pick = lambda kind: tuple(frozenset(x[1:] for x, h in found if h == half and x[:1] == kind) for half in (0, 1))
    return Lexicon(pick(b"w"), pick(b"s"))


def votes(docs: DataFrame, words: Lexicon) -> DataFrame:
    """(doc_id, junk, toxic): each document's votes, three values a labeller, as one number for each fact."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            junk, toxic = [], []
            for t in b.column(1).to_pylist():
                own = words_of(t)
                junk.append(sum(x * 3**k for k, x in enumerate(junk_votes(style(t)))))
                toxic.append(sum(x * 3**k for k, x in enumerate(words.votes(own, stems(own)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(junk, pa.int32()), pa.array(toxic, pa.int32())], names=["doc_id", "junk", "toxic"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, junk int, toxic int")


def posteriors(cast: DataFrame, fact: str, labellers: int) -> dict[int, float]:
    """Of each pattern of votes on ``fact``: at most 3 ** labellers rows reach the driver."""
    rows = sorted((r[fact], r["count"]) for r in cast.groupBy(fact).count().collect())
    if not rows:
        return {}
    patterns = np.array([[p // 3**k % 3 for k in range(labellers)] for p, _ in rows])
    post, _, _ = em(patterns, np.array([n for _, n in rows], float))
    return {p: float(x) for (p, _), x in zip(rows, post, strict=True)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """The scorer; without any document it calls nothing bad."""
    words = lexicon(docs, labels)
    cast = written(votes(docs, words), "votes")
    junk, toxic = posteriors(cast, "junk", len(JUNK)), posteriors(cast, "toxic", len(TOXIC))
    some = cast.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "junk", "toxic").limit(sample)
    some = some.groupBy("doc_id").agg(F.min(F.struct("junk", "toxic")).alias("v")).select("doc_id", "v.*")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [hashed(t, words) for t in texts]
            crc = pa.array([zlib.crc32(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), crc, pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "junk", "toxic", "crc", "features"])

    # At most ``sample`` rows of three numbers: a proven bound.
    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "junk", "toxic")
    # Columns of numbers, not rows of Python objects: the driver holds a few bytes a feature.
    got = texts.mapInArrow(run, f"doc_id {kind}, junk int, toxic int, crc bigint, features array<int>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("crc", "ascending")]).combine_chunks()
    target = np.array([1 - (1 - junk[j]) * (1 - toxic[x]) for j, x in zip(got["junk"].to_pylist(), got["toxic"].to_pylist(), strict=True)])
    each = pa.compute.list_value_length(got["features"]).to_numpy()
    flat = pa.compute.list_flatten(got["features"]).to_numpy()
    return Scorer.trained(np.split(flat, np.cumsum(each)[:-1]) if len(each) else [], target, words)


def scored(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, only_kept: bool = False, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, with p_bad: the probability that the text is junk or toxic.

    With ``only_kept`` the rows below the threshold, without the probability. Null and empty texts have the
    features of an empty text. Rows stand for themselves; an empty table gives an empty result; a column p_bad
    of ``docs`` has to be renamed first, unless ``only_kept``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(scorer))
    at = docs.columns.index(text_col)

    def probabilities(b: pa.RecordBatch, own: Scorer) -> list[float]:
        texts = b.column(at).cast(pa.binary()) if b.num_rows else []
        return [own.probability(t) for t in (x.as_py() or b"" for x in texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for b in batches:
            p = np.array(probabilities(b, own), float)
            if only_kept:
                yield b.filter(pa.array(p < threshold))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "p_bad"])

    return docs.mapInArrow(run, docs.schema if only_kept else T.StructType([*docs.schema.fields, T.StructField("p_bad", T.DoubleType())]))


def op8_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_bad, score, kept) of every document."""
    docs = documents(spark, sf_dir)
    scorer = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), scorer)
    return out.select("doc_id", "p_bad", (1 - F.col("p_bad")).alias("score"), (F.col("p_bad") < THRESHOLD).alias("kept"))
