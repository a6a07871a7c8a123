"""Removal of repeated 100-byte strings: suffix buckets with difference-cover ranks.

A window is a string of SPAN bytes. Each window of a text belongs to its *seed*: of the SEED-byte strings
in it, the one with the least hash, the leftmost of equals. Neighbouring windows with one seed form a run.
Equal windows have equal seeds at equal places, so windows can be compared within the bucket of a seed.

1. Runs are hashed as a whole. Of equal runs only the first can hold a window's first place; the windows
   of the others are repeated. A run whose seed no other kind of run has, is settled as well.
2. Of the other runs, the contested ones, the bytes are sent to their seed's bucket. The suffixes of a
   bucket, which begin at the windows, are sorted by PERIOD bytes, and long ties by the precomputed rank
   of the next position that a difference cover samples. A task holds a few buckets at a time, so memory
   doesn't grow with the text. Neighbours in that order that share SPAN bytes are one window's places.
3. Buckets of more than HOT runs (a line that much of the corpus has) are split up: their windows are dealt
   by their own hash, each to a bucket that holds nothing else.

What the windows of each document cover goes back to the document by one join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.llm.common import documents, text_bytes, written

SPAN = 100
SEED = 40
#: Seeds that begin in a window: SEED + WIDTH - 1 = SPAN.
WIDTH = 61
#: Bytes of a text that are hashed at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Period of the difference cover, and bytes by which suffixes are sorted first.
PERIOD = 32
#: Runs of a bucket that is sorted in one task.
HOT = 8192
#: Runs that a task sorts at once, where buckets allow.
AT_ONCE = 12_000
BASE = 0x9E3779B97F4A7C15
LAST_ID = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Polynomial hashes modulo 2^64 of substrings, from prefix sums of random byte values."""

    def __init__(self, size: int = PIECE + SPAN):
        self.value = np.random.default_rng(17).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self._powers(BASE, size)
        self.inverse = self._powers(pow(BASE, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        x = np.full(size, np.uint64(base))
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[begin]) * self.inverse[begin]

    def every(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Of all substrings of one size."""
        return (prefix[size:] - prefix[:-size]) * self.inverse[: len(prefix) - size]


def runs(data: bytes, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(first window, windows, seed's place after the first window, seed's hash, run's hash) of each run."""
    parts = []
    for at in range(0, max(1, len(data) - SPAN + 1), PIECE):
        piece = np.frombuffer(data, np.uint8)[at : at + PIECE + SPAN - 1]
        if len(piece) < SPAN:
            continue
        prefix = hasher.prefix(piece)
        h = mixed(hasher.every(prefix, SEED))
        low = np.uint64((1 << 24) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= WIDTH:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(m) - (WIDTH - width)], m[WIDTH - width :])
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        count = np.diff(np.r_[first, len(m)])
        seed = (m[first] & low).astype(np.int64)
        own = hasher.spans(prefix, first, first + count - 1 + SPAN)
        own = mixed(own ^ mixed(((seed - first) * 128 + count).astype(np.uint64)))
        parts.append((first + at, count, seed - first, h[seed], own))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _first_of(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for the row with the least (doc, at) of each key."""
    order = np.lexsort((at, doc, key))
    k, d, a = key[order], doc[order], at[order]
    new = np.r_[True, k[1:] != k[:-1]]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(key), bool)
    out[order] = (d == d[lead]) & (a == a[lead])
    return out


def difference_cover(period: int) -> np.ndarray:
    """Residues of which some two differ by any given number, modulo the period: a fine and a coarse ruler."""
    step = int(np.ceil(np.sqrt(period)))
    return np.unique([*range(step), *range(step, period, step)])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows by several keys, the first one leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as a number; zeros follow the end."""
    out = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        out[:-k] = (out[:-k] << np.uint64(8 * k)) | out[k:]
    return out[: len(data)]


def cover_ranks(words: np.ndarray, size: int) -> np.ndarray:
    """Ranks, by at least SPAN bytes, of the positions that the difference cover samples; -1 elsewhere.

    A position a period later is sampled too, so ranks double their length over strides of the period.
    """
    sampled = np.isin(np.arange(size) % PERIOD, difference_cover(PERIOD))
    at = np.flatnonzero(sampled)
    rank = np.full(size + 4 * PERIOD, -1, np.int64)
    look = np.concatenate([words, np.zeros(PERIOD, np.uint64)])
    rank[at] = _dense(*(look[at + k] for k in range(0, PERIOD, 8)))
    reach = PERIOD
    while reach < SPAN:
        rank[at] = _dense(rank[at], rank[np.minimum(at + reach, len(rank) - 1)])
        reach *= 2
    return rank


def sorted_suffixes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The order of the suffixes that begin at ``at``: by bucket, residue, bytes (SPAN or more).

    Suffixes of one residue have their next sampled position equally far, so its rank settles ties.
    """
    words = _words(data)
    rank = cover_ranks(words, len(data))
    residues = np.arange(PERIOD)
    cover = difference_cover(PERIOD)
    ahead = np.array([min((c - r) % PERIOD for c in cover) for r in residues])
    look = np.concatenate([words, np.zeros(PERIOD, np.uint64)])
    residue = at % PERIOD
    tie = rank[at + ahead[residue]]
    first = bucket * PERIOD + residue
    return np.lexsort((tie, look[at + 24], look[at + 16], look[at + 8], look[at], first))


def repeated_windows(bucket: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(run, window) of the windows that begin earlier elsewhere, among the runs of some whole buckets."""
    if not len(count):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Each text is laid out with its seed at a multiple of the period: equal windows have equal residues.
    size = np.array([len(t) for t in texts])
    lead = (-place) % PERIOD
    slot = -(-(lead + size) // PERIOD) * PERIOD
    begin = np.cumsum(slot) - slot + lead
    data = np.zeros(int(slot.sum()) + 2 * SPAN, np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
    run = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[run] + window
    order = sorted_suffixes(data, at, bucket[run])
    # Windows of one seed and different distances to it can't be equal: the key holds the distance.
    key = bucket[run] * 64 + (place[run] - window)
    a, b = at[order[:-1]], at[order[1:]]
    same = key[order[:-1]] == key[order[1:]]
    for part in range(0, len(a), 100_000):
        near = np.flatnonzero(same[part : part + 100_000]) + part
        for k in range(0, SPAN, 20):
            cols = np.arange(k, k + 20)
            near = near[(data[a[near, None] + cols] == data[b[near, None] + cols]).all(axis=1)]
        own = np.zeros(len(same[part : part + 100_000]), bool)
        own[near - part] = True
        same[part : part + 100_000] = own
    group = np.empty(len(run), np.int64)
    group[order] = np.cumsum(np.r_[True, ~same]) if len(run) else 0
    late = ~_first_of(group, doc[run], first[run] + window)
    return run[late], window[late]


def _stretches(run: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, windows) of each stretch of neighbouring windows; the input is in that order."""
    new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)]) if len(run) else np.zeros(0, int)
    return run[new], window[new], np.diff(np.r_[new, len(run)])


def seeded(texts: DataFrame) -> DataFrame:
    """(seed, own, doc, first, windows, known) of each run of ``texts`` (doc, text).

    Of equal runs in one batch all but the first are known to be repeated; they need to meet no other run
    and are spread by a key of their own, so that a seed has a row a batch and kind of run at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def out(held: list[tuple[int, tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
            first, count, _, seed, own = (np.concatenate(x) for x in zip(*(r for _, r in held), strict=True))
            doc = np.repeat(np.array([d for d, _ in held], np.int64), [len(r[0]) for _, r in held])
            known = ~_first_of(mixed(seed) ^ own, doc, first)
            spread = mixed(doc.view(np.uint64) * np.uint64(BASE) + first.astype(np.uint64))
            seed = np.where(known, spread, seed)
            return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(own.view(np.int64)), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int8)), pa.array(known)], names=["seed", "own", "doc", "first", "windows", "known"])

        for b in batches:
            held, rows = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                r = runs(text.as_py(), hasher)
                if len(r[0]):
                    held.append((doc, r))
                    rows += len(r[0])
                if rows > 500_000:
                    yield out(held)
                    held, rows = [], 0
            if held:
                yield out(held)

    return texts.mapInArrow(run, "seed bigint, own bigint, doc bigint, first int, windows tinyint, known boolean")


def contested(seeds: DataFrame) -> DataFrame:
    """(doc, first, windows, seed, kind): runs that are repeated (0), contested (1) or in a hot bucket (2)."""
    n = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = seeds.repartition(n, "seed").sortWithinPartitions("seed", "own")
    bucket, kind = W.partitionBy("seed"), W.partitionBy("seed", "own")
    here = F.struct("doc", "first")
    told = dealt.select("*", F.min("own").over(bucket).alias("low"), F.max("own").over(bucket).alias("high"), F.count(F.lit(1)).over(bucket).alias("n"), F.min(here).over(kind).alias("lead"))
    late = F.col("known") | (here > F.col("lead"))
    mark = F.when(late, 0).when(F.col("low") == F.col("high"), None).when(F.col("n") > HOT, 2).otherwise(1)
    return told.select("doc", "first", "windows", "seed", mark.cast("tinyint").alias("kind")).filter("kind IS NOT NULL")


def _with_runs(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``texts`` (doc, text) with the array ``runs`` of its marks. A document's runs are as many as its bytes allow."""
    of = marks.groupBy("doc").agg(F.collect_list(F.struct("first", "windows", "seed", "kind")).alias("runs"))
    return texts.join(of, "doc", how)


def _listed(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, windows, seed, kind) of each row of an array column, by first."""
    flat = column.flatten()
    fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
    ends = np.cumsum(np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(int))
    for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True):
        order = np.argsort(fields[0][i:j], kind="stable") + i
        yield tuple(x[order] for x in fields)


def sent(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(seed, doc, first, place, bytes): where the contested runs are compared.

    A run goes to its seed's bucket with its bytes. Of a hot bucket each window goes to the bucket of its
    own hash, with the seed in place of the bytes; of equal windows in a batch only the first has to be
    compared: the others, with place -1, are spread by a key of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(4 * SPAN)

        def out(seeds: list, docs: list, firsts: list, places: list, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(docs, pa.int64()), pa.array(firsts, pa.int32()), pa.array(places, pa.int16()), pa.array(data, pa.binary())], names=["seed", "doc", "first", "place", "bytes"])

        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            hot: list[tuple[np.ndarray, ...]] = []
            for doc, text, (first, count, seed, kind) in zip(b.column(0).to_pylist(), b.column(1), _listed(b.column(2)), strict=True):
                text = text.as_py()
                for f, c, s, k in zip(first.tolist(), count.tolist(), seed.tolist(), kind.tolist(), strict=True):
                    piece = text[f : f + c - 1 + SPAN]
                    if len(piece) < SPAN:
                        continue  # the run is of another row with the same id
                    prefix = hasher.prefix(np.frombuffer(piece, np.uint8))
                    if k == 2:
                        h = mixed(hasher.every(prefix, SPAN))
                        hot.append((h, np.full(len(h), s), np.full(len(h), doc), np.arange(f, f + len(h))))
                        continue
                    at = np.flatnonzero(mixed(hasher.every(prefix, SEED)).view(np.int64) == s)
                    if len(at):
                        for held, x in zip(rows, (s, doc, f, int(at[0]), piece), strict=True):
                            held.append(x)
                if len(rows[0]) >= 50_000:
                    yield out(*rows)
                    rows = ([], [], [], [], [])
            yield out(*rows)
            if hot:
                key, seed, doc, at = (np.concatenate(x) for x in zip(*hot, strict=True))
                key = mixed(key ^ mixed(seed.view(np.uint64)))
                known = ~_first_of(key, doc, at)
                key = np.where(known, mixed(doc.view(np.uint64) * np.uint64(BASE) + at.astype(np.uint64)), key)
                yield out(key.view(np.int64), doc, at, np.where(known, -1, 0), [x.tobytes() for x in seed])

    return _with_runs(texts, marks, "inner").select("doc", "text", "runs").mapInArrow(run, "seed bigint, doc bigint, first int, place smallint, bytes binary")


def settled(rows: DataFrame) -> DataFrame:
    """(doc, first, windows) of the windows that begin earlier elsewhere, among the contested runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            seed, doc, first, place = (t.column(k).to_numpy().astype(np.int64) for k in range(4))
            long = pa.compute.binary_length(t.column(4)).to_numpy() >= SPAN
            bucket = np.cumsum(np.r_[True, seed[1:] != seed[:-1]])
            # Single windows: equal where bucket and seed are.
            one = np.flatnonzero(~long)
            if len(one):
                own = np.frombuffer(b"".join(t.column(4).take(one).to_pylist()), np.uint64)
                late = one[(place[one] < 0) | ~_first_of(mixed(own) ^ mixed(seed[one].view(np.uint64)), doc[one], first[one])]
                yield pa.RecordBatch.from_arrays([pa.array(doc[late]), pa.array(first[late].astype(np.int32)), pa.array(np.ones(len(late), np.int8))], names=["doc", "first", "windows"])
            run = np.flatnonzero(long)
            texts = t.column(4).take(run).to_pylist()
            count = np.array([len(x) for x in texts], np.int64) - SPAN + 1
            r, w, n = _stretches(*repeated_windows(bucket[run], doc[run], first[run], count, place[run], texts))
            yield pa.RecordBatch.from_arrays([pa.array(doc[run][r]), pa.array((first[run][r] + w).astype(np.int32)), pa.array(n.astype(np.int8))], names=["doc", "first", "windows"])

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                part = b.slice(i, AT_ONCE)
                held.append(part)
                n += part.num_rows
                seed = part.column(0).to_numpy()
                other = np.flatnonzero(seed != seed[-1])
                if n >= AT_ONCE and len(other):
                    cut = int(other[-1]) + 1
                    yield from out([*held[:-1], part.slice(0, cut)])
                    held, n = [part.slice(cut)], part.num_rows - cut
        if n:
            yield from out(held)

    k = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(k, "seed").sortWithinPartitions("seed").mapInArrow(run, "doc bigint, first int, windows tinyint")


def covered(first: np.ndarray, count: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The bytes that windows cover, as maximal stretches; windows come by their first."""
    out: list[tuple[int, int]] = []
    for f, c in zip(first.tolist(), count.tolist(), strict=True):
        end = min(size, f + c - 1 + SPAN)
        if out and f <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        elif f < end:
            out.append((f, end))
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends[, kept]) of every row of ``docs``.

    Each byte that lies in a 100-byte string which also starts earlier (smaller id, or same id and earlier
    place) goes. Ids are whole numbers; a null id comes last. Rows of one id are that document, repeated:
    they are not earlier than each other and lose the same bytes. Null texts are empty; an empty table
    gives an empty result; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("doc"), text_bytes(text_col).alias("text"), F.col(id_col).isNull().alias("none"))
    own = texts.select("doc", "text")
    marks = written(contested(seeded(own)), "marks")
    some = written(settled(sent(own, marks.filter("kind > 0"))), "settled")
    repeated = marks.filter("kind = 0").select("doc", "first", "windows").unionByName(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, (first, count, _, _) in zip(b.column(1), _listed(b.column(3)), strict=True):
                text = text.as_py()
                gone = covered(first, count, len(text))
                stops = [0, *(j for _, j in gone)]
                kept = b"".join(text[i:j] for i, j in zip(stops, [*(i for i, _ in gone), len(text)], strict=True))
                rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [i for i, _ in gone], [j for _, j in gone], kept if keep_text else None))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc", "none", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept"])

    joined = _with_runs(texts, repeated.select("*", F.lit(0).cast("bigint").alias("seed"), F.lit(0).cast("tinyint").alias("kind")), "left").select("doc", "text", "none", "runs")
    out = joined.mapInArrow(run, "doc bigint, none boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<int>, ends array<int>, kept binary")
    key = F.when(~F.col("none"), F.col("doc")).cast(docs.schema[id_col].dataType).alias(id_col)
    return out.select(key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", *(["kept"] if keep_text else []))


def op10_cover_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removals(documents(spark, sf_dir), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
