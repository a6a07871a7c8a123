"""SimHash near-duplicates found by anchor-point covering.

The 64 bits of a fingerprint are cut into blocks: three of 21, 21 and 22 bits for thresholds up to five,
four of 16 for six and seven. Two fingerprints within the threshold differ in at most one bit of some
block. In each block the anchors are the words of a covering code: the Hamming code on 15 of its bits, all
words on the rest; its covering radius is 1. So a fingerprint has one *home* anchor within the radius, and is replicated to every anchor within
radius + threshold = 1 + 1 = 2. If y differs from x in one bit of the block, then y's replicas include
x's home. Each home is compared with the replicas at its anchor only, and nothing is missed.

Equal fingerprints are folded first, so a group of copies of any size costs one row. Links found at an
anchor leave it as a spanning forest, never as all pairs of a group. Components come from alternating
star contractions, each iteration a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.bloom import possibly_repeated
from linkloom.llm.common import deleted, documents, small, text_bytes, written

SEED = 42
#: First bit and width of each block, by the largest threshold for which one block has at most one differing bit.
BLOCKS = {5: ((0, 21), (21, 21), (42, 22)), 7: ((0, 16), (16, 16), (32, 16), (48, 16))}
#: Bits in which two fingerprints of 64 bits each may differ in all, where a second one confirms the first:
#: the angle of 20 of 128 bits is that of two shingle sets with a Jaccard similarity of 0.8.
CONFIRMED_BITS = 20
#: Bits in which fingerprints of near copies that the anchor cover finds may differ: the most that the three wide blocks hold.
NEAR_BITS = 5
#: Jaccard similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Pairs whose two fingerprints differ in more of the 128 bits are dropped uncounted: at a similarity of 0.8
#: the mean is 19 to 24, and this lies over five standard deviations above it.
FAR_BITS = 48
#: Texts in the sample that says which shingles are common, in how many one must be, and how many are held.
SAMPLE, COMMON_FROM, MOST_COMMON = 4000, 8, 100_000
#: Bits of a block under the Hamming code; the rest are free.
CODED = 15
#: An anchor with more homes than this is compared in several tasks.
HOMES_PER_TASK = 4096
#: Pairs compared in one numpy call.
PAIRS_AT_ONCE = 2_000_000


def fingerprints(text: bytes, shingle: int = 4, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """SimHash of the whole text for each seed: a bit is 1 if it is set in over half the shingles' XXH64.

    ASCII letters are lower-cased; words are runs of non-blank bytes; a text of fewer words than a
    shingle has one shingle, the whole sequence; a text without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return [0] * len(seeds)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(line, seed) for seed in seeds]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    out = []
    for seed in seeds:
        h = np.array([digest(line[i:j], seed) for i, j in zip(starts, stops, strict=True)], "<u8")
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0]))
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(id, fp[, second]): one row for each row of ``docs``; a column for each seed, as signed longs."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["fp", "second"][: len(seeds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprints(t, shingle, seeds) for t in b.column(1).to_pylist()], np.uint64).reshape(-1, len(seeds)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fp[:, k]) for k in range(len(seeds)))], names=[id_col, *names])

    own = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in names))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code on the low 15 bits: the xor of the numbers (from 1) of the bits that are set."""
    out = np.zeros_like(x)
    for bit in range(CODED):
        out ^= np.where((x >> np.uint64(bit)) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return out


def _near(x: np.ndarray) -> np.ndarray:
    """The codeword within distance 1 of the coded bits."""
    s = _syndrome(x)
    return np.where(s > 0, x ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))), x)


def blocks_for(threshold: int) -> tuple[tuple[int, int], ...]:
    if not 0 <= threshold <= max(BLOCKS):
        raise ValueError(f"the blocks cover thresholds from 0 to {max(BLOCKS)}")
    return BLOCKS[min(t for t in BLOCKS if threshold <= t)]


def anchors(fp: np.ndarray, blocks: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor within radius + 1 in each block."""
    rows, keys, homes = [], [], []
    ids = np.arange(len(fp))
    for n, (first, width) in enumerate(blocks):
        word = (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)
        home = _near(word)
        off = home != word
        key = np.uint64(n) << np.uint64(40)
        rows.append(ids), keys.append(home | key), homes.append(np.ones(len(fp), bool))
        for bit in range(width):
            other = _near(word ^ np.uint64(1 << bit))
            # A flip of a coded bit that leads back home adds nothing; a free bit adds home with it flipped.
            new = other != home
            if bit < CODED:
                # Distance 2 is reached by two flips, either of them first: keep one of the two.
                new &= off & ((other ^ word) >> np.uint64(bit) == 1)
            rows.append(ids[new]), keys.append(other[new] | key), homes.append(np.zeros(int(new.sum()), bool))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(homes)


def _first_block(x: np.ndarray, blocks: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The first block in which the difference x has at most one bit."""
    return np.argmax([np.bitwise_count((x >> np.uint64(f)) & np.uint64((1 << w) - 1)) <= 1 for f, w in blocks], axis=0)


def _forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Merge the labels of linked nodes in place: least label, with pointer jumping, until nothing moves."""
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if (low == high).all():
            return
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _links(run: np.ndarray, block: np.ndarray, home: np.ndarray, fp: np.ndarray, second: np.ndarray, most: int, blocks) -> np.ndarray:
    """For each row the row of its root: spanning forests of the links within runs of equal ``run``."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    stops = np.r_[starts[1:], len(run)]
    group = np.repeat(np.arange(len(starts)), stops - starts)
    label = np.arange(len(run))
    h = np.flatnonzero(home)
    count = (stops - starts)[group[h]]
    total = np.cumsum(count)
    done = 0
    while done < len(h):
        before = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, before + PAIRS_AT_ONCE)))
        own, c = h[done:upto], count[done:upto]
        a = np.repeat(own, c)
        b = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(starts[group[own]], c)
        x = fp[a] ^ fp[b]
        d = np.bitwise_count(x)
        ok = np.flatnonzero((d <= most) & (a != b))
        a, b, x, d = a[ok], b[ok], x[ok], d[ok]
        # Blocks are asked in order, so that a pair counts once, where it first can.
        ok = _first_block(x, blocks) == block[a]
        ok &= (second[a] == second[b]) | (d + np.bitwise_count(second[a] ^ second[b]) <= CONFIRMED_BITS)
        _forest(len(run), a[ok], b[ok], label)
        done = upto
    return label


def near_edges(nodes: DataFrame, threshold: int = 4) -> DataFrame:
    """Links (a, b) between rows of ``nodes`` (node, fp, second): enough of them to join all that link, by the anchor cover.

    Two nodes link if their fps differ in at most ``threshold`` bits (7 at most), and, where their
    ``second`` fingerprints differ, both pairs together in at most CONFIRMED_BITS. An anchor with many
    homes is dealt to several tasks: each gets a share of the homes and all replicas.
    """
    blocks = blocks_for(threshold)
    names = ["key", "node", "fp", "second", "home"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, second = (np.ascontiguousarray(c.to_numpy()) for c in b.columns)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                row, key, home = anchors(part.view(np.uint64), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node[at : at + 20_000][row], part[row], second[at : at + 20_000][row], home)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            key, part, node, home = (t.column(c).to_numpy() for c in ("key", "part", "node", "home"))
            fp, second = (np.ascontiguousarray(t.column(c).to_numpy()).view(np.uint64) for c in ("fp", "second"))
            run = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            root = _links(run, key >> 40, home, fp, second, threshold, blocks)
            found = np.flatnonzero(root != np.arange(len(root)))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(node[root[found]])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= 200_000:
                # What may go on in the next batch waits: the rows of the last (key, part).
                key, part = b.column("key").to_numpy(), b.column("part").to_numpy()
                other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
                if len(other):
                    cut = int(other[-1]) + 1
                    yield from out([*held[:-1], b.slice(0, cut)])
                    held, rows = [b.slice(cut)], b.num_rows - cut
        if held:
            yield from out(held)

    placed = nodes.select("node", "fp", "second").mapInArrow(spread, "key bigint, node bigint, fp bigint, second bigint, home boolean")
    homes = placed.filter("home").groupBy("key").count()
    hot = homes.filter(F.col("count") > HOMES_PER_TASK).select("key", F.ceil(F.col("count") / HOMES_PER_TASK).cast("int").alias("parts"))
    dealt = (
        placed.join(hot, "key", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        # A home is a home in one part, and a plain replica in the others.
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "part", "node", "fp", "second", (F.col("home") & (F.col("own") == F.col("part"))).alias("home"))
    )
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) can reach; roots are left out.

    Large-star and small-star steps in turn; the edges of each round are a written table, deleted after the
    next one. The driver sees one count and one sum a round, never a link.
    """
    spark, old, before = edges.sparkSession, [], None
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", old)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_star = large.groupBy("a").agg(F.min("b").alias("m"))
        now_open: list[str] = []
        edges = written(large.join(small_star, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(small_star.select("a", F.col("m").alias("b"))).distinct(), "edges", now_open)
        deleted(spark, old)
        old = now_open
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now == before and now[0] == now[2]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def joined(fps: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str, on: list[str]) -> DataFrame:
    """``fps`` with component_id: the least id of all rows whose nodes are connected.

    Only nodes with links meet by root, after pre-aggregation; each component is one row of what is looked up.
    """
    roots = components(edges)
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = written(nodes.select("node", "least").join(every, "node"), "linked")
    own = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "own")
    found = linked.join(small(own), "root").select("node", "component_id")
    of = nodes.join(found, "node", "left").select(*on, F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(of, on)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id that can be reached over links, itself included. A null id never
    becomes a component's id unless all its ids are null (then the component's id is null). Rows with
    equal ids are kept each; an empty table gives an empty result; other columns are not read.
    """
    fps = written(with_fingerprint(docs, id_col, text_col, shingle), "fp")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("least")).select(F.col("fp").alias("node"), "fp", F.lit(0).cast("bigint").alias("second"), "least")
    found = joined(fps, nodes, near_edges(nodes, threshold), id_col, ["fp"])
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64s of the text's word shingles, sorted; words and short texts as in fingerprints()."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a worker holds the shingles of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash."""
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def _majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed long."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        total += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def _node(h: np.ndarray) -> int:
    """A signed long for a set of shingles."""
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _common_shingles(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, sorted; no result depends on which they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t, shingle).view(np.int64))], names=["key"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).select(text_bytes(text_col).alias("text"))
    often = some.mapInArrow(run, "key bigint").groupBy("key").count().filter(F.col("count") >= COMMON_FROM)
    rows = often.orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def _sketched(docs: DataFrame, id_col: str, text_col: str, shingle: int, common: np.ndarray) -> DataFrame:
    """(id, own, node, n, fp, second, prefix): hash of the text, its set of n shingles, two fingerprints, rarest shingles.

    Shingles are ordered by hash, the ``common`` ones last. Two sets with a similarity of LEAST or more
    share one of the first n - ceil(LEAST * n) + 1 of both, in whatever order all sets are put.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t, shingle)
                n = len(h)
                late = np.isin(h, common, assume_unique=True)
                rare = np.concatenate([h[~late], h[late]])[: n + LEAST[0] * n // -LEAST[1] + 1]
                out.append((_node(h), n, _majority(h), _majority(_mixed(h)), rare.view(np.int64)))
            node, n, fp, second, prefix = zip(*out, strict=True) if out else ((),) * 5
            cols = [pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(second, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=[id_col, "own", "node", "n", "fp", "second", "prefix"])

    own = docs.select(F.col(id_col), F.xxhash64(text_col).alias("own"), text_bytes(text_col).alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, own bigint, node bigint, n int, fp bigint, second bigint, prefix array<bigint>")


def _similar(pairs: DataFrame, docs: DataFrame, fps: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """The ``pairs`` (a, b, a written table) of nodes whose shingle sets are similar enough, by counting."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = written(fps.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("own").alias("__own")).select("__own"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [shingle_hashes(t, shingle) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["node", "set"])

    found = docs.select(F.xxhash64(text_col).alias("__own"), text_bytes(text_col).alias("__text")).join(small(texts), "__own", "left_semi")
    sets = written(found.select("__text").mapInArrow(run, "node bigint, set array<bigint>").dropDuplicates(["node"]), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.select("a", "b", F.size(F.array_intersect("a_set", "b_set")).alias("same"), (F.size("a_set") + F.size("b_set")).alias("all"))
    return written(met.filter(F.col("same") * LEAST[1] >= (F.col("all") - F.col("same")) * LEAST[0]).select("a", "b"), "similar")


def _can_meet(a: str, b: str) -> Column:
    """Whether two sets that share a shingle, at places ``a.pos`` and ``b.pos`` of their orders, can be similar enough.

    Let it be the first one that they share: then no more than the rest of either is shared. Jaccard j of
    sizes m and n asks for j / (1 + j) * (m + n) shared shingles, and for lengths within j of each other. The two
    fingerprints may differ in FAR_BITS.
    """
    of = lambda x, c: F.col(f"{x}.{c}")
    rest = F.least(of(a, "n") - of(a, "pos"), of(b, "n") - of(b, "pos"))
    bits = F.bit_count(of(a, "fp").bitwiseXOR(of(b, "fp"))) + F.bit_count(of(a, "second").bitwiseXOR(of(b, "second")))
    lengths = F.least(of(a, "n"), of(b, "n")) * LEAST[1] >= F.greatest(of(a, "n"), of(b, "n")) * LEAST[0]
    return lengths & (rest * sum(LEAST) >= (of(a, "n") + of(b, "n")) * LEAST[0]) & (bits <= FAR_BITS)


def similar_edges(docs: DataFrame, fps: DataFrame, nodes: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Links (a, b) between ``nodes``: enough of them to join all whose similarity is LEAST or more.

    Candidates come from the anchor cover of the fingerprints, NEAR_BITS wide; the shingle sets decide on them.
    Similar sets may have fingerprints further apart. The exact way for those: nodes on different roots that
    share a shingle of their prefixes, at places that leave enough to share, are candidates too.
    First each is held against one node a shingle, the one that has it earliest: that one has the fewest
    rare shingles, so it lies in the middle of its group, and the links to it join most of the group at a linear
    cost. Then all candidates that are not joined yet are held against each other, so that nothing is missed.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    alike = nodes.groupBy("fp").agg(F.min("node").alias("one"))
    same = nodes.join(alike, "fp").filter("node <> one").select(*pair("node", "one"))
    homes = alike.select(F.col("one").alias("node"), "fp", F.lit(0).cast("bigint").alias("second"))
    cover = written(near_edges(written(homes, "homes"), NEAR_BITS).select(*pair("a", "b")).unionByName(same).distinct(), "cover")
    covered = _similar(cover, docs, fps, text_col, shingle)
    of = written(components(covered), "of")
    # Most shingles are in one text only: the exact stage's filter leaves those out before anything is shuffled.
    every = fps.select("node", "n", "fp", "second", F.posexplode("prefix").alias("pos", "h"))
    posts = possibly_repeated(every).filter("maybe").drop("maybe").withColumnRenamed("h", "key")
    shared = posts.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    posts = posts.join(shared, "key", "left_semi").distinct()
    posts = posts.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    posts = written(posts.select("key", F.struct("node", "n", "pos", "fp", "second").alias("x"), "root"), "posts")
    lead = posts.groupBy(F.col("key").alias("lkey")).agg(F.min_by(F.struct("x", "root"), F.struct("x.pos", F.xxhash64("x.node"))).alias("y"))
    lead = lead.select("lkey", F.col("y.x").alias("y"), F.col("y.root").alias("lroot"))
    stars = posts.join(lead, (F.col("key") == F.col("lkey")) & (F.col("root") != F.col("lroot")) & _can_meet("x", "y"))
    stars = written(stars.select(*pair("x.node", "y.node")).distinct().join(cover, ["a", "b"], "left_anti"), "stars")
    first = covered.unionByName(_similar(stars, docs, fps, text_col, shingle))
    roots = components(first).select(F.col("node").alias("of"), "root")
    tagged = posts.drop("root").join(roots, F.col("x.node") == F.col("of"), "left").select("key", "x", F.coalesce("root", "x.node").alias("root"))
    tagged = written(tagged, "tagged")
    # Of two nodes on different roots one at least is outside the shingle's largest root.
    sizes = tagged.groupBy("key", "root").count().groupBy("key")
    largest = sizes.agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("key", "most")
    minor = tagged.join(largest, "key").filter("root <> most").select(F.col("key").alias("mkey"), F.col("x").alias("y"), F.col("root").alias("mroot"))
    # Both may be outside it: then the pair is met twice, and once is enough.
    rest = tagged.join(minor, (F.col("key") == F.col("mkey")) & (F.col("root") != F.col("mroot")) & _can_meet("x", "y"))
    rest = written(rest.select(*pair("x.node", "y.node")).distinct().join(stars.unionByName(cover), ["a", "b"], "left_anti"), "rest")
    return first.unionByName(_similar(rest, docs, fps, text_col, shingle))


def near_copies_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; all columns stay as they are.

    Two texts are near copies if the sets of their ``shingle``-word shingles have a Jaccard similarity of
    LEAST or more; they are found by the anchor cover of their SimHashes, and exactly where those lie too far apart. Rows with equal ids stay or go together; rows with a null id stay. Null texts and texts without
    words are near copies of each other; a text shorter than a shingle is one shingle. An empty table gives an
    empty result; other columns are passed through, whatever their names.
    """
    common = _common_shingles(docs, text_col, shingle)
    fps = written(_sketched(docs, id_col, text_col, shingle, common), "fp")
    nodes = written(fps.groupBy("node", "n", "fp", "second").agg(F.min(id_col).alias("least")), "nodes")
    edges = similar_edges(docs, fps, nodes, text_col, shingle)
    found = joined(fps.select(F.col(id_col).alias("id"), "node"), nodes, edges, "id", ["node"])
    gone = written(found.filter(F.col("id") > F.col("component_id")).select("id").distinct(), "gone")
    return docs.join(small(gone), docs[id_col] == gone["id"], "left_anti")
