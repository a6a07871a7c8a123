"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start on a shard by hash; in each round every
document asks to move to the shard that holds most of its group, if that is more than its own shard holds
and the shard has room; the room of each shard, a quota of rows, is given out by group in hash order.
Rounds are joins and aggregations over written tables. Unlinked documents cut no link wherever they lie,
so they fill up the shards afterwards: counts differ by one at most (the law ``rows``).

A group larger than a shard fills one shard after the other. No window holds more than a hash bin of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.llm.common import documents, written

SHARDS = 8
ROUNDS = 8
BINS = 1024


def _ranked(rows: DataFrame, part: str, id_col: str, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within each ``part`` (a shard), in hash order of the id.

    Bins of the hash are counted; at most SHARDS * BINS counts are added up and broadcast.
    """
    h = F.xxhash64(F.col(id_col))
    binned = rows.withColumn("__h", h).withColumn("__bin", F.pmod(F.shiftright("__h", 20), F.lit(BINS)).cast("int"))
    counts = binned.groupBy(part, "__bin").count()
    before = F.sum("count").over(W.partitionBy(part).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(part, "__bin", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy(part, "__bin").orderBy("__h", id_col)) - 1
    return binned.join(F.broadcast(offsets), [part, "__bin"]).withColumn(name, (F.col("__before") + within).cast("bigint")).drop("__h", "__bin", "__before")


def _best(shard: Column, room: list[int]) -> Column:
    """The shard with room that holds most of the group, if it holds more than ``shard`` (ties: the lower)."""
    own = F.element_at(F.array(*(F.col(f"c{s}") for s in range(SHARDS))), shard + 1)
    choices = [F.when((F.lit(s) != shard) & ((F.col(f"c{s}") > own) | ((F.col(f"c{s}") == own) & (F.lit(s) < shard))), F.struct(F.col(f"c{s}").alias("c"), F.lit(-s).alias("s"))) for s in range(SHARDS) if room[s] > 0]
    if not choices:
        return F.lit(None).cast("int")
    return -(F.greatest(*choices) if len(choices) > 1 else choices[0])["s"]


def propagated(linked: DataFrame, caps: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, g, shard) of linked documents (doc_id, g): label propagation under the quotas ``caps``.

    What the driver sees in a round: a count for each shard and a request for each shard and hash bin.
    """
    state = written(linked.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).cast("int")), "state")
    for _ in range(rounds):
        held = {r.shard: r["count"] for r in state.groupBy("shard").count().collect()}
        room = [max(0, caps[s] - held.get(s, 0)) for s in range(SHARDS)]
        groups = state.groupBy("g").agg(*(F.sum(F.when(F.col("shard") == s, 1).otherwise(0)).alias(f"c{s}") for s in range(SHARDS)))
        wish = written(state.join(groups, "g").withColumn("to", _best(F.col("shard"), room)).select("doc_id", "g", "shard", "to", F.pmod(F.xxhash64("g", F.lit(2)), F.lit(BINS)).cast("int").alias("bin")), "wish")
        asked = wish.filter("to IS NOT NULL").groupBy("to", "bin").count().collect()
        if not asked:
            break
        # A shard takes whole bins while they fit, and of the first that doesn't a share of the documents.
        whole, share = {}, {}
        for s in range(SHARDS):
            left = room[s]
            for r in sorted((r for r in asked if r.to == s), key=lambda r: r.bin):
                whole[s] = r.bin
                if r["count"] > left:
                    share[s] = left / r["count"]
                    break
                left -= r["count"]
            else:
                whole[s] = BINS
        to = F.col("to")
        limit = F.element_at(F.array(*(F.lit(whole.get(s, BINS)) for s in range(SHARDS))), to + 1)
        part = F.element_at(F.array(*(F.lit(float(share.get(s, 0.0))) for s in range(SHARDS))), to + 1)
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < part * float(1 << 20)
        moves = to.isNotNull() & ((F.col("bin") < limit) | ((F.col("bin") == limit) & drawn))
        state = written(wish.select("doc_id", "g", F.when(moves, to).otherwise(F.col("shard")).alias("shard")), "state")
    return state


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    size is the text's UTF-8 bytes plus 1 (null: 1); null and empty texts are equal. Shards hold equal
    numbers of rows, but for one; slots count from 0 in each shard. Rows with equal ids are placed each;
    an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("bigint")
    group = F.xxhash64(F.sha2(text, 256))
    base = written(docs.select(F.col(id_col).alias("doc_id"), (size + 1).alias("size"), F.crc32(text).alias("text_crc32"), group.alias("g")), "base")
    n = base.count()
    caps = [n // SHARDS + (s < n % SHARDS) for s in range(SHARDS)]
    many = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    linked = base.join(many, "g", "left_semi")
    state = propagated(linked.select("doc_id", "g"), caps)
    placed = _with_state(linked, state)
    placed = written(_ranked(placed, "shard", "doc_id", "slot"), "placed")
    cap = F.element_at(F.array(*(F.lit(c) for c in caps)), F.col("shard") + 1)
    stay = placed.filter(F.col("slot") < cap)
    over = placed.filter(F.col("slot") >= cap).select("doc_id", "size", "text_crc32")
    held = {r.shard: r["count"] for r in stay.groupBy("shard").count().collect()}
    alone = base.join(many, "g", "left_anti").select("doc_id", "size", "text_crc32").unionByName(over).withColumn("part", F.lit(0))
    pool = _ranked(alone, "part", "doc_id", "p")
    bounds, at = [], 0
    shard, slot = F.lit(SHARDS - 1), F.lit(0).cast("bigint")
    for s in range(SHARDS):
        bounds.append((at, at := at + caps[s] - held.get(s, 0), held.get(s, 0)))
    for s, (low, high, first) in reversed(list(enumerate(bounds))):
        here = F.col("p") < high
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("p") - low + first).otherwise(slot)
    filled = pool.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.cast("bigint").alias("slot"))
    out = stay.select("doc_id", "size", "text_crc32", "shard", "slot").unionByName(filled)
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def _with_state(linked: DataFrame, state: DataFrame) -> DataFrame:
    """``linked`` with its shard. Rows alike in id and group are interchangeable and numbered on both sides."""
    same = W.partitionBy("doc_id", "g").orderBy(F.lit(0))
    a = linked.withColumn("__k", F.row_number().over(same))
    b = state.withColumn("__k", F.row_number().over(same)).select(F.col("doc_id").alias("__id"), F.col("g").alias("__g"), F.col("__k").alias("__n"), "shard")
    match = a["doc_id"].eqNullSafe(b["__id"]) & (a["g"] == b["__g"]) & (a["__k"] == b["__n"])
    return a.join(b, match).select("doc_id", "size", "text_crc32", "shard")


def cut_links(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: the links (a group's documents to its first) that end on another shard, and all links."""
    groups = docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("g")).join(assigned.select("doc_id", "shard"), "doc_id").groupBy("g", "shard").count()
    each = groups.groupBy("g").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    return each.agg(F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"))


def op7_balanced_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
