"""Several runs made one. A run is (query_id, target_id, rank)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import similarity as S
from linkloom.sources.tables import merged


def _renumbered(rows: DataFrame, most: int | None, *order: str) -> DataFrame:
    own = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order, "target_id")))
    return (own if most is None else own.filter(F.col("rank") <= most)).select("query_id", "target_id", "rank")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b side by side: ra and rb are ranks, null where a run lacks the pair."""
    return a.select("query_id", "target_id", F.col("rank").alias("ra")).join(b.select("query_id", "target_id", F.col("rank").alias("rb")), ["query_id", "target_id"], "full")


def intersection(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    return _renumbered(both(a, b).filter("ra IS NOT NULL AND rb IS NOT NULL"), most, "ra")


def preferred(a: DataFrame, b: DataFrame, else_b: bool = False, recovered: Column | None = None, from_b: int | None = None, most: int | None = 4) -> DataFrame:
    """By query: what both have; else all of a; else, with ``else_b``, those of b that are ``recovered``, ``from_b`` at most."""
    own = both(a, b) if recovered is None else both(a, b.select("query_id", "target_id", "rank")).join(merged(b.select("query_id", "target_id", recovered.alias("ok"))), ["query_id", "target_id"], "left")
    return _preferred_of(own if recovered is not None else own.withColumn("ok", F.lit(True)), else_b, from_b, most)


def _preferred_of(own: DataFrame, else_b: bool, from_b: int | None, most: int | None) -> DataFrame:
    """preferred() of pairs side by side, with ``ok`` where those of b are recovered."""
    w = W.partitionBy("query_id")
    own = own.withColumn("level", F.max(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 3).when(F.col("ra").isNotNull(), 2).otherwise(1)).over(w))
    ok = F.coalesce("ok", F.lit(False))
    keep = ((F.col("level") == 3) & F.col("ra").isNotNull() & F.col("rb").isNotNull()) | ((F.col("level") == 2) & F.col("ra").isNotNull()) | (F.lit(else_b) & (F.col("level") == 1) & ok)
    out = own.filter(keep).withColumn("place", F.coalesce("ra", "rb")).withColumn("n", F.row_number().over(w.orderBy("place", "target_id")))
    if from_b is not None:
        out = out.filter((F.col("level") > 1) | (F.col("n") <= from_b))
    return _renumbered(out, most, "place")


def ordered_union(a: DataFrame, b: DataFrame, most: int | None = 4, extra: Column | None = None) -> DataFrame:
    """a in its order, then of b what a lacks (and ``extra`` holds for), ``most`` in all."""
    more = b if extra is None else b.filter(extra)
    own = both(a, more).withColumn("side", F.col("ra").isNull().cast("int")).withColumn("place", F.coalesce("ra", "rb"))
    return _renumbered(own, most, "side", "place")


def gated(run: DataFrame, judged: DataFrame, passes: Column) -> DataFrame:
    """The pairs of a run whose evidence passes."""
    return run.join(merged(judged.filter(passes).select("query_id", "target_id")), ["query_id", "target_id"], "left_semi")


def recovery_strict() -> Column:
    """Exact root, core from 45, or number and street from 60 with core from 30."""
    return F.col("same_comp") | (F.col("core_sort") >= 45) | (F.col("num_agree") & (F.col("street_sim") >= 60) & (F.col("core_sort") >= 30))


def recovery_wide() -> Column:
    """Exact root; India across scripts; building, street and core; core from 85."""
    c = F.col
    return c("same_comp") | (~c("t_latin") & c("india") & c("num_agree") & (c("street_sim") >= 60)) | (c("num_agree") & (c("street_sim") >= 75) & (c("core_sort") >= 55)) | ((c("core_sort") >= 85) & (c("num_agree") | (c("street_sim") >= 40) | c("t_no_addr")))


def state_and_numbers() -> Column:
    return ~F.col("state_conflict") & ~F.col("num_conflict")


def state_and_smart() -> Column:
    return ~F.col("state_conflict") & ~F.col("smart_conflict")


def clean_consensus(a: DataFrame, b: DataFrame, judged: DataFrame) -> DataFrame:
    """State and number gates on both; both, else a, else two of b."""
    a, b = (gated(x, judged, state_and_numbers()) for x in (a, b))
    return preferred(a, b, True, None, 2, 4)


def validated_marks() -> dict[str, Column]:
    """One gate with postal codes for both runs; of b what is validated is recovered."""
    return {"gate_a": state_and_smart(), "gate_b": state_and_smart(), "ok": recovery_strict()}


def recovering_marks() -> dict[str, Column]:
    """Unequal gates, and four rules by which b's candidates are recovered where a has none.

    Numbers that differ are let pass on near streets and names where one is a part of the other; b asks for equal
    postal codes besides, and takes two shared words for a near name.
    """
    col = F.col
    part = lambda named: ~col("num_conflict") | ((col("street_sim") >= 80) & named & S.numbers_near("part", col("q.nums"), col("t.nums")))
    named = F.when(col("t_no_addr"), (col("core_sort") >= 80) | ((col("shared") >= 2) & (F.greatest("core_sort", "core_set") >= 75)) | col("same_comp")).otherwise(True)
    latin = ~col("t_latin") | (col("core_sort") >= 40) | (col("shared") > 0)
    return {
        "gate_a": ~col("state_conflict") & part(col("core_sort") >= 65),
        "gate_b": ~col("state_conflict") & ~col("post_conflict") & part((col("core_sort") >= 65) | (col("shared") >= 2)) & named & latin,
        "ok": recovery_wide(),
    }


def marked_consensus(rows: DataFrame, from_b: int) -> DataFrame:
    """preferred() of pairs side by side (ra, rb) that hold each run's gate and ``ok``, which recovers those of b; no join."""
    own = rows.withColumns({r: F.when(F.col(gate), F.col(r)) for r, gate in (("ra", "gate_a"), ("rb", "gate_b"))})
    return _preferred_of(own.filter("ra IS NOT NULL OR rb IS NOT NULL"), True, from_b, 4)


def _marked(a: DataFrame, b: DataFrame, judged: DataFrame, marks: dict[str, Column]) -> DataFrame:
    return both(a, b).join(merged(judged.select("query_id", "target_id", *(x.alias(n) for n, x in marks.items()))), ["query_id", "target_id"])


def validated_consensus(a: DataFrame, b: DataFrame, judged: DataFrame) -> DataFrame:
    """Gates and recovery of validated_marks(); both, else a, else three validated ones of b; four at most."""
    return marked_consensus(_marked(a, b, judged, validated_marks()), 3)


def recovering_consensus(a: DataFrame, b: DataFrame, judged: DataFrame) -> DataFrame:
    """Gates and recovery of recovering_marks(); both, else a, else four recovered ones of b; four at most."""
    return marked_consensus(_marked(a, b, judged, recovering_marks()), 4)


def counters(a: DataFrame, b: DataFrame, judged: DataFrame, chosen: DataFrame, queries: DataFrame, told: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """One row: pairs that each gate rejected, queries by where their matches come from, singletons, matches.

    ``told`` makes the rows of all queries from those of a, b and judged, where these hold one of several equal queries.
    """
    every = a.select("query_id", "target_id").unionByName(b.select("query_id", "target_id"))
    marked = told(every.join(merged(judged.select("query_id", "target_id", "state_conflict", "smart_conflict")), ["query_id", "target_id"]))
    gone = marked.agg(F.sum(F.col("state_conflict").cast("int")).alias("rejected_states"), F.sum((~F.col("state_conflict") & F.col("smart_conflict")).cast("int")).alias("rejected_conflicts"))
    total = queries.select("query_id").join(merged(chosen.groupBy("query_id").count()), "query_id", "left").agg(F.sum(F.col("count").isNull().cast("int")).alias("singletons"), F.coalesce(F.sum("count"), F.lit(0)).alias("matches"))
    return gone.crossJoin(total)  # one row by one row


def majority(runs: list[DataFrame]) -> DataFrame:
    """Pairs with at least max(1, n div 2) votes of n runs, the most votes first."""
    need = max(1, len(runs) // 2)
    votes = reduce(DataFrame.unionByName, [r.select("query_id", "target_id", "rank", F.lit(i).alias("run")) for i, r in enumerate(runs)])
    own = votes.groupBy("query_id", "target_id").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("run", "rank")).alias("seen")).filter(F.col("votes") >= need)
    return own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("votes"), "seen", "target_id"))).select("query_id", "target_id", "votes", "rank")


def agreement(a: DataFrame, b: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, and the share of them with equal sets."""
    sets = lambda r, n: r.groupBy("query_id").agg(F.sort_array(F.collect_set("target_id")).alias(n))
    none = F.array().cast("array<string>")
    own = queries.select("query_id").join(merged(sets(a, "x")), "query_id", "left").join(merged(sets(b, "y")), "query_id", "left")
    return own.agg(F.count(F.lit(1)).alias("queries"), F.avg((F.coalesce("x", none) == F.coalesce("y", none)).cast("double")).alias("equal_rate"))


def fullest(runs: dict[str, DataFrame]) -> DataFrame:
    """The name of the run with the most matched queries; ties by name."""
    each = [r.agg(F.count_distinct("query_id").alias("matched")).withColumn("run", F.lit(n)) for n, r in runs.items()]
    return reduce(DataFrame.unionByName, each).orderBy(F.desc("matched"), "run").limit(1)


def blended(*scored: tuple[DataFrame, float]) -> DataFrame:
    """Probabilities of several models by weight; a model that lacks a pair leaves its weight to the others."""
    rows = reduce(DataFrame.unionByName, [d.select("query_id", "target_id", (F.col("p") * w).alias("wp"), F.lit(w).alias("w")) for d, w in scored])
    return rows.groupBy("query_id", "target_id").agg((F.sum("wp") / F.sum("w")).alias("p"))


def differences(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, target_id, kind): pairs of one side only, fp or fn."""
    a, b = (merged(x.select("query_id", "target_id")) for x in (predicted, truth))
    return a.join(b, ["query_id", "target_id"], "left_anti").withColumn("kind", F.lit("fp")).unionByName(b.join(a, ["query_id", "target_id"], "left_anti").withColumn("kind", F.lit("fn")))


def listed(chosen: DataFrame, candidates: DataFrame, most: int | None = 10) -> DataFrame:
    """(query_id, target_id, rank): the matches in their order, then the candidates in theirs that are not among them, ``most`` in all.

    Without ``most`` every match is in the list whatever its length.
    """
    return ordered_union(chosen, candidates, most)
