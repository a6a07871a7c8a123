"""Evaluation of predicted pairs against true ones. Averages go over the queries that are asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import decide


def counts(predicted: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, tp, fp, fn) of every query."""
    mark = lambda d, n: d.select("query_id", "target_id").distinct().withColumn(n, F.lit(1))
    both = mark(predicted, "p").join(mark(truth, "t"), ["query_id", "target_id"], "full").fillna(0, ["p", "t"])
    own = both.groupBy("query_id").agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum(F.col("p") * (1 - F.col("t"))).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"))
    return queries.select("query_id").distinct().join(own, "query_id", "left").fillna(0, ["tp", "fp", "fn"])


def by_query(predicted: DataFrame, truth: DataFrame, queries: DataFrame, beta: float = 0.5) -> DataFrame:
    """counts() with f, precision and recall: both sides empty is 1; one empty is 0, but precision of no prediction is 1 and recall of no truth is 1."""
    b2 = beta * beta
    bottom = (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")
    part = lambda x: F.when(F.col("tp") + F.col(x) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(x)))
    return counts(predicted, truth, queries).select("*", F.when(bottom == 0, 1.0).otherwise((1 + b2) * F.col("tp") / bottom).alias("f"), part("fp").alias("precision"), part("fn").alias("recall"))


def macro(predicted: DataFrame, truth: DataFrame, queries: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row: macro and micro averages, and how singletons fared."""
    own = by_query(predicted, truth, queries, beta)
    tp, fp, fn = (F.sum(x) for x in ("tp", "fp", "fn"))
    single = (F.col("tp") + F.col("fn") == 0).cast("int")
    alarm = single * (F.col("fp") > 0).cast("int")
    share = lambda a, b: F.when(a + b == 0, 0.0).otherwise(a / (a + b))
    return own.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("f").alias("macro_f"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        share(tp, fp).alias("micro_precision"), share(tp, fn).alias("micro_recall"), F.sum(single).alias("singletons"), F.sum(alarm).alias("false_alarms"),
    )


def baselines(scored: DataFrame, truth: DataFrame, k: int = 5, at: float = 0.5, beta: float = 0.5) -> DataFrame:
    """(rule, macro_f) of the k best, of a fixed threshold and of the closed-form choice, over the queries that have candidates."""
    queries = scored.select("query_id").distinct()
    own = truth.join(queries, "query_id", "left_semi")
    rules = {"top_k": decide.top_k(scored, k), "fixed_threshold": decide.threshold(scored, at), "closed_form": decide.closed_form(scored, beta)}
    parts = [by_query(found, own, queries, beta).agg(F.avg("f").alias("macro_f")).select(F.lit(name).alias("rule"), "macro_f") for name, found in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def missed_whole(predicted: DataFrame, truth: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, true_ids, predicted_ids), lists by id, of the first ``most`` queries that have matches and none of them found."""
    listed = lambda d, name: d.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("target_id")), ",").alias(name))
    first = counts(predicted, truth, queries).filter("tp = 0 AND fn > 0").select("query_id").orderBy("query_id").limit(most)
    few = lambda d: d.join(F.broadcast(first), "query_id", "left_semi")  # noqa: E731 - ``most`` ids
    own = first.join(listed(few(truth), "true_ids"), "query_id").join(listed(few(predicted), "predicted_ids"), "query_id", "left")
    return own.select("query_id", "true_ids", F.coalesce("predicted_ids", F.lit("")).alias("predicted_ids"))


def blocking_recall(candidates: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, their share, and candidates a query; a share below 0.97 caps what comes after."""
    found = truth.join(candidates.select("query_id", "target_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "target_id"], "left")
    part = found.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
    each = queries.select("query_id").join(candidates.groupBy("query_id").count(), "query_id", "left")
    return part.crossJoin(each.agg(F.avg(F.coalesce("count", F.lit(0))).alias("mean_candidates")))  # one row by one row


def run_statistics(run: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, matched ones, singletons and their share, pairs, and pairs a matched query."""
    own = queries.select("query_id").join(run.groupBy("query_id").count(), "query_id", "left").fillna(0, ["count"])
    hit = (F.col("count") > 0).cast("int")
    return own.agg(F.count(F.lit(1)).alias("queries"), F.sum(hit).alias("matched"), F.sum(1 - hit).alias("singletons"), F.avg((1 - hit).cast("double")).alias("singleton_rate"), F.sum("count").alias("pairs"), F.when(F.sum(hit) > 0, F.sum("count") / F.sum(hit)).otherwise(0.0).alias("pairs_a_match"))


def validation(run: DataFrame, candidates: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: unknown queries and targets, repeated pairs, matches that are no candidates. All 0 for a valid result."""
    pairs = run.select("query_id", "target_id")
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    out = n(pairs.join(queries.select("query_id"), "query_id", "left_anti"), "unknown_queries")
    out = out.crossJoin(n(pairs.join(targets.select("target_id"), "target_id", "left_anti"), "unknown_targets"))
    out = out.crossJoin(pairs.groupBy("query_id", "target_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated")))
    return out.crossJoin(n(pairs.join(candidates.select("query_id", "target_id"), ["query_id", "target_id"], "left_anti"), "not_candidates"))


def threshold_grid(scored: DataFrame, truth: DataFrame, queries: DataFrame, bases: list[float], siblings: list[float], beta: float = 0.5) -> DataFrame:
    """(base, sibling, macro_f, place) of every pair of thresholds with sibling <= base, best first; ties in grid order."""
    from pyspark.sql import Window as W

    grid = [(b, s) for b in bases for s in siblings if s <= b]
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("cell"), F.lit(float(b)).alias("base"), F.lit(float(s)).alias("sibling")) for i, (b, s) in enumerate(grid))))
    # A query's pairs are at most its candidates, so a cell's counts are one aggregation without another join.
    marks = truth.select("query_id", "target_id").distinct().withColumn("true", F.lit(1))
    own = scored.join(marks, ["query_id", "target_id"], "left").fillna(0, ["true"])
    w = W.partitionBy("query_id")
    own = own.withColumn("best", F.max("p").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), "target_id")))
    each = own.select("*", cells.alias("g")).filter((F.col("best") >= F.col("g.base")) & ((F.col("rank") == 1) | (F.col("p") >= F.col("g.sibling"))))
    hits = each.groupBy("query_id", "g").agg(F.sum("true").alias("tp"), F.sum(1 - F.col("true")).alias("fp"))
    every = queries.select("query_id").distinct().join(truth.groupBy("query_id").agg(F.count_distinct("target_id").alias("n")), "query_id", "left").fillna(0, ["n"])
    full = every.select("query_id", "n", cells.alias("g")).join(hits, ["query_id", "g"], "left").fillna(0, ["tp", "fp"])
    b2 = beta * beta
    bottom = (1 + b2) * F.col("tp") + b2 * (F.col("n") - F.col("tp")) + F.col("fp")
    f = F.when(bottom == 0, 1.0).otherwise((1 + b2) * F.col("tp") / bottom)
    return full.groupBy("g").agg(F.avg(f).alias("macro_f")).select(F.col("g.base").alias("base"), F.col("g.sibling").alias("sibling"), "macro_f", F.row_number().over(W.orderBy(F.desc("macro_f"), F.col("g.cell"))).alias("place"))
