"""Which of a query's scored candidates are matches: thresholds, top k, expected F-beta.

Input rows are (query_id, target_id, p). Every rule gives (query_id, target_id, p, rank); queries without
a match have no row (metrics and sinks join from the queries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.sources.tables import merged

PRESETS = {"tuned": None, "strict": (0.90, 0.70), "balanced": (0.78, 0.55)}


def ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("p"), "target_id")))


def threshold(scored: DataFrame, at: float) -> DataFrame:
    return ranked(scored.filter(F.col("p") >= at))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    return ranked(scored).filter(F.col("rank") <= k)


def base_sibling(scored: DataFrame, base: float, sibling: float) -> DataFrame:
    """If the best reaches ``base``: it, and all that reach ``sibling``."""
    best = F.max("p").over(W.partitionBy("query_id"))
    return ranked(scored.withColumn("best", best)).filter((F.col("best") >= base) & ((F.col("rank") == 1) | (F.col("p") >= sibling))).drop("best")


def base_sibling_rejecting(scored: DataFrame, base: float, sibling: float, rejected: Column) -> DataFrame:
    """base_sibling(); a rejected best empties the query, a rejected sibling is left out."""
    own = ranked(scored).withColumn("no", rejected).withColumn("first_no", F.max(F.when(F.col("rank") == 1, F.col("no"))).over(W.partitionBy("query_id")))
    best = F.max("p").over(W.partitionBy("query_id"))
    kept = own.withColumn("best", best).filter(~F.col("first_no") & ~F.col("no") & (F.col("best") >= base) & ((F.col("rank") == 1) | (F.col("p") >= sibling)))
    return ranked(kept.select(*scored.columns))


def presets(scored: DataFrame, tuned: tuple[float, float]) -> DataFrame:
    """base_sibling() by three presets, as one table with the column preset."""
    out = None
    for name, pair in PRESETS.items():
        part = base_sibling(scored, *(pair or tuned)).withColumn("preset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def swept(scored: DataFrame, bases: list[float], gap: float = 0.05, least: float = 0.25) -> DataFrame:
    """base_sibling() for each base, with siblings from max(least, base - gap); the column base tells them apart."""
    grid = F.explode(F.array(*(F.lit(float(b)) for b in bases)))
    each = scored.withColumn("base", grid)
    w = W.partitionBy("query_id", "base")
    own = each.withColumn("best", F.max("p").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), "target_id")))
    return own.filter((F.col("best") >= F.col("base")) & ((F.col("rank") == 1) | (F.col("p") >= F.greatest(F.lit(least), F.round(F.col("base") - gap, 10))))).drop("best")


def _listed(scored: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, ids, ps), by descending probability."""
    own = scored if most is None else top_k(scored, most)
    items = F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("m"), "target_id")))
    return own.groupBy("query_id").agg(items.alias("items")).select("query_id", F.col("items.target_id").alias("ids"), F.transform("items.m", lambda m: -m).alias("ps"))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _none(ps: Column) -> Column:
    """The probability that nothing matches."""
    return F.aggregate(ps, F.lit(1.0), lambda s, p: s * (1 - p))


def _pmf(ps: Column) -> Column:
    """Probabilities of 0, 1, ... successes of independent trials: one fold over the trials."""
    zero = F.array(F.lit(0.0))
    return F.aggregate(ps, F.array(F.lit(1.0)), lambda acc, p: F.zip_with(F.concat(F.transform(acc, lambda x: x * (1 - p)), zero), F.concat(zero, F.transform(acc, lambda x: x * p)), lambda a, b: a + b))


def _best_k(scores: Column) -> Column:
    """The first place (from 0) of the greatest score."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _chosen(listed: DataFrame, scores: Column) -> DataFrame:
    k = listed.withColumn("scores", scores).withColumn("k", _best_k(F.col("scores"))).filter("k > 0")
    return k.select("query_id", F.posexplode(F.slice(F.arrays_zip("ids", "ps"), 1, F.col("k"))).alias("n", "x")).select("query_id", F.col("x.ids").alias("target_id"), F.col("x.ps").alias("p"), (F.col("n") + 1).alias("rank"))


def _ks(ps: Column, most: int | None, f) -> Column:
    upper = F.size(ps) if most is None else F.least(F.size(ps), F.lit(most))
    return F.concat(F.array(_none(ps)), F.transform(F.sequence(F.lit(1), upper), f))


def closed_form(scored: DataFrame, beta: float = 0.5) -> DataFrame:
    """The k that maximises (1 + b2) * sum of the first k / (b2 * sum of all + k), if that beats matching nothing."""
    ps, b2 = F.col("ps"), beta * beta
    return _chosen(_listed(scored), _ks(ps, None, lambda k: (1 + b2) * _sum(F.slice(ps, 1, k)) / (b2 * _sum(ps) + k)))


def closed_form_siblings(scored: DataFrame, beta: float = 0.5, sure: float = 0.70, sibling: float = 0.45) -> DataFrame:
    """closed_form(), and where the best of a query with matches reaches ``sure``, all from ``sibling`` on."""
    base = closed_form(scored, beta)
    more = ranked(scored).filter(F.col("p") >= sibling)
    sure_ones = base.filter((F.col("rank") == 1) & (F.col("p") >= sure)).select("query_id")
    return base.select("query_id", "target_id", "p", "rank").unionByName(more.join(merged(sure_ones), "query_id", "left_semi").select("query_id", "target_id", "p", "rank")).distinct()


def mean_tail(scored: DataFrame, beta: float = 0.5, most: int | None = None) -> DataFrame:
    """The exact distribution of hits among the first k, and the mean of those beyond."""
    ps, b2 = F.col("ps"), beta * beta

    def expected(k: Column) -> Column:
        tail = _sum(F.slice(ps, k + 1, F.size(ps)))
        return _sum(F.transform(_pmf(F.slice(ps, 1, k)), lambda p, m: p * (1 + b2) * m / (b2 * (m + tail) + k)))

    return _chosen(_listed(scored, most), _ks(ps, None, expected))


def exact(scored: DataFrame, beta: float = 0.5, most: int | None = 9) -> DataFrame:
    """The exact expectation of F-beta over hits among the first k and misses beyond."""
    ps, b2 = F.col("ps"), beta * beta

    def expected(k: Column) -> Column:
        top, rest = _pmf(F.slice(ps, 1, k)), _pmf(F.slice(ps, k + 1, F.size(ps)))
        return _sum(F.transform(top, lambda p, tp: p * _sum(F.transform(rest, lambda r, fn: r * (1 + b2) * tp / ((1 + b2) * tp + b2 * fn + (k - tp))))))

    return _chosen(_listed(scored), _ks(ps, most, expected))
