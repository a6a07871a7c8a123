"""Decision ladders as columns: gates, then the first branch whose condition holds decides.

A ladder is a list of (outer condition, inner condition, score). ``staged`` ladders end at the first outer
condition that holds, even if its inner one doesn't; ``falling`` ladders go on to the next. Rows are pairs
with structs q and t of records.rule_form(); evidence() adds what ladders compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import similarity as S

Branch = tuple[Column, Column, Column]


def evidence(pairs: DataFrame, windows: bool = False) -> DataFrame:
    """The pairs with similarities from 0 to 100 (0 if a side is empty), set similarities and conflicts.

    With ``windows`` also name_partial, the best window of the longer name, which takes longer than all others.

    String metrics come from one pass over Arrow batches; all else is built in.
    """
    q, t = (lambda f: F.col(f"q.{f}")), (lambda f: F.col(f"t.{f}"))
    kinds = {
        "name_sort": ("token_sort", "name"), "name_set": ("token_set", "name"), "core_sort": ("token_sort", "core"), "core_set": ("token_set", "core"),
        "addr_sort": ("token_sort", "addr"), "addr_set": ("token_set", "addr"), "street_sim": ("token_set", "nonum"),
    } | ({"name_partial": ("partial", "name")} if windows else {})
    step = pairs.select("*", S.measured({n: (kind + "?", q(f), t(f)) for n, (kind, f) in kinds.items()}).alias("measured"))
    return step.select(
        *pairs.columns, "measured.*",
        ((q("comp") != "") & (q("comp") == t("comp"))).alias("same_comp"), S.overlap(q("nums"), t("nums")).alias("num_agree"), S.plain_conflict(q("nums"), t("nums")).alias("num_conflict"),
        S.number_conflict(q("snums"), q("zip"), t("snums"), t("zip")).alias("smart_conflict"), S.plain_conflict(q("post"), t("post")).alias("post_conflict"),
        F.coalesce(q("state") != t("state"), F.lit(False)).alias("state_conflict"), F.size(F.array_intersect(q("toks"), t("toks"))).alias("shared"),
        (q("addr") == "").alias("q_no_addr"), (t("addr") == "").alias("t_no_addr"), t("latin").alias("t_latin"), (q("country") == "India").alias("india"),
        S.jaccard(q("ntoks"), t("ntoks")).alias("name_jac"), S.jaccard(q("atoks"), t("atoks")).alias("addr_jac"),
    )


c = F.col
NO = lambda: F.lit(False)
YES = lambda: F.lit(True)


def _no_addr() -> Column:
    return c("q_no_addr") | c("t_no_addr")


def _name_jaccard() -> list[Branch]:
    return [(YES(), c("name_jac") >= 0.6, c("name_jac"))]


def _name_address() -> list[Branch]:
    a, n = c("addr_jac"), c("name_jac")
    return [((a >= 0.5) | (c("num_agree") & (a >= 0.28)), YES(), 0.6 + a), (n >= 0.7, YES(), 0.5 + n), ((a >= 0.35) & (n >= 0.35), YES(), 0.4 + a + n)]


def _fuzzy(low: float, moderate: float) -> Callable[[], list[Branch]]:
    """Jaccard and best-word similarity; a branch of its own where the target has no address."""

    def ladder() -> list[Branch]:
        a, n, num, bare = c("addr_jac"), c("name_jac"), c("num_agree"), F.size("t.atoks") == 0
        words = S.best_word_similarity(c("q.ntoks"), c("t.ntoks"))
        x, y = F.array_join("q.ntoks", ""), F.array_join("t.ntoks", "")
        inside = (F.length(x) >= 6) & (F.length(y) >= 6) & (F.contains(x, y) | F.contains(y, x))
        return [
            (bare & (n >= 0.6), YES(), 0.7 + n), (bare & (n >= low) & (words >= 0.7), YES(), 0.6 + n), (bare, NO(), F.lit(0.0)),
            ((n >= 0.5) & ((a >= 0.12) | num), YES(), 0.8 + n + a), ((n >= moderate) & ((a >= 0.15) | num) & (words >= 0.6), YES(), 0.75 + a),
            ((n >= 0.3) & (a >= 0.3) & num, YES(), 0.7 + n + a), (~c("t_latin") & (a >= 0.5) & num, YES(), 0.65 + a),
            (((F.size("q.ntoks") >= 2) | (F.size("t.ntoks") >= 2)) & (a >= 0.25) & inside, YES(), 0.6 + a),
        ]

    return ladder


def _compressed_jaccard() -> list[Branch]:
    a, n, num = c("addr_jac"), c("name_jac"), c("num_agree")
    return [
        (c("same_comp"), YES(), F.lit(1.0)), ((n >= 0.5) & ((a >= 0.12) | num | (F.size("t.atoks") == 0)), YES(), 0.85 + n + a), ((n >= 0.3) & ((a >= 0.25) | num), YES(), 0.78 + a),
        (~c("t_latin") & c("india") & ((a >= 0.4) | (num & (a >= 0.25))), YES(), 0.88 + a), (num & (a >= 0.55), YES(), 0.72 + a),
    ]


def _recall(strong=(70, 40), subset=(85, 50, 35), moderate=(55, 55), script=(55, 35), street=(65, 0), part: tuple | None = None) -> Callable[[], list[Branch]]:
    """Six or seven fuzzy rules on sorted names and addresses."""

    def ladder() -> list[Branch]:
        n, s, a, num = c("name_sort"), c("name_set"), c("addr_sort"), c("num_agree")
        out = [(c("same_comp"), YES(), F.lit(1.0)), ((n >= strong[0]) & ((a >= strong[1]) | num | c("t_no_addr")), YES(), 0.9 + n / 100), ((s >= subset[0]) & (n >= subset[1]) & ((a >= subset[2]) | num), YES(), 0.85 + s / 100)]
        if part:
            out.append(((c("name_partial") >= part[0]) & (n >= part[1]) & ((a >= part[2]) | num), YES(), 0.82 + c("name_partial") / 100))
        out.append(((n >= moderate[0]) & ((a >= moderate[1]) | (num & (a >= 35))), YES(), 0.8 + a / 100))
        out.append((~c("t_latin") & c("india") & ((a >= script[0]) | (num & (a >= script[1]))), YES(), 0.78 + a / 100))
        out.append((num & (a >= street[0]) & (n >= street[1]), YES(), 0.72 + a / 100))
        return out

    return ladder


def _strike() -> list[Branch]:
    n, a, num = c("name_sort"), c("addr_sort"), c("num_agree")
    score = n * 0.6 + a * 0.4
    return [(c("same_comp"), YES(), F.lit(1.0)), ((n >= 70) & ((a >= 40) | num | c("t_no_addr")), YES(), score), ((n >= 55) & (a >= 75) & num, YES(), score), (n >= 85, YES(), score)]


def _pseudo_probability() -> list[Branch]:
    n, a, num, bad = c("name_sort"), c("addr_sort"), c("num_agree"), c("num_conflict")
    return [
        (c("same_comp"), _no_addr() | (a >= 25) | ~bad, F.lit(0.98)), (n >= 88, ~bad | (a >= 50) | c("t_no_addr"), F.lit(0.93)), ((n >= 70) & ~bad, (a >= 35) | num | c("t_no_addr"), F.lit(0.82)),
        ((~c("t_latin") | (n < 50)) & ~bad, (a >= 60) | (num & (a >= 40)), F.lit(0.78)), ((a >= 75) & ~bad & (n >= 35), YES(), F.lit(0.75)),
    ]


def _calibrated() -> list[Branch]:
    n, a, num, bad = c("name_sort"), c("addr_sort"), c("num_agree"), c("num_conflict")
    near = (a >= 30) | num | c("t_no_addr")
    return [
        (c("same_comp"), ~bad & (_no_addr() | (a >= 25) | num | S.overlap(c("q.post"), c("t.post"))), 100 + a * 0.1), (n >= 88, (~bad | (a >= 50) | c("t_no_addr")) & near, n * 0.6 + a * 0.4),
        ((n >= 70) & ~bad, (a >= 35) | num | c("t_no_addr"), n * 0.6 + a * 0.4), ((~c("t_latin") | (n < 50)) & ~bad, (a >= 60) | (num & (a >= 40)), a), ((a >= 75) & ~bad & (n >= 35), YES(), a * 0.7 + n * 0.3),
    ]


def _core() -> Column:
    return F.greatest("core_sort", "core_set")


def _addr() -> Column:
    return F.greatest("addr_sort", "addr_set")


def _precision() -> list[Branch]:
    core, addr, street, num, shared = _core(), _addr(), c("street_sim"), c("num_agree"), c("shared")
    bare = c("t.core") == ""
    return [
        (c("same_comp"), _no_addr() | (street >= 20) | num, F.lit(100.0)),
        ((num | (street >= 85)) & (addr >= 60) & (street >= 65), (core >= 30) | bare | (shared >= 1) | (F.size("t.toks") <= 1), 90 + 0.1 * addr),
        ((addr >= 75) & (F.length("q.addr") > 15) & ((core >= 35) | bare | (shared >= 1)), YES(), 85 + 0.1 * addr),
        (core >= 80, F.when(_no_addr(), (shared >= 1) | (F.length("q.core") >= 8)).otherwise((addr >= 25) | num | (street >= 40)), 80 + 0.1 * core),
        (c("t_no_addr") & (shared >= 2) & (core >= 65), YES(), F.lit(78.0)),
        ((core >= 50) & ((addr >= 50) | num | (street >= 65)), YES(), 75 + 0.1 * core),
    ]


def _state_aware() -> list[Branch]:
    """The branches of _precision() with a score for each, on which a pair falls through."""
    return [(outer, inner, F.lit(float(score))) for (outer, inner, _), score in zip(_precision(), (100, 90, 85, 80, 78, 75), strict=True)]


def _earlier() -> list[Branch]:
    """The evaluator before it: higher floors, no branch of its own for targets without an address."""
    core, addr, street, num, shared = _core(), _addr(), c("street_sim"), c("num_agree"), c("shared")
    return [
        (c("same_comp"), _no_addr() | (street >= 25) | num, F.lit(100.0)), (num & (addr >= 60) & (street >= 65), YES(), F.lit(90.0)),
        ((addr >= 82) & (F.length("q.addr") > 20) & ((core >= 40) | (c("t.core") == "") | (shared >= 1)), YES(), F.lit(85.0)),
        (core >= 82, F.when(_no_addr(), shared >= 1).otherwise((addr >= 25) | num | (street >= 45)), F.lit(80.0)),
        ((core >= 65) & ((addr >= 50) | num | (street >= 65)), YES(), F.lit(75.0)),
    ]


def _typo_kept(kind: str = "typo", core: int = 65) -> Column:
    """Numbers that differ are let pass if they are a typo apart and names and streets are near."""
    return ~c("num_conflict") | ((_core() >= core) & (c("street_sim") >= 75) & S.numbers_near(kind, c("q.nums"), c("t.nums")))


def letter_jaccard() -> Column:
    """Of the addresses' words of two letters or more."""
    words = lambda s: F.regexp_extract_all(F.col(f"{s}.addr"), F.lit(r"\b([a-z]{2,})\b"), 1)
    return S.jaccard(words("q"), words("t"))


def _token_model() -> list[Branch]:
    """Core words and address words; the better of the two Jaccard similarities orders."""
    a, n, num = letter_jaccard(), S.jaccard(c("q.toks"), c("t.toks")), c("num_agree")
    return [((a >= 0.5) | (num & (a >= 0.28)) | (n >= 0.7) | ((a >= 0.35) & (n >= 0.35)), YES(), F.greatest(n, a))]


def _resolver(exact=(20, 60), script=(60, 55), street=(68, 40, 101), high=(85, 30), both=(70, 75)) -> Callable[[], list[Branch]]:
    """Exact root, cross-script, building and street, high core, core and street."""

    def ladder() -> list[Branch]:
        core, st, num, a = c("core_sort"), c("street_sim"), c("num_agree"), c("addr_sort")
        return [
            (c("same_comp"), _no_addr() | (st >= exact[0]) | num | (core >= exact[1]), F.lit(1.0)), (~c("t_latin") & c("india"), num & ((st >= script[0]) | (a >= script[1])), F.lit(0.95)),
            (num & (st >= street[0]) & ((core >= street[1]) | (c("core_set") >= street[2]) | (c("shared") >= 1)), YES(), 0.9 + 0.1 * core / 100),
            ((core >= high[0]) & (num | (st >= high[1]) | _no_addr()), YES(), 0.85 + 0.15 * core / 100), ((core >= both[0]) & (num | (st >= both[1])), YES(), F.lit(0.8)),
        ]

    return ladder


def _seven() -> list[Branch]:
    core, s, st, num, a = c("core_sort"), c("core_set"), c("street_sim"), c("num_agree"), c("addr_sort")
    return [
        (c("same_comp"), _no_addr() | (st >= 15) | num | (core >= 50), F.lit(1.0)), (~c("t_latin") & c("india"), num & ((st >= 55) | (a >= 50)), F.lit(0.95)),
        (_no_addr() & ((s >= 90) | (core >= 80)), YES(), F.lit(0.88)), (num & (st >= 65) & ((core >= 35) | (s >= 65) | (c("shared") >= 1)), YES(), 0.9 + 0.1 * F.greatest(core, st) / 100),
        ((st >= 85) & ((core >= 50) | (s >= 70)), YES(), F.lit(0.86)), ((core >= 85) & (num | (st >= 25)), YES(), F.lit(0.85)), ((s >= 92) & (num | (st >= 60)), YES(), F.lit(0.82)),
    ]


def _smart() -> Column:
    return ~c("state_conflict") & ~c("smart_conflict")


#: Ladder, gate, most matches of a query, and whether a taken branch is final.
LADDERS: dict[str, tuple[Callable[[], list[Branch]], Callable[[], Column], int | None, bool]] = {
    "R1": (_name_jaccard, YES, None, True),
    "R2": (_name_address, YES, 5, True),
    "R3": (_fuzzy(0.3, 0.0), YES, 5, True),
    "R4": (_fuzzy(0.25, 0.2), YES, 5, False),
    "R5": (_compressed_jaccard, YES, 5, True),
    "R6": (_recall(), YES, 8, True),
    "R7": (_recall((65, 35), (80, 45, 30), (50, 55), (50, 30), (60, 25), (80, 40, 35)), YES, 8, True),
    "R8": (_strike, lambda: ~c("num_conflict"), 4, True),
    "R9": (_pseudo_probability, lambda: ~c("post_conflict"), 4, True),
    "R10": (_calibrated, lambda: ~c("post_conflict"), 4, True),
    "R11": (_precision, lambda: ~c("state_conflict") & ~c("post_conflict") & _typo_kept(), 4, True),
    "R12": (_state_aware, lambda: ~c("state_conflict") & _typo_kept(), 4, False),
    "R13": (_earlier, lambda: _typo_kept("near_typo", 75), 4, False),
    "R14": (_resolver(), _smart, 4, True),
    "R15": (_seven, _smart, 4, True),
    "R16": (_resolver((15, 45), (50, 45), (55, 35, 101), (80, 25), (65, 65)), _smart, 4, True),
    "R17": (_resolver((20, 50), (60, 55), (65, 40, 101), (85, 30), (72, 75)), _smart, 5, True),
    "R17a": (_token_model, _smart, 5, True),
}
#: What orders matches besides score and target, the best first: further similarities, then targets from the last.
ORDERS: dict[str, Callable[[], list[Column]]] = {
    "R14": lambda: [F.desc("score"), F.desc("core_sort"), F.desc("target_id")],
    "R15": lambda: [F.desc("score"), F.greatest("core_sort", "street_sim").desc(), F.desc("target_id")],
    "R17": lambda: [F.desc("core_sort"), F.desc("target_id")],
    "R17a": lambda: [F.desc("score"), F.desc("target_id")],
}


def tuned(street: int | Column, core: int | Column, high: int | Column) -> tuple:
    """The ladder with three thresholds of a grid, numbers or columns."""
    return _resolver((15, 45), (50, 45), (street, core, 101), (high, 25), (65, 65)), _smart, 4, True


def judged(pairs: DataFrame, name: str | tuple = "R11") -> DataFrame:
    """The evidence with score (null: gated or no branch), is_match and passes (the gate)."""
    ladder, gate, _, final = LADDERS[name] if isinstance(name, str) else name
    score = F.lit(None).cast("double")
    for outer, inner, value in reversed(ladder()):
        score = F.when(outer & inner, value).when(outer, None).otherwise(score) if final else F.when(outer & inner, value).otherwise(score)
    return pairs.withColumn("passes", gate()).withColumn("score", F.when(F.col("passes"), score)).withColumn("is_match", F.col("score").isNotNull())


def matches(judged_pairs: DataFrame, most: int | None = 4, order: list[Column] | None = None) -> DataFrame:
    """(query_id, target_id, score, rank) of the matches, the best ``most`` of each query; by score and target, or by ``order``."""
    by = order or [F.desc("score"), F.asc("target_id")]
    ranked = judged_pairs.filter("is_match").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by)))
    own = ranked if most is None else ranked.filter(F.col("rank") <= most)
    return own.select("query_id", "target_id", "score", "rank")


def by_ladder(evidence_: DataFrame, name: str) -> DataFrame:
    """matches() of a ladder, in its own order."""
    return matches(judged(evidence_, name), LADDERS[name][2], ORDERS[name]() if name in ORDERS else None)


def side_by_side(evidence_: DataFrame, ladders: dict[str, str], marks: dict[str, Column]) -> DataFrame:
    """(query_id, target_id), a pair's rank by each ladder, null where by_ladder() lacks the pair, and ``marks`` of the evidence.

    What is compared of a query meets in one shuffle of few columns: the evidence is read once and runs aren't joined.
    """
    if any(name in ORDERS for name in ladders.values()):
        raise ValueError("ladders with an order of their own can't be ranked side by side")
    own = evidence_.withColumns(marks)
    for run, name in ladders.items():
        own = judged(own, name).withColumnRenamed("score", run).drop("passes", "is_match")
    rank = {run: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(run), "target_id")) for run in ladders}
    few = {run: F.lit(True) if LADDERS[name][2] is None else rank[run] <= LADDERS[name][2] for run, name in ladders.items()}
    return own.select("query_id", "target_id", *ladders, *marks).withColumns({run: F.when(F.col(run).isNotNull() & few[run], rank[run]) for run in ladders})


def kept_candidates(judged_pairs: DataFrame, most: int = 12) -> DataFrame:
    """The best pairs that pass the gate: by score, others by half the core name and half the address similarity."""
    fill = F.coalesce("score", 0.5 * _core() + 0.5 * _addr())
    ranked = judged_pairs.filter("passes").withColumn("fill", fill)
    order = W.partitionBy("query_id").orderBy(F.desc("fill"), "target_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", "target_id", "is_match", "fill", "rank")


def filled_candidates(judged_pairs: DataFrame, most: int = 6) -> DataFrame:
    """Matches first, then the others by 0.6 of the name and 0.4 of the address Jaccard similarity."""
    fill = F.coalesce("score", c("name_jac") * 0.6 + c("addr_jac") * 0.4)
    ranked = judged_pairs.withColumn("fill", fill)
    order = W.partitionBy("query_id").orderBy(F.desc("is_match"), F.desc("fill"), "target_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", "target_id", "is_match", "fill", "rank")


def miss_reasons(true_pairs: DataFrame) -> DataFrame:
    """(reason, n) of the true pairs that the dual string-metric ladder misses."""
    own = judged(true_pairs, "R17").filter("NOT is_match")
    reason = F.when(c("state_conflict"), "state_conflict").when(c("smart_conflict"), "number_conflict").when((c("core_sort") < 40) & ~c("same_comp"), "low_core_name_sim").when(~c("num_agree") & (c("street_sim") < 60), "low_street_sim").otherwise("other_threshold")
    return own.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
