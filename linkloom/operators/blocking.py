"""Candidate generation: equi-joins on derived keys within a country, capped by document frequency.

Keys whose frequency is above a cap are dropped before the join, so no join has a hot key; character grams
have no cap, the hot ones are dealt to several tasks. What the rare
queries without any candidate fall back on is a bounded number of targets. Ties go by key and id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import address as A
from linkloom.sources.tables import merged

#: A gram that more texts of a block's targets have is joined in several tasks.
TARGETS_PER_TASK = 5000


def _keys() -> dict[str, Column]:
    pair = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("|", x, y))))
    two = F.slice("nums", 1, 2)
    prefix = lambda n, least=None: F.when(F.length("comp") >= (least or n), F.array(F.substring("comp", 1, n))).otherwise(F.array().cast("array<string>"))
    return {
        "comp": F.when(F.col("comp") != "", F.array("comp")).otherwise(F.array().cast("array<string>")),
        "token": F.col("toks"),
        "name_token": F.col("ntoks"),
        "address_token": F.col("atoks"),
        "postal_number": pair(F.col("post"), F.col("nums")),
        "street_number": pair(F.col("street"), two),
        "locality_number": pair(A.locality_words(F.col("addr")), two),
        "distinct_number": pair(F.slice("dwords", 1, 3), two),
        "distinct_word": F.slice("dwords", 1, 2),
        "number": F.col("nums"),
        "prefix5": prefix(5, 4),
        "prefix4": prefix(4),
        "prefix6": prefix(6),
    }


def postings(records: DataFrame, kind: str, keys: Column | None = None) -> DataFrame:
    """(country, key, id), a row for each distinct key of a record."""
    own = _keys()[kind] if keys is None else keys
    return records.select("country", F.explode(F.array_distinct(own)).alias("key"), "id")


def frequencies(targets: DataFrame) -> DataFrame:
    return targets.groupBy("country", "key").agg(F.count(F.lit(1)).alias("df"))


def capped(queries: DataFrame, targets: DataFrame, cap: int | None = None) -> DataFrame:
    """(query_id, target_id) of equal keys that at most ``cap`` targets have."""
    allowed = targets if cap is None else targets.join(merged(frequencies(targets).filter(F.col("df") <= cap).select("country", "key")), ["country", "key"], "left_semi")
    return _pairs(queries, allowed)


def _pairs(queries: DataFrame, targets: DataFrame) -> DataFrame:
    return queries.withColumnRenamed("id", "query_id").join(merged(targets.withColumnRenamed("id", "target_id")), ["country", "key"]).select("query_id", "target_id").distinct()


def rarest(queries: DataFrame, targets: DataFrame, k: int, cap: int, absent_count: bool = True, fallback: tuple[int, int] | None = None, found: DataFrame | None = None) -> DataFrame:
    """Pairs by each query's ``k`` rarest keys, of those that at most ``cap`` targets have.

    With ``absent_count`` keys that no target has take up places among the ``k`` (their frequency is 0).
    ``fallback`` (cap, n): queries that have no pair, here or in ``found``, get the first n targets of
    their rarest key, if at most cap targets have it.
    """
    df = merged(frequencies(targets))
    ranked = queries.join(df, ["country", "key"], "left" if absent_count else "inner").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("df", "key")))
    first = _pairs(ranked.filter((F.col("rank") <= k) & (F.col("df") <= cap)).select("country", "key", "id"), targets)
    if fallback is None:
        return first
    most, n = fallback
    have = first if found is None else first.unionByName(found)
    lost = ranked.filter((F.col("rank") == 1) & F.col("df").between(1, most)).join(merged(have.select(F.col("query_id").alias("id")).distinct()), "id", "left_anti")
    few = targets.join(merged(lost.select("country", "key").distinct()), ["country", "key"], "left_semi")
    few = few.withColumn("n", F.row_number().over(W.partitionBy("country", "key").orderBy("id"))).filter(F.col("n") <= n).drop("n")
    return first.unionByName(_pairs(lost.select("country", "key", "id"), few)).distinct()


def first_frequent(queries: DataFrame, targets: DataFrame, k: int = 2, low: int = 2, high: int = 500) -> DataFrame:
    """Pairs by the first of each query's ``k`` rarest keys that between ``low`` and ``high`` targets have."""
    ranked = queries.join(merged(frequencies(targets)), ["country", "key"]).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("df", "key")))
    own = ranked.filter((F.col("rank") <= k) & F.col("df").between(low, high))
    one = own.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("rank"))).filter("n = 1")
    return _pairs(one.select("country", "key", "id"), targets)


def prefix_filtered(queries: DataFrame, targets: DataFrame, threshold: float = 0.3, cap: int = 3000) -> DataFrame:
    """Pairs that can reach a Jaccard similarity of ``threshold``: rare-key prefix and length filter.

    Of a query's n keys the n - ceil(threshold * n) + 1 rarest are joined, if at most ``cap`` targets have
    them, or else the single rarest; lengths lie between threshold * n and n / threshold.
    """
    size = lambda d: d.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ranked = queries.join(merged(frequencies(targets)), ["country", "key"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.join(size(queries), "id").withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("df", "key")))
    own = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    own = own.withColumn("any", F.max((F.col("df") <= cap).cast("int")).over(W.partitionBy("id")))
    own = own.filter((F.col("df") <= cap) | ((F.col("any") == 0) & (F.col("rank") == 1)))
    pairs = _pairs(own.select("country", "key", "id"), targets)
    q, t = size(queries).toDF("query_id", "qn"), size(targets).toDF("target_id", "tn")
    return pairs.join(q, "query_id").join(t, "target_id").filter((F.col("tn") >= F.ceil(F.col("qn") * threshold)) & (F.col("tn") <= F.floor(F.col("qn") / threshold))).select("query_id", "target_id")


def widened(found: DataFrame, more: DataFrame, under: int) -> DataFrame:
    """``found`` and, for queries that have fewer than ``under`` pairs in it, ``more``."""
    full = found.groupBy("query_id").count().filter(F.col("count") >= under).select("query_id")
    return found.unionByName(more.join(merged(full), "query_id", "left_anti")).distinct()


def union(*pairs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, pairs).distinct()


def rule_candidates(q: DataFrame, t: DataFrame, name_cap: int = 250, addr_cap: int = 60, wide: tuple[int, int] = (600, 100)) -> DataFrame:
    """Four keys: compressed name, two rarest tokens with a fallback, (postal code, number), (street word, number)."""
    comp = capped(postings(q, "comp"), postings(t, "comp"))
    token = rarest(postings(q, "token"), postings(t, "token"), 2, name_cap, True, wide, comp)
    places = [capped(postings(q, k), postings(t, k), addr_cap) for k in ("postal_number", "street_number")]
    return union(comp, token, *places)


def staged_candidates(q: DataFrame, t: DataFrame, under: int = 200) -> DataFrame:
    """Compressed name, four rarest tokens, (distinctive address word, number); distinctive words and prefixes where few were found.

    A query's first three distinctive words meet numbers, its first two stand alone; a target has all of its own.
    """
    places = lambda kind, keys, cap: capped(postings(q, kind), postings(t, kind, keys), cap)
    every = F.flatten(F.transform("dwords", lambda x: F.transform("nums", lambda y: F.concat_ws("|", x, y))))
    base = union(capped(postings(q, "comp"), postings(t, "comp")), rarest(postings(q, "token"), postings(t, "token"), 4, 500), places("distinct_number", every, 100))
    base = widened(base, places("distinct_word", F.col("dwords"), 60), under)
    return widened(base, capped(postings(q, "prefix5"), postings(t, "prefix5"), 300), under)


def locality_candidates(q: DataFrame, t: DataFrame, under: int = 150) -> DataFrame:
    """Compressed name, two rarest tokens, (locality word, number); prefixes of four letters where few were found."""
    base = union(capped(postings(q, "comp"), postings(t, "comp")), rarest(postings(q, "token"), postings(t, "token"), 2, 150), capped(postings(q, "locality_number"), postings(t, "locality_number"), 30))
    return widened(base, capped(postings(q, "prefix4"), postings(t, "prefix4"), 250), under)


def evaluation_candidates(q: DataFrame, t: DataFrame) -> DataFrame:
    """Compressed name, every token that 400 targets have at most, every number that 250 have."""
    return union(*(capped(postings(q, kind), postings(t, kind), cap) for kind, cap in (("comp", None), ("token", 400), ("number", 250))))


def ranked_and_capped(pairs: DataFrame, most: int, score: str = "score") -> DataFrame:
    """The ``most`` best pairs of each query by a cheap score, ties to the last target; all where there are no more."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), F.desc("target_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def tiered_candidates(q: DataFrame, t: DataFrame, rare: tuple[int, float] = (40, 0.01), hopeless: tuple[int, float] = (300, 0.05), postal: bool = False, postal_cap: int = 300) -> DataFrame:
    """Index with tiers: strong keys join; weak ones where two agree, or where nothing strong is found.

    A token is hopeless above max(300, 5 % of the country's targets), weak above max(40, 1 %). Rows of
    ``q`` and ``t`` are records.feature_form(). Name prefix and (house, state) are strong; house or state
    alone are weak; with ``postal`` so is a postal code that few targets have.
    """
    none = F.array().cast("array<string>")
    some = lambda ok, key: F.when(ok, F.array(key)).otherwise(none)
    house, state = F.col("a.house"), F.col("a.state")
    band = (F.expr("try_cast(a.house AS bigint)") / 10).cast("bigint").cast("string")
    kinds = {
        "token": (F.col("n.tokens"), None), "prefix": (some(F.length("n.full") >= 5, F.substring("n.full", 1, 5)), True),
        "house_state": (some((house != "") & (state != ""), F.concat_ws("|", house, state)), True),
        "band_state": (some(band.isNotNull() & (state != ""), F.concat_ws("|", band, state)), False),
        "house": (some(house != "", house), False), "state": (some(state != "", state), False),
    } | ({"postal": (some(F.col("a.postal") != "", F.col("a.postal")), False)} if postal else {})
    pool = t.groupBy("country").agg(F.count(F.lit(1)).alias("pool"))
    parts = []
    for kind, (keys, strong) in kinds.items():
        tk = postings(t, kind, keys)
        df = frequencies(tk).join(pool, "country")
        limit = lambda x: F.greatest(F.lit(x[0]), F.col("pool") * x[1])
        live = df.filter(F.col("df") <= (F.lit(postal_cap) if kind == "postal" else limit(hopeless)))
        is_strong = (F.col("df") <= limit(rare)) if strong is None else F.lit(strong)
        live = live.select("country", "key", is_strong.alias("strong"))
        pairs = postings(q, kind, keys).withColumnRenamed("id", "query_id").join(live, ["country", "key"]).join(tk.withColumnRenamed("id", "target_id"), ["country", "key"])
        parts.append(pairs.select("query_id", "target_id", "strong"))
    hits = reduce(DataFrame.unionByName, parts).groupBy("query_id", "target_id").agg(F.max("strong").alias("strong"), F.sum((~F.col("strong")).cast("int")).alias("weak"))
    hits = hits.withColumn("any", F.max("strong").over(W.partitionBy("query_id")))
    return hits.filter(F.col("strong") | (F.col("weak") >= 2) | ~F.col("any")).select("query_id", "target_id")


def gram_similarity(q: DataFrame, t: DataFrame, block: Column, text: Column, sizes=(3, 4, 5)) -> DataFrame:
    """(query_id, target_id, score): cosine of character n-gram counts of words, within a block.

    An inverted join of gram weights, each text's counts scaled to length 1. No gram is left out. Equal
    texts of a block are scored once; a gram that many texts of the targets have is dealt to several tasks.
    Products are added up as whole numbers, so scores and their ties don't depend on the order of rows.
    """

    def of_size(n: int):
        def cut(w: Column) -> Column:
            every = F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))
            return F.when(F.length(w) >= n, every).otherwise(F.array().cast("array<string>"))

        return cut

    def grams(x: Column) -> Column:
        words = F.filter(F.split(x, " "), lambda w: w != "")
        padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        return F.concat(*(F.flatten(F.transform(padded, of_size(n))) for n in sizes))

    def weights(d: DataFrame) -> DataFrame:
        once = d.groupBy(block.alias("country"), text.alias("text")).agg(F.min("id").alias("id"))
        tf = once.select("id", "country", F.explode(grams(F.col("text"))).alias("key")).groupBy("id", "country", "key").agg(F.count(F.lit(1)).alias("tf"))
        norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(W.partitionBy("id")))
        return tf.select("id", "country", "key", "tf", norm.alias("norm"))

    def alike(d: DataFrame, name: str) -> DataFrame:
        return d.select(F.min("id").over(W.partitionBy(block, text)).alias(f"{name}_text"), F.col("id").alias(f"{name}_id"))

    tw = weights(t)
    hot = frequencies(tw).filter(F.col("df") > TARGETS_PER_TASK).select("country", "key", F.ceil(F.col("df") / TARGETS_PER_TASK).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    tw = tw.join(hot, ["country", "key"], "left").select("country", "key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("target_text"), F.col("tf").alias("ttf"), F.col("norm").alias("tnorm"))
    qw = weights(q).join(hot, ["country", "key"], "left").select("country", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").alias("query_text"), F.col("tf").alias("qtf"), F.col("norm").alias("qnorm"))
    both = qw.join(tw, ["country", "key", "part"]).groupBy("query_text", "target_text", "qnorm", "tnorm").agg(F.sum(F.col("qtf") * F.col("ttf")).alias("dot"))
    both = both.select("query_text", "target_text", (F.col("dot") / (F.col("qnorm") * F.col("tnorm"))).alias("score"))
    return both.join(alike(q, "query"), "query_text").join(alike(t, "target"), "target_text").select("query_id", "target_id", "score")


def two_pass_topk(q: DataFrame, t: DataFrame, k: int = 15, wide: int = 45, bonus: float = 0.5) -> DataFrame:
    """Grams within two kinds of block, the better score of the two, a bonus for a shared number, top k.

    Blocks: country with the first letter of the sorted name, and with the first four letters of the name without spaces.
    """
    name = F.array_join("toks", " ")
    passes = [gram_similarity(q, t, F.concat_ws("|", "country", b), name) for b in (F.substring(F.array_join(F.array_sort("toks"), " "), 1, 1), F.substring(F.replace(F.col("core"), F.lit(" "), F.lit("")), 1, 4))]
    best = top_k(passes[0].unionByName(passes[1]).groupBy("query_id", "target_id").agg(F.max("score").alias("score")), wide)
    both = best.join(q.select(F.col("id").alias("query_id"), F.col("nums").alias("qn")), "query_id").join(t.select(F.col("id").alias("target_id"), F.col("nums").alias("tn")), "target_id")
    scored = both.select("query_id", "target_id", F.col("score").alias("blocking_score"), (F.col("score") + F.when(F.arrays_overlap("qn", "tn"), bonus).otherwise(0.0)).alias("score"))
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best pairs of each query; ties by target."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), "target_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def training_candidates(q: DataFrame, t: DataFrame, truth: DataFrame, caps=(6, 4, 3)) -> DataFrame:
    """The truth and a few targets of each key: prefix, each token, number."""
    parts = [truth.select("query_id", "target_id")]
    for kind, n in zip(("prefix6", "token", "number"), caps, strict=True):
        few = postings(t, kind).withColumn("n", F.row_number().over(W.partitionBy("country", "key").orderBy("id"))).filter(F.col("n") <= n).drop("n")
        parts.append(_pairs(postings(q, kind), few))
    return union(*parts)


def every_pair(q: DataFrame, t: DataFrame) -> DataFrame:
    """All pairs of a country: for tests on small tables only."""
    return q.select("country", F.col("id").alias("query_id")).join(t.select("country", F.col("id").alias("target_id")), "country").select("query_id", "target_id")


def looked_up(pairs: DataFrame, q: DataFrame, t: DataFrame) -> DataFrame:
    """The pairs with both records as structs q and t.

    Pairs are a few bytes and what is done with them is dear, so they are dealt to as many tasks as a shuffle has,
    by query, before the records are looked up.
    """
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    pack = lambda d, name: d.select(F.col("id").alias(f"{name}_id"), F.struct(*d.columns).alias(name[0]))
    return pairs.join(merged(pack(q, "query")), "query_id").join(merged(pack(t, "target")), "target_id")


def labelled(pairs: DataFrame, truth: DataFrame, force: bool = False) -> DataFrame:
    """The pairs with label 1 if true; with ``force`` the true ones that are missing too, with numbers of 0."""
    own = pairs
    if force:
        numbers = [f.name for f in pairs.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
        more = truth.select("query_id", "target_id").distinct().join(pairs, ["query_id", "target_id"], "left_anti")
        own = pairs.unionByName(more.select("*", *(F.lit(0).cast(pairs.schema[n].dataType).alias(n) for n in numbers)), allowMissingColumns=True)
    marks = truth.select("query_id", "target_id").distinct().withColumn("label", F.lit(1))
    return own.join(marks, ["query_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
