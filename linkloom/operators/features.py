"""Pair features by name. Each feature is defined once; a set is a list of names.

Rows are pairs with structs q and t of records.feature_form() (blocking.looked_up()).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import similarity as S
from linkloom.functions import text as X

NAME_15 = ("name_token_sort", "name_token_set", "name_partial", "name_jw", "name_core_jw", "name_core_sort", "name_core_set", "name_exact_core", "name_exact_comp", "name_len_ratio", "name_len_diff", "name_token_jaccard", "name_tok_overlap_cnt", "name_qgram3_jaccard", "used_alt_name")
NAME_5 = ("name_soundex_jaccard", "name_initials_match", "name_partial_core", "name_leet_match", "name_comp_prefix_match")
CONFLICTS = ("addr_house_match", "addr_house_conflict", "addr_state_match", "addr_state_conflict", "addr_postal_match", "addr_postal_conflict", "addr_token_sort", "addr_token_set", "addr_token_jaccard")
PLACE = ("addr_city_match", "addr_target_empty", "addr_exact_full")
PREFIX = ("addr_postal_pfx_match", "addr_postal_pfx_conflict")
CROSS = ("name_x_addr", "core_x_addr_set", "name_jw_x_addr_state")
CROSS_7 = (*CROSS, "conf_agree", "hard_conflict", "name_high_addr_empty", "exact_name_soft_addr")
MORE = ("name_jw_x_postal", "core_sort_x_addr_sort", "name_diff_penalty")
MORPH = (*NAME_5, "name_abbreviation_match", "name_levenshtein_ratio", "name_levenshtein_core", "name_num_tok_match", "name_metaphone_sim", "name_comp_len_ratio")
LEAN = (*NAME_5, "name_abbreviation_match", "name_levenshtein_ratio", "name_num_tok_match", "name_comp_len_ratio")
ANCHORS = ("name_first_tok_match", "name_last_tok_match", "name_first_tok_jw")
DEEP = (*PREFIX, "addr_unit_match", "addr_unit_conflict", "addr_pobox_match", "addr_pobox_conflict")

#: Names of each set, and its similarity profile.
SETS: dict[str, tuple[tuple[str, ...], str]] = {
    "P1": (("name_jw", "name_token_sort", "name_token_set", "addr_token_sort", "name_exact_comp", "num_match", "name_token_jaccard", "name_len_diff"), "indel"),
    "P2": (("name_jw", "name_token_sort", "name_token_set", "addr_token_sort", "name_exact_comp", "num_match_signed", "name_token_jaccard", "name_len_diff"), "indel"),
    "P3": (("name_token_sort", "name_token_set", "name_partial", "name_nospace_partial", "name_exact_core", "used_alt_name", "name_len_ratio", "addr_house_match", "addr_state_match", "addr_token_sort", "addr_token_set", "addr_target_empty"), "indel"),
    "P4": (("name_token_sort", "name_token_set", "name_partial", "name_nospace_partial", "name_exact_core", "used_alt_name", "name_len_ratio", "addr_house_match", "addr_state_match", "addr_postal_match", "addr_token_sort", "addr_token_set", "addr_target_empty"), "indel"),
    "P7": ((*NAME_15, *CONFLICTS, "addr_target_empty", "name_x_addr", "core_x_addr_set"), "indel"),
    "P8": ((*NAME_15, *NAME_5, *CONFLICTS, *PLACE, *CROSS), "indel"),
    "P9": ((*NAME_15, *MORPH, *CONFLICTS, *PLACE, *CROSS), "indel"),
    "P10": ((*NAME_15, *MORPH, "name_char4gram_jaccard", "name_is_short_both", *CONFLICTS, *PLACE, "addr_tok_count_diff", "addr_city_state_combo", "addr_state_postal_agree", *CROSS, "conf_agree", "hard_conflict"), "indel"),
    "P11": ((*NAME_15, *MORPH, "name_char4gram_jaccard", *ANCHORS, *CONFLICTS, *PLACE, *DEEP, *CROSS_7), "indel"),
    "P12": ((*NAME_15, *MORPH, "name_char4gram_jaccard", *ANCHORS, *CONFLICTS, *PLACE, *DEEP, *CROSS_7, *MORE, "addr_exact_name_fuzzy", "both_empty_address"), "indel"),
    "P13": ((*NAME_15, *LEAN, "name_first_tok_match", "name_first_tok_jw", *CONFLICTS, *PLACE, *PREFIX, *CROSS_7, *MORE), "blocks"),
    "P14": ((*NAME_15, *LEAN, *CONFLICTS, *PLACE, *PREFIX, *CROSS_7, *MORE), "blocks"),
    "P15": ((*NAME_15, *LEAN, *ANCHORS, *CONFLICTS, *PLACE, *PREFIX, *CROSS_7, *MORE, "exact_comp_match_high"), "blocks"),
    "P16": ((*NAME_15, *LEAN, *CONFLICTS, *PLACE, *PREFIX, *CROSS_7), "blocks"),
}


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _registry(profile: str, empty: float, variants: bool = False, acronyms: bool = False) -> tuple[dict[str, tuple[str, Column, Column]], dict[str, Column], dict[str, Column]]:
    """String metrics for S.measured() by name, then features by name, in layers: a layer may use the names of those before it.

    ``empty`` is what conflicts are where an address is empty. With ``variants`` names are as similar as their best variants.
    With ``acronyms`` a name of one short word that begins the other's initials is an abbreviation by 0.9.
    """
    wanted: dict[str, tuple[str, Column, Column]] = {}

    def ask(kind: str, x: Column, y: Column) -> Column:
        name = f"metric{len(wanted)}_"
        wanted[name] = kind, x, y
        return F.col(name)

    q, t = (lambda f: F.col(f"q.n.{f}")), (lambda f: F.col(f"t.n.{f}"))
    a, b = (lambda f: F.col(f"q.a.{f}")), (lambda f: F.col(f"t.a.{f}"))
    end, scale = ("_blocks", 1.0) if profile == "blocks" else ("", 100.0)
    jw = "jaro_winkler" if profile == "blocks" else "jaro_winkler_above"
    metric = lambda kind, x, y: ask(kind + end, x, y) / scale
    both = lambda x, y: (x != "") & (y != "")
    core = lambda c: F.when(both(q("core"), t("core")), c).otherwise(0.0)
    equal = lambda x, y: _flag(both(x, y) & (x == y))
    ratio = lambda x, y: F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(0.0)
    no_addr = a("is_empty") | b("is_empty")
    addr = lambda c, x=0.5: F.when(no_addr, x).otherwise(c)
    agree = lambda x, y: addr(F.when(both(x, y), _flag(x == y)).otherwise(0.5))
    differ = lambda x, y: addr(_flag(both(x, y) & (x != y)), empty)
    lev = (lambda x, y: ask("blocks", x, y)) if profile == "blocks" else S.levenshtein
    house = S.house_similarity(a("house"), b("house"), ends=False)
    nums = lambda s: F.filter(F.col(f"{s}.a.tokens"), lambda w: w.rlike("^[0-9]+$"))
    shared = S.overlap(nums("q"), nums("t"))
    split = F.abs(q("n_words") - t("n_words")) >= 2
    flat = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    short = lambda x, y: x("core").rlike("^[a-z]{2,6}$") & y("initials").startswith(x("core"))
    first = {
        "name_token_sort": metric("token_sort", q("full"), t("full")), "name_token_set": metric("token_set", q("full"), t("full")),
        "name_partial": metric("partial", q("full"), t("full")), "name_nospace_partial": metric("partial", flat(q("full")), flat(t("full"))),
        "name_jw": ask(jw, q("full"), t("full")), "name_core_jw": core(ask(jw, q("core"), t("core"))),
        "name_core_sort": core(metric("token_sort", q("core"), t("core"))), "name_core_set": core(metric("token_set", q("core"), t("core"))),
        "name_partial_core": core(metric("partial", q("core"), t("core"))),
        "name_exact_core": equal(q("core"), t("core")), "name_exact_comp": equal(q("comp"), t("comp")),
        "name_len_ratio": ratio(F.length(q("full")), F.length(t("full"))), "name_len_diff": F.abs(F.length(q("full")) - F.length(t("full"))).cast("double"),
        "name_token_jaccard": S.jaccard(q("tokens"), t("tokens")), "name_tok_overlap_cnt": F.size(F.array_intersect(q("tokens"), t("tokens"))).cast("double"),
        "name_qgram3_jaccard": S.jaccard(q("qgrams"), t("qgrams")), "name_char4gram_jaccard": S.jaccard(q("grams4"), t("grams4")),
        "used_alt_name": _flag((q("dba_alt") != "") | (t("dba_alt") != "")), "name_soundex_jaccard": S.jaccard(q("soundex"), t("soundex")),
        "name_initials_match": equal(q("initials"), t("initials")), "name_leet_match": equal(q("leet"), t("leet")),
        "name_comp_prefix_match": _flag((F.length(q("comp")) >= 4) & (F.length(t("comp")) >= 4) & (F.substring(q("comp"), 1, 8) == F.substring(t("comp"), 1, 8))),
        "name_abbreviation_match": F.when(both(q("initials"), t("initials")) & (q("initials") == t("initials")) & split, 1.0).when(F.lit(acronyms) & (short(q, t) | short(t, q)), 0.9).otherwise(0.0),
        "name_levenshtein_ratio": F.when(both(q("full"), t("full")), lev(q("full"), t("full"))).otherwise(0.0), "name_levenshtein_core": core(lev(q("core"), t("core"))),
        "name_num_tok_match": F.when((F.size(q("num_tokens")) == 0) & (F.size(t("num_tokens")) == 0), 0.5).otherwise(_flag(q("num_tokens") == t("num_tokens"))),
        "name_metaphone_sim": ask("metaphone", F.substring_index(q("core"), " ", 1), F.substring_index(t("core"), " ", 1)),
        "name_comp_len_ratio": ratio(F.length(q("comp")), F.length(t("comp"))), "name_is_short_both": _flag((F.length(q("comp")) <= 4) & (F.length(t("comp")) <= 4)),
        "name_first_tok_match": equal(q("first"), t("first")), "name_last_tok_match": equal(q("last"), t("last")), "name_first_tok_jw": ask(jw + "?", q("first"), t("first")),
        "num_match": _flag(shared), "num_match_signed": F.when(shared, 1.0).when((F.size(nums("q")) > 0) & (F.size(nums("t")) > 0), -0.5).otherwise(0.0),
        "addr_house_match": addr(house), "addr_house_conflict": addr(_flag(both(a("house"), b("house")) & (house == 0)), empty),
        "addr_state_match": agree(a("state"), b("state")), "addr_state_conflict": differ(a("state"), b("state")),
        "addr_postal_match": agree(a("postal"), b("postal")), "addr_postal_conflict": differ(a("postal"), b("postal")),
        "addr_postal_pfx_match": agree(a("postal_pfx"), b("postal_pfx")), "addr_postal_pfx_conflict": differ(a("postal_pfx"), b("postal_pfx")),
        "addr_unit_match": agree(a("unit"), b("unit")), "addr_unit_conflict": differ(a("unit"), b("unit")),
        "addr_pobox_match": addr(_flag(a("po_box") & b("po_box"))), "addr_pobox_conflict": addr(_flag(a("po_box") != b("po_box")), empty),
        "addr_token_sort": addr(metric("token_sort", a("full"), b("full"))), "addr_token_set": addr(metric("token_set", a("full"), b("full"))),
        "addr_token_jaccard": addr(S.jaccard(a("tokens"), b("tokens"))),
        "addr_city_match": addr(F.when(both(a("city"), b("city")), _flag(a("city") == b("city"))).otherwise(0.5)),
        "addr_target_empty": _flag(b("is_empty")), "addr_exact_full": addr(_flag(a("full") == b("full")), 0.0), "both_empty_address": _flag(a("is_empty") & b("is_empty")),
        "addr_tok_count_diff": addr(F.least(F.lit(1.0), F.abs(a("n_words") - b("n_words")) / 10), 0.0),
    }
    if variants:
        x, y = (F.concat_ws(S.VARIANT, *(s(f) for f in ("full", "core", "leet", "dba_alt"))) for s in (q, t))
        first |= {f"name_{k}": ask(f"best_{k}", x, y) / 100.0 for k in ("token_sort", "token_set", "partial", "nospace_partial")} | {"used_alt_name": ask("best_is_alias", x, y)}
    f = F.col
    second = {
        "name_x_addr": f("name_token_sort") * f("addr_token_sort"), "core_x_addr_set": f("name_core_set") * f("addr_token_set"),
        "name_jw_x_addr_state": f("name_jw") * f("addr_state_match"), "conf_agree": f("name_token_sort") * f("addr_token_jaccard"),
        "hard_conflict": _flag((f("addr_state_conflict") == 1) & (f("addr_postal_conflict") == 1)),
        "name_high_addr_empty": _flag((f("name_jw") >= 0.9) & (f("addr_target_empty") == 1)),
        "exact_name_soft_addr": _flag((f("name_exact_core") == 1) & (f("addr_state_conflict") == 0) & (f("addr_house_conflict") == 0)),
        "name_jw_x_postal": f("name_jw") * f("addr_postal_match"), "core_sort_x_addr_sort": f("name_core_sort") * f("addr_token_sort"),
        "name_diff_penalty": f("name_len_diff") * (1 - f("name_token_sort")), "addr_exact_name_fuzzy": f("addr_exact_full") * f("name_token_sort"),
        "exact_comp_match_high": f("name_exact_comp") * f("addr_token_jaccard"),
        "addr_city_state_combo": F.when((f("addr_city_match") == 1) & (f("addr_state_match") == 1), 1.0).when((f("addr_city_match") == 0) & (f("addr_state_match") == 0), 0.0).otherwise(0.5),
        "addr_state_postal_agree": F.when((f("addr_state_match") == 1) & (f("addr_postal_match") == 1), 1.0).when((f("addr_state_conflict") == 1) | (f("addr_postal_conflict") == 1), 0.0).otherwise(0.5),
    }
    return wanted, first, second


def features(pairs: DataFrame, name: str = "P16") -> DataFrame:
    """(query_id, target_id, the features of a set): one projection, so each metric runs once a pair."""
    names, profile = SETS[name]
    wanted, first, second = _registry(profile, 0.0 if name == "P7" else 0.5, name in ("P3", "P4"), name in ("P9", "P10"))
    base = [n for n in names if n in first]
    cross = [n for n in names if n in second]
    if cross:
        base = list(dict.fromkeys([*base, "name_token_sort", "addr_token_sort", "name_core_set", "addr_token_set", "name_jw", "addr_state_match", "addr_token_jaccard", "addr_state_conflict", "addr_postal_conflict", "addr_target_empty", "name_exact_core", "addr_house_conflict", "addr_postal_match", "name_core_sort", "name_len_diff", "addr_exact_full", "name_exact_comp", "addr_city_match"]))
    used = {m for n in base for m in re.findall(r"metric[0-9]+_", str(first[n]))}
    if used:
        pairs = pairs.select("*", S.measured({m: wanted[m] for m in wanted if m in used}).alias("measured")).select("*", "measured.*")
    step = pairs.select("query_id", "target_id", *(first[n].alias(n) for n in base))
    return step.select("query_id", "target_id", *((second[n] if n in second else F.col(n)).alias(n) for n in names))


def staged_features(pairs: DataFrame) -> DataFrame:
    """The 21 features of the staged pipeline, on rule_form() structs, with the blocking score.

    A side that is written as a domain is compared with the other one's letters.
    """
    q, t = (lambda f: F.col(f"q.{f}")), (lambda f: F.col(f"t.{f}"))
    one = lambda c: c.cast("int")
    lev = S.levenshtein
    words = F.size(F.array_union(q("toks"), t("toks")))
    common = F.size(F.array_intersect(q("toks"), t("toks")))
    domain = X.domain_compact
    letters = lambda x: F.regexp_replace(X.without_legal(x), "[^a-z0-9]", "")
    mine = F.when(domain(q("name")) != "", domain(q("name"))).otherwise(letters(q("name")))
    other = F.when((domain(q("name")) != "") | (domain(t("name")) == ""), letters(t("name"))).otherwise(domain(t("name")))
    any_domain = (domain(q("name")) != "") | (domain(t("name")) != "")
    both = S.measured({"sort": ("token_sort", q("core"), t("core")), "set": ("token_set", q("core"), t("core"))})
    return pairs.select("*", both.alias("both")).select(
        "query_id", "target_id", F.col("blocking_score"), one(q("core") == t("core")).alias("exact_norm_match"), one(F.array_sort(q("toks")) == F.array_sort(t("toks"))).alias("exact_sorted_match"),
        F.col("both.sort").alias("token_sort_ratio"), F.col("both.set").alias("token_set_ratio"), lev(q("core"), t("core")).alias("lev_ratio"),
        *(S.gram_jaccard(q("core"), t("core"), n).alias(f"char{n}_jaccard") for n in (2, 3, 4)), F.abs(F.length(q("core")) - F.length(t("core"))).alias("len_char_diff"),
        F.abs(F.size(q("toks")) - F.size(t("toks"))).alias("len_token_diff"), common.alias("n_shared_tokens"), F.when(words > 0, common / words).otherwise(0.0).alias("token_overlap_ratio"),
        lev(q("nonum"), t("nonum")).alias("addr_text_lev_ratio"), one((F.size(q("nums")) > 0) & (q("nums") == t("nums"))).alias("addr_numbers_exact_match"),
        one(S.overlap(q("nums"), t("nums"))).alias("addr_numbers_any_overlap"), F.abs(F.size(q("nums")) - F.size(t("nums"))).alias("addr_numbers_count_diff"),
        one(q("country") == t("country")).alias("country_match"), one(q("latin") != t("latin")).alias("is_cross_script"),
        F.when(any_domain, S.gram_jaccard(mine, other, 3)).otherwise(0.0).alias("domain_match_score"), one(any_domain).alias("has_domain_signal"),
    )


def group_features(scored: DataFrame, score: str = "score") -> DataFrame:
    """Rank, maximum, mean, deviation, count, margin to the next and share of the maximum, over a query's pairs."""
    whole = W.partitionBy("query_id")
    order = whole.orderBy(F.desc(score), "target_id")
    top = F.max(score).over(whole)
    return scored.select(
        "*", F.row_number().over(order).alias("rank_in_query"), top.alias("query_max"), F.avg(score).over(whole).alias("query_mean"),
        F.coalesce(F.stddev_samp(score).over(whole), F.lit(0.0)).alias("query_std"), F.count(F.lit(1)).over(whole).alias("query_count"),
        (F.col(score) - F.coalesce(F.lead(score).over(order), F.lit(0.0))).alias("margin_to_next"), F.when(top != 0, F.col(score) / top).otherwise(1.0).alias("share_of_max"),
    )


def hard_rejected() -> Column:
    """State and postal code conflict, or house and state do (by name, as inference means it)."""
    s, p, h = (F.col(f"addr_{x}_conflict") == 1 for x in ("state", "postal", "house"))
    return (s & p) | (h & s)
