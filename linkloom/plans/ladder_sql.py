"""SQL of the string metrics and decision ladders, for DuckDB: what the queries on rules.evidence() are held against.

``indel`` similarity is said with the longest common subsequence of two texts, found with one bit a character of the first (62
characters at most, which the views' names keep). Of two texts that begin alike it is the beginning and that of the rests,
so that token sets need it for their differing words only.
"""

from __future__ import annotations

from linkloom.functions import constants as K

_STEP = "lambda v, k: ((v + (v & k)) | (v - (v & k))) & ((1::BIGINT << length({a})) - 1)"
#: With the positions of each character of ``a`` worked out on the way, and with a map of them.
_LCS = "(length({a}) - bit_count(list_reduce(list_prepend((1::BIGINT << length({a})) - 1, list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(string_split({a}, ''), lambda d, i: CASE WHEN d = c THEN 1::BIGINT << (i - 1)::BIGINT ELSE 0::BIGINT END))::BIGINT)), " + _STEP + ")))"
_LCS_BY = "(length({a}) - bit_count(list_reduce(list_prepend((1::BIGINT << length({a})) - 1, list_transform(string_split({b}, ''), lambda c: coalesce({m}[c], 0::BIGINT))), " + _STEP + ")))"
_PLACES = "map_from_entries(list_transform(list_distinct(string_split({a}, '')), lambda d: {{'k': d, 'v': list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = d THEN 1::BIGINT << (i - 1)::BIGINT ELSE 0 END))::BIGINT}}))"
_SORTED = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"
_WORDS = "list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '')))"
_NUMBER = r"lambda n: regexp_replace(n, '^0+([0-9])', '\1')"
_ZIP = r"CASE WHEN country = 'India' THEN regexp_extract(raw_addr, '\b([1-9][0-9]{5})\b', 1) ELSE regexp_extract(raw_addr, '\b([0-9]{5})\b', 1) END"


def _state() -> str:
    fifty = ", ".join(f"'{s}'" for s in K.US_STATES if s != "dc")
    india = " ".join(rf"WHEN regexp_matches(lower(raw_addr), '\b{n}\b') THEN '{s}'" for n, s in K.INDIA_STATE_CODES.items())
    us = rf"upper(list_filter(regexp_extract_all(lower(raw_addr), '\b[a-z]{{2}}\b'), lambda w: w IN ({fifty}))[-1])"
    return f"CASE WHEN country = 'India' THEN CASE {india} END WHEN country = 'US' THEN {us} END"


def _side(name: str, places: bool) -> str:
    texts = {"n": "name", "c": "core", "a": "addr"}
    cols = [f"{_SORTED.format(x=f)} AS s{k}" for k, f in texts.items()] + [f"{_WORDS.format(x=f)} AS w{k}" for k, f in {**texts, "s": "nonum"}.items()]
    inner = f"SELECT *, {', '.join(cols)}, {_ZIP} AS zip, {_state()} AS state FROM {name}"
    more = [f"{_PLACES.format(a=f's{k}')} AS m{k}" for k in texts] if places else []
    more.append(rf"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(raw_addr, '\b[0-9]+\b'), lambda n: n <> zip AND length(n) < 7), {_NUMBER}))) AS snums")
    return f"{name}x AS MATERIALIZED (SELECT *, {', '.join(more)} FROM ({inner}))"


def _sort(k: str, f: str) -> str:
    return f"CASE WHEN q.{f} = '' OR t.{f} = '' THEN 0::DOUBLE ELSE 200.0::DOUBLE * {_LCS_BY.format(a=f'q.s{k}', b=f't.s{k}', m=f'q.m{k}')} / (length(q.s{k}) + length(t.s{k})) END"


def _set(k: str) -> str:
    lcs = _LCS.format(a=f"x{k}", b=f"y{k}")
    left, right = (f"(length(b{k}) + 1 + length({s}{k}))" for s in "xy")
    shared = f"greatest(200.0::DOUBLE * (length(b{k}) + 1 + {lcs}) / ({left} + {right}), 200.0::DOUBLE * length(b{k}) / (length(b{k}) + {left}), 200.0::DOUBLE * length(b{k}) / (length(b{k}) + {right}))"
    return f"CASE WHEN b{k} = '' AND (x{k} = '' OR y{k} = '') THEN 0::DOUBLE WHEN b{k} <> '' AND (x{k} = '' OR y{k} = '') THEN 100::DOUBLE WHEN b{k} <> '' THEN {shared} ELSE 200.0::DOUBLE * {lcs} / (length(x{k}) + length(y{k})) END"


def _parts(k: str) -> str:
    both = f"list_filter(q.w{k}, lambda w: list_contains(t.w{k}, w))"
    rest = lambda a, b: f"list_filter({a}.w{k}, lambda w: NOT list_contains({b}.w{k}, w))"
    return f"array_to_string({both}, ' ') AS b{k}, array_to_string({rest('q', 't')}, ' ') AS x{k}, array_to_string({rest('t', 'q')}, ' ') AS y{k}"


_SHARED = "len(list_intersect({a}, {b}))"
_JACCARD = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0::DOUBLE END"
_APART = "(len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) = 0)"
_NEAR = "len(list_filter(q.snums, lambda x: len(list_filter(t.snums, lambda y: (length(x) >= 3 AND contains(y, x)) OR (length(y) >= 3 AND contains(x, y)))) > 0)) > 0"
_RATIO = "200.0::DOUBLE * " + _LCS.format(a="x", b="y") + " / (length(x) + length(y))"
_ANY = "len(list_filter(q.nums, lambda x: len(list_filter(t.nums, lambda y: {test})) > 0)) > 0"
_IN = "(contains(x, y) OR contains(y, x))"
_TYPO = _ANY.format(test=f"length(x) >= 2 AND length(y) >= 2 AND ({_IN} OR abs(length(x) - length(y)) <= 1 OR {_RATIO} >= 66)")
_NEAR_TYPO = _ANY.format(test=f"length(x) >= 2 AND length(y) >= 2 AND ({_IN} OR abs(length(x) - length(y)) <= 1) AND {_RATIO} >= 66")
_PART = _ANY.format(test=f"least(length(x), length(y)) >= 3 AND ({_IN} OR {_RATIO} >= 75)")
_LETTERS = r"list_distinct(regexp_extract_all({s}.addr, '\b[a-z]{{2,}}\b'))"

#: ``ev``: every pair of ``cand`` with its evidence; goes after the common tables ``q``, ``t`` and a ``cand``.
EVIDENCE = [
    _side("q", True),
    _side("t", False),
    f"""ev0 AS (SELECT query_id, target_id, {_sort("n", "name")} AS name_sort, {_sort("c", "core")} AS core_sort, {_sort("a", "addr")} AS addr_sort,
      {", ".join(map(_parts, "ncas"))}, q.comp <> '' AND q.comp = t.comp AS same_comp, len(list_intersect(q.nums, t.nums)) > 0 AS num_agree, {_APART.format(a="q.nums", b="t.nums")} AS num_conflict,
      (q.zip <> '' AND t.zip <> '' AND q.zip <> t.zip) OR ({_APART.format(a="q.snums", b="t.snums")} AND NOT {_NEAR}) AS smart_conflict, {_APART.format(a="q.post", b="t.post")} AS post_conflict,
      coalesce(q.state <> t.state, false) AS state_conflict, {_SHARED.format(a="q.toks", b="t.toks")} AS shared, q.addr = '' AS q_no_addr, t.addr = '' AS t_no_addr,
      NOT regexp_matches(t.raw_name, '[^\\x00-\\xFF]') AS t_latin, q.country = 'India' AS india, {_JACCARD.format(a="q.ntoks", b="t.ntoks")} AS name_jac, {_JACCARD.format(a="q.atoks", b="t.atoks")} AS addr_jac,
      length(q.core) AS q_core_n, t.core = '' AS bare_core, len(t.toks) AS t_toks_n, length(q.addr) AS q_addr_n, len(t.atoks) AS t_atoks_n, {_TYPO} AS typo, {_NEAR_TYPO} AS near_typo, {_PART} AS num_part,
      len(list_intersect(q.post, t.post)) > 0 AS post_agree, {_JACCARD.format(a="q.toks", b="t.toks")} AS toks_jac, {_JACCARD.format(a=_LETTERS.format(s="q"), b=_LETTERS.format(s="t"))} AS letters_jac
    FROM cand JOIN qx q ON q.id = query_id JOIN tx t ON t.id = target_id)""",
    f"""ev AS MATERIALIZED (SELECT *, greatest(core_sort, core_set) AS core, greatest(addr_sort, addr_set) AS addr, q_no_addr OR t_no_addr AS no_addr
      FROM (SELECT *, {_set("n")} AS name_set, {_set("c")} AS core_set, {_set("a")} AS addr_set, {_set("s")} AS street_sim FROM ev0))""",
]

PUBLIC = "name_sort, name_set, core_sort, core_set, addr_sort, addr_set, street_sim, same_comp, num_agree, num_conflict, smart_conflict, post_conflict, state_conflict, shared, q_no_addr, t_no_addr, t_latin, india, name_jac, addr_jac"

_STRIKE = "name_sort * 0.6::DOUBLE + addr_sort * 0.4::DOUBLE"
_ROOT = "no_addr OR street_sim >= {0} OR num_agree OR core_sort >= {1}"


def _recall_sql(strong: tuple, subset: tuple, moderate: tuple, script: tuple, street: tuple) -> list[tuple[str, str, str]]:
    return [
        ("same_comp", "true", "1.0"), (f"name_sort >= {strong[0]} AND (addr_sort >= {strong[1]} OR num_agree OR t_no_addr)", "true", "0.9::DOUBLE + name_sort / 100"),
        (f"name_set >= {subset[0]} AND name_sort >= {subset[1]} AND (addr_sort >= {subset[2]} OR num_agree)", "true", "0.85::DOUBLE + name_set / 100"),
        (f"name_sort >= {moderate[0]} AND (addr_sort >= {moderate[1]} OR (num_agree AND addr_sort >= 35))", "true", "0.8::DOUBLE + addr_sort / 100"),
        (f"NOT t_latin AND india AND (addr_sort >= {script[0]} OR (num_agree AND addr_sort >= {script[1]}))", "true", "0.78::DOUBLE + addr_sort / 100"),
        (f"num_agree AND addr_sort >= {street[0]} AND name_sort >= {street[1]}", "true", "0.72::DOUBLE + addr_sort / 100"),
    ]


def _resolver_sql(exact: tuple, script: tuple, street: tuple, high: tuple, both: tuple) -> list[tuple[str, str, str]]:
    return [
        ("same_comp", _ROOT.format(*exact), "1.0"), ("NOT t_latin AND india", f"num_agree AND (street_sim >= {script[0]} OR addr_sort >= {script[1]})", "0.95"),
        (f"num_agree AND street_sim >= {street[0]} AND (core_sort >= {street[1]} OR shared >= 1)", "true", "0.9::DOUBLE + 0.1::DOUBLE * core_sort / 100"),
        (f"core_sort >= {high[0]} AND (num_agree OR street_sim >= {high[1]} OR no_addr)", "true", "0.85::DOUBLE + 0.15::DOUBLE * core_sort / 100"),
        (f"core_sort >= {both[0]} AND (num_agree OR street_sim >= {both[1]})", "true", "0.8"),
    ]


_PRECISE = [
    ("same_comp", "no_addr OR street_sim >= 20 OR num_agree", "100"), ("(num_agree OR street_sim >= 85) AND addr >= 60 AND street_sim >= 65", "core >= 30 OR bare_core OR shared >= 1 OR t_toks_n <= 1", "90 + 0.1::DOUBLE * addr"),
    ("addr >= 75 AND q_addr_n > 15 AND (core >= 35 OR bare_core OR shared >= 1)", "true", "85 + 0.1::DOUBLE * addr"), ("core >= 80", "CASE WHEN no_addr THEN shared >= 1 OR q_core_n >= 8 ELSE addr >= 25 OR num_agree OR street_sim >= 40 END", "80 + 0.1::DOUBLE * core"),
    ("t_no_addr AND shared >= 2 AND core >= 65", "true", "78"), ("core >= 50 AND (addr >= 50 OR num_agree OR street_sim >= 65)", "true", "75 + 0.1::DOUBLE * core"),
]
_SMART = "NOT state_conflict AND NOT smart_conflict"
_KEPT = "(NOT num_conflict OR (core >= {0} AND street_sim >= 75 AND {1}))"

#: Branches, gate, most matches, whether a branch that holds is final, and the order of matches.
LADDERS: dict[str, tuple[list[tuple[str, str, str]], str, int, bool, str]] = {
    "R5": ([("same_comp", "true", "1.0"), ("name_jac >= 0.5 AND (addr_jac >= 0.12 OR num_agree OR t_atoks_n = 0)", "true", "0.85::DOUBLE + name_jac + addr_jac"), ("name_jac >= 0.3 AND (addr_jac >= 0.25 OR num_agree)", "true", "0.78::DOUBLE + addr_jac"),
            ("NOT t_latin AND india AND (addr_jac >= 0.4 OR (num_agree AND addr_jac >= 0.25))", "true", "0.88::DOUBLE + addr_jac"), ("num_agree AND addr_jac >= 0.55", "true", "0.72::DOUBLE + addr_jac")], "true", 5, True, "score DESC, target_id"),
    "R6": (_recall_sql((70, 40), (85, 50, 35), (55, 55), (55, 35), (65, 0)), "true", 8, True, "score DESC, target_id"),
    "R8": ([("same_comp", "true", "1.0"), ("name_sort >= 70 AND (addr_sort >= 40 OR num_agree OR t_no_addr)", "true", _STRIKE), ("name_sort >= 55 AND addr_sort >= 75 AND num_agree", "true", _STRIKE), ("name_sort >= 85", "true", _STRIKE)], "NOT num_conflict", 4, True, "score DESC, target_id"),
    "R9": ([("same_comp", "no_addr OR addr_sort >= 25 OR NOT num_conflict", "0.98"), ("name_sort >= 88", "NOT num_conflict OR addr_sort >= 50 OR t_no_addr", "0.93"), ("name_sort >= 70 AND NOT num_conflict", "addr_sort >= 35 OR num_agree OR t_no_addr", "0.82"),
            ("(NOT t_latin OR name_sort < 50) AND NOT num_conflict", "addr_sort >= 60 OR (num_agree AND addr_sort >= 40)", "0.78"), ("addr_sort >= 75 AND NOT num_conflict AND name_sort >= 35", "true", "0.75")], "NOT post_conflict", 4, True, "score DESC, target_id"),
    "R10": ([("same_comp", "NOT num_conflict AND (no_addr OR addr_sort >= 25 OR num_agree OR post_agree)", "100 + addr_sort * 0.1::DOUBLE"), ("name_sort >= 88", "(NOT num_conflict OR addr_sort >= 50 OR t_no_addr) AND (addr_sort >= 30 OR num_agree OR t_no_addr)", _STRIKE),
             ("name_sort >= 70 AND NOT num_conflict", "addr_sort >= 35 OR num_agree OR t_no_addr", _STRIKE), ("(NOT t_latin OR name_sort < 50) AND NOT num_conflict", "addr_sort >= 60 OR (num_agree AND addr_sort >= 40)", "addr_sort"),
             ("addr_sort >= 75 AND NOT num_conflict AND name_sort >= 35", "true", "addr_sort * 0.7::DOUBLE + name_sort * 0.3::DOUBLE")], "NOT post_conflict", 4, True, "score DESC, target_id"),
    "R11": (_PRECISE, f"NOT state_conflict AND NOT post_conflict AND {_KEPT.format(65, 'typo')}", 4, True, "score DESC, target_id"),
    "R12": ([(a, b, str(n)) for (a, b, _), n in zip(_PRECISE, (100, 90, 85, 80, 78, 75), strict=True)], f"NOT state_conflict AND {_KEPT.format(65, 'typo')}", 4, False, "score DESC, target_id"),
    "R13": ([("same_comp", "no_addr OR street_sim >= 25 OR num_agree", "100"), ("num_agree AND addr >= 60 AND street_sim >= 65", "true", "90"), ("addr >= 82 AND q_addr_n > 20 AND (core >= 40 OR bare_core OR shared >= 1)", "true", "85"),
             ("core >= 82", "CASE WHEN no_addr THEN shared >= 1 ELSE addr >= 25 OR num_agree OR street_sim >= 45 END", "80"), ("core >= 65 AND (addr >= 50 OR num_agree OR street_sim >= 65)", "true", "75")], _KEPT.format(75, "near_typo"), 4, False, "score DESC, target_id"),
    "R14": (_resolver_sql((20, 60), (60, 55), (68, 40), (85, 30), (70, 75)), _SMART, 4, True, "score DESC, core_sort DESC, target_id DESC"),
    "R15": ([("same_comp", _ROOT.format(15, 50), "1.0"), ("NOT t_latin AND india", "num_agree AND (street_sim >= 55 OR addr_sort >= 50)", "0.95"), ("no_addr AND (core_set >= 90 OR core_sort >= 80)", "true", "0.88"),
             ("num_agree AND street_sim >= 65 AND (core_sort >= 35 OR core_set >= 65 OR shared >= 1)", "true", "0.9::DOUBLE + 0.1::DOUBLE * greatest(core_sort, street_sim) / 100"), ("street_sim >= 85 AND (core_sort >= 50 OR core_set >= 70)", "true", "0.86"),
             ("core_sort >= 85 AND (num_agree OR street_sim >= 25)", "true", "0.85"), ("core_set >= 92 AND (num_agree OR street_sim >= 60)", "true", "0.82")], _SMART, 4, True, "score DESC, greatest(core_sort, street_sim) DESC, target_id DESC"),
    "R16": (_resolver_sql((15, 45), (50, 45), (55, 35), (80, 25), (65, 65)), _SMART, 4, True, "score DESC, target_id"),
    "R17": (_resolver_sql((20, 50), (60, 55), (65, 40), (85, 30), (72, 75)), _SMART, 5, True, "core_sort DESC, target_id DESC"),
    "R17a": ([("letters_jac >= 0.5 OR (num_agree AND letters_jac >= 0.28) OR toks_jac >= 0.7 OR (letters_jac >= 0.35 AND toks_jac >= 0.35)", "true", "greatest(letters_jac, toks_jac)")], _SMART, 5, True, "score DESC, target_id DESC"),
}


def score(name: str, branches: list[tuple[str, str, str]] | None = None, gate: str | None = None) -> str:
    """The ladder's score, null where a pair is gated or takes no branch."""
    own, own_gate, _, final, _ = LADDERS[name]
    cases = "".join(f" WHEN ({a}) AND ({b}) THEN ({s})::DOUBLE" + (f" WHEN {a} THEN NULL" if final else "") for a, b, s in branches or own)
    return f"CASE WHEN NOT ({gate or own_gate}) THEN NULL{cases} END"


def run(name: str, table: str) -> str:
    """A common table of the ladder's matches: query_id, target_id, score, rank."""
    most, order = LADDERS[name][2], LADDERS[name][4]
    return f"{table} AS MATERIALIZED (SELECT query_id, target_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM (SELECT *, {score(name)} AS score FROM ev) WHERE score IS NOT NULL) WHERE rank <= {most})"


#: What the consensus rules ask of ``a`` and ``b``, runs of two ladders.
STRICT = "same_comp OR core_sort >= 45 OR (num_agree AND street_sim >= 60 AND core_sort >= 30)"
WIDE = "same_comp OR (NOT t_latin AND india AND num_agree AND street_sim >= 60) OR (num_agree AND street_sim >= 75 AND core_sort >= 55) OR (core_sort >= 85 AND (num_agree OR street_sim >= 40 OR t_no_addr))"
_PARTS = "(NOT num_conflict OR (street_sim >= 80 AND {0} AND num_part))"
_NAMED = "(NOT t_no_addr OR core_sort >= 80 OR (shared >= 2 AND core >= 75) OR same_comp)"
CONSENSUS = {
    "clean": ("NOT state_conflict AND NOT num_conflict", "NOT state_conflict AND NOT num_conflict", "true", 2),
    "validated": (_SMART, _SMART, STRICT, 3),
    "recovering": (f"NOT state_conflict AND {_PARTS.format('core_sort >= 65')}", f"NOT state_conflict AND NOT post_conflict AND {_PARTS.format('(core_sort >= 65 OR shared >= 2)')} AND {_NAMED} AND (NOT t_latin OR core_sort >= 40 OR shared > 0)", WIDE, 4),
}


def preferred(name: str) -> list[str]:
    """Common tables of a consensus: by query what both have, else all of a, else what of b is good; the last is ``chosen``."""
    gate_a, gate_b, good, from_b = CONSENSUS[name]
    return [
        f"ga AS (SELECT query_id, target_id, rank AS ra FROM run_1 JOIN ev USING (query_id, target_id) WHERE {gate_a})",
        f"gb AS (SELECT query_id, target_id, rank AS rb, {good} AS good FROM run_2 JOIN ev USING (query_id, target_id) WHERE {gate_b})",
        "gl AS (SELECT *, max(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 3 WHEN ra IS NOT NULL THEN 2 ELSE 1 END) OVER (PARTITION BY query_id) AS level FROM ga FULL JOIN gb USING (query_id, target_id))",
        "gk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(ra, rb), target_id) AS rank FROM gl WHERE (level = 3 AND ra IS NOT NULL AND rb IS NOT NULL) OR (level = 2 AND ra IS NOT NULL) OR (level = 1 AND good))",
        f"chosen AS (SELECT query_id, target_id, rank FROM gk WHERE rank <= 4 AND (level > 1 OR rank <= {from_b}))",
    ]
