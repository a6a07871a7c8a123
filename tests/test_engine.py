"""The linkage engine: literal cases, properties, and every SQL oracle that is quick."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.functions import address as A
from linkloom.functions import similarity as S
from linkloom.functions import text as X
from linkloom.operators import blocking, consensus, decide, features, learn, metrics, records, rules
from linkloom.plans import registry
from linkloom.sources import tables
from linkloom.streaming import scoring

QUICK = ("link_names", "name_forms", "address_forms", "token_frequency", "pool_size", "leet_by_frequency", "block_rarest", "block_places", "block_jaccard_prefix", "set_evidence", "rule_R2", "decide_closed_form", "consensus_else_second", "metric_macro", "metric_grid", "sink_matches", "rule_R11", "rule_R13", "rule_R15", "rule_R17", "kept_candidates", "consensus_recovering", "block_staged", "block_locality", "metric_missed_whole", "metric_baselines")


@pytest.mark.parametrize("name", QUICK)
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{sf_dir}/part.parquet'")
    want, got = con.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    want, got = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_flagship(spark, sf_dir):
    out = registry.entry(spark, sf_dir)
    assert out.columns == ["query_id", "target_ids"] and out.count() == 200


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("  Smart   Développement, INC ", "smart developpement"), ("A & B Private Limited", "a & b"), (None, "")])
def test_core_name(spark, text, want):
    assert one(spark, X.without_legal(X.clean(X.ascii_fold(F.coalesce("n", F.lit(""))))), n=text).strip(" ,") == want


def test_names(spark):
    assert one(spark, X.compressed(F.col("n")), n="Foo corpinc") == "foocorp"  # one pass: corp was asked before inc
    assert one(spark, X.leet(F.col("n")), n="5mart m00re") == "smart moore"
    assert one(spark, F.array_join(X.leet_words(F.split("n", " ")), " "), n="5mart 12a 100") == "smart 12a 100"
    assert one(spark, X.alias(F.col("n")), n="Acme Foods DBA: Tasty Corp") == "tasty"
    assert one(spark, X.before_alias(F.col("n")), n="DB Associates") == "DB Associates"
    assert one(spark, X.script(F.col("n")), n="नमस्ते ab") == "devanagari"
    assert one(spark, X.any_script(F.col("n")), n="नमस्ते Café") == "namaste Cafe"
    assert one(spark, X.is_latin(F.col("n")), n="Été") and not one(spark, X.is_latin(F.col("n")), n="ক")
    assert one(spark, X.domain_compact(F.col("n")), n="www.big-shop.co.in") == "wwwbigshopco" and one(spark, X.domain_compact(F.col("n")), n="big shop") == ""
    assert one(spark, X.digits_for_words(F.col("n")), n="first one of seven") == "1 1 of 7"
    assert X.kernel_soundex_of("ashcraft") == "A226" and X.metaphone_of("knight") == X.metaphone_of("night")


def test_addresses(spark):
    raw = "Unit 4B, 0337 Main St, Fl 2, Austin TX 78701"
    assert one(spark, A.numbers(F.lower("a")), a=raw) == ["2", "337", "78701"]
    assert one(spark, A.state_code(F.col("a"), F.lit("US")), a=raw) == "TX"
    assert one(spark, A.state_code(F.col("a"), F.lit("India")), a="12 MG Road, Karnataka 560001") == "KA"
    assert one(spark, A.street_numbers(F.col("a"), F.lit("India")), a="12 MG Road 560001 ph 9876543210") == ["12"]
    assert one(spark, A.postal_codes(F.col("a"), F.lit("France")), a="1 rue X 75001") == ["75001"]
    assert one(spark, A.state_name(F.col("a"), F.lit("India")), a="10 road or") == "odisha"
    assert one(spark, A.state_name(F.col("a"), F.lit("US")), a="10 road or") == "oregon"
    assert one(spark, A.unit(F.col("a")), a=raw) == "4b" and one(spark, A.has_po_box(F.col("a")), a="P.O. Box 7")
    assert one(spark, A.split_numbers(F.col("a")), a="##20 Oak, 0337")["numbers"] == ["20", "337"]


def test_similarities():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert S.common_subsequence(a, b) == table[-1][-1]
        assert S.jaro_winkler(a, b, 0.7) == pytest.approx(duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) or not (a and b)
    assert (S.blocks("tide", "diet"), S.blocks("diet", "tide"), S.blocks("", "")) == (0.25, 0.5, 1.0)
    assert S.token_set("b g exchange", "b g") == 100 and S.token_sort("x y", "y x") == 100 and S.partial("main st", "337 main st apt") == 100


def test_number_rules(spark):
    row = spark.createDataFrame([(["870"], ["8706"], ["12"], ["99"], "", "")], "a array<string>, b array<string>, c array<string>, d array<string>, p string, r string")
    got = row.select(S.number_conflict(F.col("a"), F.col("p"), F.col("b"), F.col("r")), S.number_conflict(F.col("c"), F.col("p"), F.col("d"), F.col("r")), S.plain_conflict(F.col("a"), F.col("b")), S.number_typo(F.col("a"), F.col("b"))).first()
    assert tuple(got) == (False, True, True, True)


SIZES = {"P1": 8, "P2": 8, "P3": 12, "P4": 13, "P7": 27, "P8": 35, "P9": 41, "P10": 48, "P11": 55, "P12": 60, "P13": 50, "P14": 48, "P15": 52, "P16": 45}


def test_feature_sets(spark):
    assert {k: len(v[0]) for k, v in features.SETS.items()} == SIZES
    rows = [("S1", "Smart Tools LLC", "12 Oak St Austin TX 78701", "US"), ("T1", "5mart tools", "12 Oak St Austin TX 78701", "US"), ("T2", "Other", "", "US")]
    d = records.feature_form(spark.createDataFrame(rows, tables.RECORD))
    q, t = d.filter("id LIKE 'S%'"), d.filter("id LIKE 'T%'")
    out = {r.target_id: r for r in features.features(blocking.looked_up(blocking.every_pair(q, t), q, t)).collect()}
    assert out["T1"].addr_postal_match == 1 and out["T1"].addr_exact_full == 1 and out["T1"].name_exact_core == 0
    assert out["T2"].addr_target_empty == 1 and out["T2"].addr_state_conflict == 0.5
    p7 = features.features(blocking.looked_up(blocking.every_pair(q, t), q, t), "P7").filter("target_id = 'T2'").first()
    assert p7.addr_state_conflict == 0


CASES = [
    ("closed_form", [0.4], 0), ("closed_form", [0.95, 0.15], 1), ("closed_form", [0.95, 0.9, 0.1], 2), ("mean_tail", [0.25, 0.15, 0.08], 0), ("mean_tail", [0.96, 0.2, 0.1], 1),
    ("mean_tail", [0.98, 0.95, 0.89, 0.35, 0.15], 3), ("exact", [0.05, 0.03, 0.02], 0), ("exact", [0.97, 0.15, 0.08, 0.04], 1), ("exact", [0.95, 0.93, 0.9, 0.35, 0.2], 3),
    ("closed_form", [0.97, 0.63, 0.44, 0.22], 2), ("mean_tail", [0.97, 0.63, 0.44, 0.22], 1), ("exact", [0.97, 0.63, 0.44, 0.22], 1), ("mean_tail", [0.83, 0.57, 0.42], 2), ("exact", [0.83, 0.57, 0.42], 1),
]


@pytest.mark.parametrize("rule", ["closed_form", "mean_tail", "exact"])
def test_selection_cases(spark, rule):
    cases = [c for c in CASES if c[0] == rule]
    rows = [(f"q{i}", f"t{j}", p) for i, (_, ps, _) in enumerate(cases) for j, p in enumerate(ps)]
    got = getattr(decide, rule)(spark.createDataFrame(rows, "query_id string, target_id string, p double")).groupBy("query_id").count().collect()
    got = {r.query_id: r["count"] for r in got}
    assert [got.get(f"q{i}", 0) for i in range(len(cases))] == [k for _, _, k in cases]


def test_exact_selection_against_enumeration(spark):
    r = random.Random(1)
    many = [[round(r.random(), 3) for _ in range(r.randint(1, 6))] for _ in range(12)]
    rows = [(f"q{i:02}", f"t{j}", p) for i, ps in enumerate(many) for j, p in enumerate(ps)]
    got = {x.query_id: x["count"] for x in decide.exact(spark.createDataFrame(rows, "query_id string, target_id string, p double")).groupBy("query_id").count().collect()}
    for i, ps in enumerate(many):
        ps = sorted(ps, reverse=True)

        def f(k, ps=ps):
            total = 0.0
            for truth in itertools.product((0, 1), repeat=len(ps)):
                w = math.prod(p if y else 1 - p for p, y in zip(ps, truth, strict=True))
                tp, n = sum(truth[:k]), sum(truth)
                total += w * (1.0 if not k and not n else 1.25 * tp / (0.25 * n + k) if k else 0.0)
            return total

        best = max(range(len(ps) + 1), key=lambda k: (round(f(k), 12), -k))
        assert got.get(f"q{i:02}", 0) == best


def test_siblings_and_rejection(spark):
    d = spark.createDataFrame([("a", "x", 0.9, False), ("a", "y", 0.6, True), ("a", "z", 0.55, False), ("b", "x", 0.95, True), ("b", "y", 0.9, False)], "query_id string, target_id string, p double, no boolean")
    assert decide.base_sibling(d, 0.8, 0.5).count() == 5
    assert [(r.query_id, r.target_id) for r in decide.base_sibling_rejecting(d, 0.8, 0.5, F.col("no")).orderBy("rank").collect()] == [("a", "x"), ("a", "z")]


def test_metric_example(spark):
    pair = "query_id string, target_id string"
    truth = spark.createDataFrame([("q", "S2-00047"), ("q", "S3-00812"), ("m", "t")], pair)
    predicted = spark.createDataFrame([("q", "S2-00047"), ("q", "S2-00193"), ("q", "S3-00812"), ("s", "t")], pair)
    queries = spark.createDataFrame([("q",), ("m",), ("s",), ("n",)], "query_id string")
    got = {r.query_id: r for r in metrics.by_query(predicted, truth, queries).collect()}
    assert round(got["q"].f, 3) == 0.714 and (got["m"].f, got["s"].f, got["n"].f) == (0, 0, 1)
    m = metrics.macro(predicted, truth, queries).first()
    assert (m.queries, m.singletons, m.false_alarms) == (4, 2, 1)


def test_ladder_and_consensus(spark):
    rows = [("S1", "Acme Tools LLC", "12 Oak Street", "US"), ("T1", "acme tools", "12 Oak Street", "US"), ("T2", "Acme Tools Inc", "99 Elm Road", "US"), ("T3", "Zeta", "12 Oak Street", "US")]
    d = records.rule_form(spark.createDataFrame(rows, tables.RECORD))
    q, t = d.filter("id LIKE 'S%'"), d.filter("id LIKE 'T%'")
    own = rules.evidence(blocking.looked_up(blocking.every_pair(q, t), q, t), True)
    found = {r: {x.target_id for x in rules.by_ladder(own, r).collect()} for r in rules.LADDERS}
    assert all("T1" in x for x in found.values()) and all("T2" not in found[r] for r in ("R8", "R11", "R12", "R14"))
    runs = [spark.createDataFrame(x, "query_id string, target_id string, rank int") for x in ([("S1", "T1", 1)], [("S1", "T3", 1), ("S1", "T1", 2)], [("S1", "T3", 1)])]
    assert [r.target_id for r in consensus.ordered_union(runs[0], runs[1]).orderBy("rank").collect()] == ["T1", "T3"]
    assert [(r.target_id, r.votes) for r in consensus.majority(runs).orderBy("rank").collect()] == [("T1", 2), ("T3", 2)]
    assert consensus.validated_consensus(runs[0].limit(0), runs[1], own).count() >= 1


def test_best_of_variants(spark):
    """P3 against the loop over variants, with aliases and decoded names; the domain features of a staged pair."""
    rows = [("S1", "Smart Tools LLC", "12 Oak St", "US"), ("S2", "Acme Foods DBA: Tasty Bread", "1 Elm St", "US"), ("S3", "moorebitwise.com", "1 Elm St", "US"),
            ("T1", "5mart tools", "12 Oak St", "US"), ("T2", "tasty bread", "1 Elm St", "US"), ("T3", "Moore Bitwise Inc", "1 Elm St", "US")]
    raw = spark.createDataFrame(rows, tables.RECORD)
    d = records.feature_form(raw)
    q, t = d.filter("id LIKE 'S%'"), d.filter("id LIKE 'T%'")
    own = blocking.looked_up(blocking.every_pair(q, t), q, t)
    names = {r.id: r.n for r in d.collect()}
    for r in features.features(own, "P3").collect():
        best, used = [0.0] * 4, 0
        variants = lambda n: list({v: k for k, v in reversed([(k, n[k]) for k in ("full", "core", "leet", "dba_alt")]) if v}.items())[::-1]
        for x, kx in variants(names[r.query_id]):
            for y, ky in variants(names[r.target_id]):
                m = [S.token_sort(x, y), S.token_set(x, y), S.partial(x, y), S.partial(x.replace(" ", ""), y.replace(" ", ""))]
                if max(m) > max(best):
                    used = int("dba_alt" in (kx, ky))
                best = [max(p) for p in zip(best, m, strict=True)]
        got = (r.name_token_sort, r.name_token_set, r.name_partial, r.name_nospace_partial, r.used_alt_name)
        assert got == pytest.approx((*(b / 100 for b in best), used))
    plain = {(r.query_id, r.target_id): r for r in features.features(own, "P7").collect()}
    best = {(r.query_id, r.target_id): r for r in features.features(own, "P3").collect()}
    assert best["S2", "T2"].name_token_sort == 1 > plain["S2", "T2"].name_token_sort and best["S2", "T2"].used_alt_name == 1
    r = records.rule_form(raw)
    staged = features.staged_features(blocking.looked_up(blocking.every_pair(r.filter("id LIKE 'S%'"), r.filter("id LIKE 'T%'")), r, r).withColumn("blocking_score", F.lit(0.0)))
    got = {(x.query_id, x.target_id): x for x in staged.collect()}
    assert got["S3", "T3"].domain_match_score == 1 and got["S3", "T3"].has_domain_signal == 1 and got["S1", "T1"].has_domain_signal == 0
    forced = blocking.labelled(spark.createDataFrame([("a", "x", 0.5)], "query_id string, target_id string, score double"), spark.createDataFrame([("a", "y")], "query_id string, target_id string"), True)
    assert sorted((x.target_id, x.score, x.label) for x in forced.collect()) == [("x", 0.5, 0), ("y", 0.0, 1)]


def test_partial_windows_are_all_windows():
    r = random.Random(6)
    for _ in range(300):
        a, b = sorted(("".join(r.choice("abc d") for _ in range(r.randint(1, 12))) for _ in range(2)), key=len)
        windows = [b[i : i + len(a)] for i in range(len(b) - len(a) + 1)]
        assert S.partial(a, b, S.blocks) == pytest.approx(1.0 if a == b else max(S.blocks(a, w) for w in windows))
        ends = [b[:i] for i in range(1, len(a))] + [b[-i:] for i in range(1, len(a))]
        assert S.partial(a, b) == pytest.approx(max(S.indel(a, w) for w in windows + ends))


def test_blocking_smoke(spark):
    rows = [("S1-1", "5mart Development LLC", "0337 Main St", "US"), ("S1-2", "Escobedo Smart of Williamson", "20 Oak Ave", "US"), ("S2-1", "Smart Development LLC", "337 Main St", "US"), ("S2-2", "Williamson Smart of Escobedo", "20 Oak Avenue", "US"), ("S3-1", "Unrelated Co", "1 Nowhere Rd", "US")]
    d = records.rule_form(spark.createDataFrame(rows, tables.RECORD))
    q, t = d.filter("id LIKE 'S1%'"), d.filter("id NOT LIKE 'S1%'")
    got = {(r.query_id, r.target_id) for r in blocking.rule_candidates(q, t).collect()}
    assert {("S1-1", "S2-1"), ("S1-2", "S2-2")} <= got and not any(b == "S3-1" for _, b in got)
    best = {r.query_id: r.target_id for r in blocking.two_pass_topk(q, t, k=1).collect()}
    assert best["S1-2"] == "S2-2"
    g = features.group_features(spark.createDataFrame([("q", "a", 0.95), ("q", "b", 0.4)], "query_id string, target_id string, score double")).orderBy("rank_in_query").collect()
    assert [round(r.margin_to_next, 2) for r in g] == [0.55, 0.4]


def test_grams_that_many_targets_share(spark):
    """A block of 5,200 targets whose names share a word: the cosine is that of counting, as in a small block."""
    names = {f"T{k}": f"acme {'tools' if k % 2600 == 0 else 'x' * (k % 7 + 1) + str(k)}" for k in range(5200)}
    d = spark.createDataFrame(list(names.items()), "id string, name string")
    q = spark.createDataFrame([("S1", "acme tool")], "id string, name string")
    got = {r.target_id: r.score for r in blocking.gram_similarity(q, d, F.lit("US"), F.col("name")).collect()}

    def counts(text):
        padded = [f" {w} " for w in text.split()]
        return Counter(w[i : i + n] for n in (3, 4, 5) for w in padded for i in range(len(w) - n + 1))

    own = counts("acme tool")
    size = lambda c: math.sqrt(sum(v * v for v in c.values()))
    assert set(got) == set(names)
    for k in ("T0", "T2600", "T1", "T5199"):
        other = counts(names[k])
        assert got[k] == pytest.approx(sum(v * other[g] for g, v in own.items()) / size(own) / size(other))


def test_tables_and_stream(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1\tA "quoted" Co\t1 Road\tUS\nS2\tNA\n')
    got = {r.entity_id: r for r in tables.records(spark, str(tmp_path / "r.tsv"), unknown="Unknown").collect()}
    assert got["S1"].business_name == 'A "quoted" Co' and (got["S2"].business_name, got["S2"].business_address, got["S2"].country) == ("NA", "", "Unknown")
    (tmp_path / "m.tsv").write_text("q\tids\nS1\tT2, T1\nS2\t\n")
    listed = tables.lists(spark, str(tmp_path / "m.tsv"))
    assert [(r.query_id, r.ids) for r in listed.orderBy("query_id").collect()] == [("S1", ["T2", "T1"]), ("S2", [])]
    out = tables.joined(tables.pairs(listed), listed)
    assert sorted(map(tuple, out.collect())) == [("S1", "T2,T1"), ("S2", "")]
    tables.write_tsv(out, str(tmp_path / "out"))
    assert tables.lists(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "s.tsv").write_text("q\ts\nS1\tT:1:0.5000;T2:0.2500\n")
    s = tables.scores(spark, str(tmp_path / "s.tsv"))
    assert {(r.target_id, r.p) for r in s.collect()} == {("T:1", 0.5), ("T2", 0.25)}
    assert tables.joined_scores(s, listed).filter("source1_entity_id = 'S1'").first()[1] == "T:1:0.5000;T2:0.2500"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nQ1\tAcme Corp\tx\tUS\n")
    targets = spark.createDataFrame([("T1", "acme", "y", "US"), ("T2", "acme", "y", "India")], tables.RECORD)
    w = scoring.matched_stream(scoring.read_stream(spark, str(tmp_path / "in")), targets).writeStream.format("memory").queryName("linked").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert [tuple(r) for r in spark.table("linked").collect()] == [("Q1", "T1")]


def test_learning(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"q{i // 4}", f"t{i}", x := r.random(), r.random(), int(x > 0.7)) for i in range(400)]
    d = spark.createDataFrame(rows, "query_id string, target_id string, f1 double, f2 double, label int")
    train = learn.weighted(learn.split(d))
    assert train.groupBy("query_id").agg(F.count_distinct("is_validation").alias("n")).filter("n > 1").count() == 0
    model = learn.boosted(("f1", "f2"), trees=5).fit(train)
    assert learn.importance(model, ("f1", "f2"))[0][0] == "f1"
    p = learn.scored(model, d, ("query_id", "target_id", "label"))
    assert p.filter("(p > 0.5) = (label = 1)").count() > 380
    fixed = learn.recalibrated(learn.calibrated(p), p)
    assert fixed.filter("p <= 0 OR p >= 1").count() == 0
    tables.save_model(model, str(tmp_path / "m"), {"n_features": 45})
    loaded, about = tables.load_model(spark, str(tmp_path / "m"))
    assert tables.feature_set_of(about, features.SETS) == "P16" and learn.scored(loaded, d).count() == 400
    stack = d.withColumn("p1", F.col("f1")).withColumn("p2", F.col("f2"))
    assert learn.stacker(("f1", "f2")).fit(stack).transform(stack).count() == 400
    queries, truth = d.select("query_id").distinct(), d.filter("label = 1").select("query_id", "target_id")
    assert learn.stratified(queries, truth, 20).count() <= 20
    assert learn.distractors(d.select("target_id"), truth, 10).join(truth, "target_id").count() == 0


def test_report_is_whole_or_an_error(spark):
    assert tables.report(spark.range(2)).splitlines() == ["| id |", "| --- |", "| 0 |", "| 1 |"]
    assert len(tables.report(spark.range(1000)).splitlines()) == 1002
    with pytest.raises(ValueError, match="1,000"):
        tables.report(spark.range(1001))


@pytest.mark.parametrize(("text", "want"), [("தமிழ்", "tamizh"), ("తెలుగు", "telugu"), ("ಕನ್ನಡ", "kannada"), ("சென்னை 24", "chennai 24"), ("కంపెనీ", "kampeni"), ("ಬೆಂಗಳೂರು Pvt", "bemgaluru Pvt"), ("தமிழ்12", "tamizh12"), ("தொ", "to"), ("राम", "rama"), ("", ""), (None, "")])
def test_romanised_scripts(text, want):
    assert X.romanised(text) == want


def test_romanised_column(spark):
    own = spark.createDataFrame([("தமிழ்",), ("Café",), (None,)], "x string").select(X.any_script(F.col("x")).alias("y"))
    assert [r.y for r in own.collect()] == ["tamizh", "Cafe", None]


def test_abbreviation_of_initials(spark):
    rows = [("q", "ibm", "", "US"), ("r", "x", "", "US")], [("t", "international business machines bureau", "", "US"), ("u", "great western bank", "", "US")]
    q, t = (records.feature_form(spark.createDataFrame(r, tables.RECORD)) for r in rows)
    both = blocking.looked_up(blocking.every_pair(q, t), q, t)
    names = {(r.query_id, r.target_id): (r["q"].n.core, r["t"].n.initials) for r in both.collect()}
    for name, part in (("P9", 0.9), ("P10", 0.9), ("P11", 0.0)):
        got = {(r.query_id, r.target_id): r.name_abbreviation_match for r in features.features(both, name).collect()}
        assert got == {k: part if 2 <= len(core) <= 6 and core.isalpha() and initials.startswith(core) else 0.0 for k, (core, initials) in names.items()}


def test_queries_missed_whole(spark):
    truth = spark.createDataFrame([("a", "t2"), ("a", "t1"), ("b", "t1"), ("c", "t9")], "query_id string, target_id string")
    found = spark.createDataFrame([("a", "t3"), ("b", "t1"), ("d", "t1")], "query_id string, target_id string")
    queries = spark.createDataFrame([(x,) for x in "abcd"], "query_id string")
    assert [tuple(r) for r in metrics.missed_whole(found, truth, queries).orderBy("query_id").collect()] == [("a", "t1,t2", "t3"), ("c", "t9", "")]
    assert [tuple(r) for r in metrics.missed_whole(found, truth, queries, 1).collect()] == [("a", "t1,t2", "t3")]
    assert metrics.missed_whole(found, truth.limit(0), queries).count() == 0


def test_resumed_sink(spark, tmp_path):
    queries = spark.createDataFrame([(f"q{i}",) for i in range(6)], "query_id string")
    seen = []

    def work(left):
        seen.append(sorted(r.query_id for r in left.collect()))
        return left.withColumn("ids", F.lit("t"))

    at = str(tmp_path / "out")
    assert [tables.resumed(queries.filter("query_id < 'q2'"), at, work), tables.resumed(queries, at, work), tables.resumed(queries, at, work)] == [2, 4, 0]
    assert seen == [["q0", "q1"], ["q2", "q3", "q4", "q5"]]
    assert sorted(r.query_id for r in spark.read.parquet(at).collect()) == [f"q{i}" for i in range(6)]


def test_stacked_models(spark):
    r = random.Random(5)
    rows = [(f"q{i // 4}", f"t{i}", x := r.random(), r.random(), int(x > 0.7)) for i in range(400)]
    d = spark.createDataFrame(rows, "query_id string, target_id string, f1 double, f2 double, label int")
    out = learn.stacked(learn.weighted(learn.split(d)), ("f1", "f2")).join(d, ["query_id", "target_id"]).collect()
    assert len(out) == 400 and all(0 < x.p < 1 for x in out)
    assert sum((x.p > 0.5) == (x.label == 1) for x in out) > 370

@pytest.mark.parametrize("name", ["block_two_tokens", "block_staged", "set_evidence", "group_features", "consensus_clean", "consensus_differences", "consensus_agreement", "consensus_counters", "decide_closed_form_siblings"])
def test_no_table_of_records_or_pairs_is_broadcast(spark, sf_dir, name):
    """Spark reads the size of compressed files, which is far below that of the rows; so it must not choose by it."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_records_are_dealt_before_their_forms_are_made(spark, sf_dir):
    """A file is read in a task or two, however many rows it holds."""
    assert registry.QUERIES["feature_forms"](spark, sf_dir).rdd.getNumPartitions() == 4
    assert records.dealt(registry.view(spark, sf_dir, "s1")).rdd.getNumPartitions() == 4


@pytest.fixture(scope="module")
def repeated_parts(spark, sf_dir, tmp_path_factory):
    """``part`` three times: keys 9,000 apart make records of equal texts."""
    at = str(tmp_path_factory.mktemp("repeated"))
    spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(3))))).withColumn("p_partkey", F.col("p_partkey") + 9000 * F.col("k")).drop("k").write.parquet(f"{at}/part.parquet")
    return at


@pytest.mark.parametrize("name", ["set_evidence", "consensus_majority", "consensus_calibrated", "consensus_clean", "consensus_union", "consensus_differences", "decide_exact", "decide_closed_form_siblings", "consensus_counters", "consensus_list_whole", "consensus_fullest", "consensus_else_second", "consensus_else_first", "consensus_list", "consensus_intersection", "consensus_exact_or_script", "consensus_recovering", "consensus_validated"])
def test_equal_queries_are_asked_once(spark, sf_dir, repeated_parts, monkeypatch, name):
    """And once for all runs that a query compares; every one of them is told."""
    seen, own = [], blocking.rule_candidates
    monkeypatch.setattr(blocking, "rule_candidates", lambda q, t: seen.append(q.count()) or own(q, t))
    got = registry.QUERIES[name](spark, repeated_parts).toPandas()
    assert seen == [spark.read.parquet(f"{sf_dir}/part.parquet").count()]
    if name in registry.ORACLES:
        con = duckdb.connect()
        con.sql(f"create view part as select * from '{repeated_parts}/part.parquet/*.parquet'")
        want = con.sql(registry.ORACLES[name]).df()
        cols = sorted(want.columns)
        want, got = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
        pd.testing.assert_frame_equal(got, want, check_dtype=False)
    else:
        assert 3 * len(got[got.query_id.str[3:].astype(int) < 9000]) == len(got)


@pytest.mark.parametrize("name", ["consensus_recovering", "consensus_validated"])
def test_runs_of_a_consensus_are_not_joined(spark, sf_dir, name):
    """The driver plans three joins at last, two for the records and one for those who are told; candidates lie written."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin \w+,", plan)) == 3


def test_side_by_side(spark, sf_dir):
    """Ranks are those of by_ladder(); gates, then by query what both have, else all of a, else what is recovered of b."""
    own = rules.evidence(registry.pairs(spark, sf_dir))
    got = rules.side_by_side(own, {"ra": "R8", "rb": "R11"}, {"core": F.col("core_sort")}).filter("ra IS NOT NULL OR rb IS NOT NULL")
    want = consensus.both(rules.by_ladder(own, "R8"), rules.by_ladder(own, "R11"))
    key = ["query_id", "target_id"]
    pd.testing.assert_frame_equal(*(d.select(*key, "ra", "rb").toPandas().sort_values(key).reset_index(drop=True) for d in (got, want)), check_dtype=False)
    with pytest.raises(ValueError, match="order"):
        rules.side_by_side(own, {"ra": "R17"}, {})
    rows = [
        ("Q1", "T1", 2, 1, True, True, False), ("Q1", "T2", 1, None, True, True, True), ("Q2", "T1", 1, None, False, True, True), ("Q2", "T2", 2, 2, True, False, True), ("Q2", "T3", None, 1, True, True, True),
        ("Q3", "T1", None, 1, True, True, None), ("Q3", "T2", None, 2, True, True, True), ("Q3", "T3", 1, 3, None, True, True), ("Q3", "T4", None, 4, True, True, True), ("Q4", "T1", None, 1, True, True, False),
    ]
    made = spark.createDataFrame(rows, "query_id string, target_id string, ra int, rb int, gate_a boolean, gate_b boolean, ok boolean")
    assert sorted(tuple(r) for r in consensus.marked_consensus(made, 2).collect()) == [("Q1", "T1", 1), ("Q2", "T2", 1), ("Q3", "T2", 1), ("Q3", "T3", 2)]
