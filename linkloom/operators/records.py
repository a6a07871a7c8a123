"""Records in the normal forms that blocking, features and rules read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import address as A
from linkloom.functions import constants as K
from linkloom.functions import text as X


def dealt(records: DataFrame) -> DataFrame:
    """The records dealt by id to as many tasks as a shuffle has: a small file is read in one, and the forms are dear."""
    return records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity_id")


def rule_form(records: DataFrame) -> DataFrame:
    """(id, country, name, addr, comp, core, toks, nums, post, state, street, nonum, latin): what rules read."""
    name, addr, country = F.col("business_name"), F.col("business_address"), F.coalesce("country", F.lit("Unknown"))
    step = records.select(
        F.col("entity_id").alias("id"), country.alias("country"), F.coalesce(name, F.lit("")).alias("raw_name"), F.coalesce(addr, F.lit("")).alias("raw_addr"),
        X.clean(X.any_script(F.coalesce(name, F.lit("")))).alias("name"), X.clean(X.any_script(F.coalesce(addr, F.lit("")))).alias("addr"),
    )
    core = X.without_legal(F.col("name"))
    return step.select(
        "id", "country", "name", "addr", X.compressed(F.col("name")).alias("comp"), core.alias("core"), X.tokens(core).alias("toks"),
        A.numbers(F.col("addr")).alias("nums"), A.postal_codes(F.col("raw_addr"), F.col("country")).alias("post"),
        A.first_postal(F.col("raw_addr"), F.col("country")).alias("zip"), A.street_numbers(F.col("raw_addr"), F.col("country")).alias("snums"),
        A.state_code(F.col("raw_addr"), F.col("country")).alias("state"), A.street_words(F.col("addr")).alias("street"), A.distinctive_words(F.col("addr")).alias("dwords"),
        A.without_digits(F.col("addr")).alias("nonum"), X.is_latin(F.col("raw_name")).alias("latin"),
        X.name_tokens(F.col("raw_name")).alias("ntoks"), A.mapped_tokens(F.col("raw_addr")).alias("atoks"),
    )


def feature_form(records: DataFrame, compat: bool = False) -> DataFrame:
    """(id, country, n, a): the name and address structs that pair features read."""
    raw = F.coalesce("business_name", F.lit(""))
    step = records.select(F.col("entity_id").alias("id"), F.coalesce("country", F.lit("")).alias("country"), X.alias(X.any_script(raw)).alias("dba_alt"), X.plain(X.digits_for_words(F.lower(X.any_script(X.stripped(X.before_alias(raw)))))).alias("full"), X.plain(X.any_script(F.coalesce("business_address", F.lit("")))).alias("addr"), F.coalesce("business_address", F.lit("")).alias("raw_addr"))
    step = step.withColumn("core", X.without_legal_words(F.col("full")))
    step = step.withColumn("words", F.filter(F.split("core", " "), lambda w: (F.length(w) > 1) & ~F.array_contains(X.words_in(K.FEATURE_STOPWORDS), w)))
    step = step.withColumn("awords", F.split("addr", " ")).withColumn("postal", A.first_postal(F.col("addr"), F.col("country")))
    words, core = F.col("words"), F.col("core")
    comp = F.regexp_replace(core, "[^a-z0-9]", "")
    sort = lambda c: F.array_sort(F.array_distinct(c))
    name = F.struct(
        F.col("full"), core.alias("core"), comp.alias("comp"), X.leet(core).alias("leet"), F.col("dba_alt"), sort(words).alias("tokens"), X.grams(core, 3).alias("qgrams"),
        X.grams(comp, 4).alias("grams4"), X.initials(words).alias("initials"), X.soundex_codes(words).alias("soundex"), sort(X.numbers_in(words)).alias("num_tokens"),
        X.first_word(words).alias("first"), X.last_word(words).alias("last"), F.size(F.split(core, " ")).alias("n_words"),
    )
    known = F.filter(F.col("awords"), lambda w: (F.length(w) > 1) & ~F.array_contains(X.words_in(K.FEATURE_STOPWORDS), w))
    addr = F.struct(
        A.house_number(F.col("awords"), F.col("postal")).alias("house"), A.state_name(F.col("addr"), F.col("country"), compat).alias("state"), F.col("postal"),
        F.substring("postal", 1, 3).alias("postal_pfx"), sort(known).alias("tokens"), F.col("addr").alias("full"), A.city(F.col("awords"), F.col("postal")).alias("city"),
        (F.col("addr") == "").alias("is_empty"), A.unit(F.col("raw_addr")).alias("unit"), A.has_po_box(F.col("raw_addr")).alias("po_box"), F.size("awords").alias("n_words"),
    )
    return step.select("id", "country", name.alias("n"), addr.alias("a"))
