"""Addresses as columns: numbers, postal codes, states, cities, street words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import constants as K
from linkloom.functions import text as X


def mapped_tokens(c: Column) -> Column:
    """Words with abbreviations spelt out, sorted and distinct."""
    words = X.table_of(K.ADDRESS_WORDS)
    kept = F.filter(F.split(X.normal(c), " "), lambda w: (F.length(w) > 1) & ~F.array_contains(X.words_in(K.NAME_STOPWORDS), w))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.coalesce(words[w], w))))


def raw_numbers(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([0-9]+)\b"), 1)))


def numbers(c: Column, least: int = 1) -> Column:
    """Numbers of at least ``least`` digits as written, without leading zeros, sorted and distinct."""
    all_ = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"\b([0-9]{{{least},}})\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(all_, lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))))


def postal_codes(c: Column, country: Column) -> Column:
    five, six = (F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"\b([0-9]{{{n}}})\b"), 1) for n in (5, 6))
    return F.array_sort(F.array_distinct(F.when(country.isin("US", "France"), five).when(country == "India", six).otherwise(F.array().cast("array<string>"))))


def first_postal(c: Column, country: Column) -> Column:
    """The first postal code: six digits from 1 on in India, else five; empty if there is none."""
    return F.when(country == "India", F.regexp_extract(c, r"\b([1-9][0-9]{5})\b", 1)).otherwise(F.regexp_extract(c, r"\b([0-9]{5})\b", 1))


def street_numbers(c: Column, country: Column) -> Column:
    """Numbers but for the postal code and anything of seven digits or more."""
    own = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([0-9]+)\b"), 1), lambda n: (n != first_postal(c, country)) & (F.length(n) < 7))
    return F.array_sort(F.array_distinct(F.transform(own, lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))))


def house_number(words: Column, postal: Column, longest: int = 5) -> Column:
    """The first number among the words that is no postal code; else the first digits in a word."""
    whole = F.filter(words, lambda w: w.rlike("^[0-9]+$") & (w != postal) & (F.length(w) <= longest))
    inside = F.filter(F.transform(words, lambda w: F.regexp_extract(w, "([0-9]+)", 1)), lambda n: (n != "") & (n != postal) & (F.length(n) <= longest))
    found = F.coalesce(F.try_element_at(whole, F.lit(1)), F.try_element_at(inside, F.lit(1)), F.lit(""))
    return F.regexp_replace(found, "^0+(?=[0-9])", "")


def state_code(c: Column, country: Column, floors: bool = False) -> Column:
    """India: the first entry of the table that occurs; US: the last two-letter word that is a state."""
    low = F.lower(F.coalesce(c, F.lit("")))
    # The first entry of the table that occurs, whatever its place in the text.
    codes = X.table_of(K.INDIA_STATE_CODES)
    india = codes[F.try_element_at(F.filter(X.words_in(K.INDIA_STATE_CODES), lambda n: F.regexp_instr(low, F.concat(F.lit(r"\b"), n, F.lit(r"\b"))) > 0), F.lit(1))]
    own = F.regexp_replace(low, r"\bfl\b\.?\s*(floor|ground|[0-9])", " ") if floors else low
    fifty = [s for s in K.US_STATES if s != "dc"]
    us = F.try_element_at(F.filter(F.regexp_extract_all(own, F.lit(r"\b([a-z]{2})\b"), 1), lambda w: F.array_contains(X.words_in(fifty), w)), F.lit(-1))
    return F.when(country == "India", india).when(country == "US", F.upper(us))


def state_name(plain: Column, country: Column, compat: bool = False) -> Column:
    """The full name of the first word that is a state's code, else of the first name that occurs.

    Codes that two countries share are read by country; ``compat`` reads them by one merged table.
    """

    def by(table: dict[str, str]) -> Column:
        codes = X.table_of(table)
        words = F.split(F.regexp_replace(plain, r"\bfl\b\.?\s*(floor|ground|[0-9])", " "), " ")
        code = F.try_element_at(F.filter(words, lambda w: codes[w].isNotNull()), F.lit(1))
        names = {n: n for n in table.values()} | K.OLD_STATE_NAMES
        padded = F.concat(F.lit(" "), plain, F.lit(" "))
        name = F.coalesce(*(F.when(padded.contains(f" {n} "), F.lit(x)) for n, x in names.items()))
        return F.coalesce(codes[code], name, F.lit(""))

    merged = K.US_STATES | K.INDIA_STATES
    if compat:
        return by(merged)
    return F.when(country == "India", by(K.INDIA_STATES)).when(country == "US", by(K.US_STATES)).otherwise(F.lit(""))


def city(words: Column, postal: Column) -> Column:
    """The last word of three letters or more that is no stop word, state code, number or postal code."""
    no = X.words_in((*K.FEATURE_STOPWORDS, *K.US_STATES, *(s for s in K.INDIA_STATES if s not in K.US_STATES)))
    return X.last_word(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(no, w) & ~w.rlike("^[0-9]+$") & (w != postal)))


def unit(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"\b(?:unit|suite|ste|apt|apartment|flat|room|rm|shop)\s*#?\s*([a-z0-9]+)", 1)


def has_po_box(c: Column) -> Column:
    return F.lower(c).rlike(r"\bp\.?\s*o\.?\s*box\b")


def street_words(c: Column) -> Column:
    """The first three words of letters, of three or more, that are no stop words."""
    return F.slice(F.filter(F.regexp_extract_all(X.clean(c), F.lit("([a-z]+)"), 1), lambda w: (F.length(w) >= 3) & ~F.array_contains(X.words_in(K.STOPWORDS), w)), 1, 3)


def distinctive_words(c: Column) -> Column:
    """Words of three characters or more in order, numbers too, without stop words and generic ones."""
    words = F.split(X.squeeze(F.regexp_replace(c, r"[^a-z0-9_\s]", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(X.words_in((*K.STOPWORDS, *K.GENERIC_ADDRESS)), w))


def locality_words(c: Column) -> Column:
    """Of the first four words as written those of more than three characters that are not generic."""
    return F.filter(F.slice(F.split(X.squeeze(c), " "), 1, 4), lambda w: (F.length(w) > 3) & ~F.array_contains(X.words_in(K.GENERIC_LOCALITY), w))


def without_digits(c: Column) -> Column:
    return X.squeeze(F.regexp_replace(c, "[0-9]+", " "))


def split_numbers(c: Column) -> Column:
    """(text, numbers): letters only, and the numbers as whole numbers, sorted."""
    text = X.squeeze(F.regexp_replace(X.fold_accents(F.regexp_replace(F.lower(c), "[#0-9]+", " ")), r"[^a-z\s]", " "))
    n = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), 1), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.struct(text.alias("text"), F.array_sort(n).alias("numbers"))
