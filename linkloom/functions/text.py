"""Names as columns: cleaning, legal forms, compression, tokens, grams, variants.

All are built-in column expressions, but for scripts that need a table (any_script, kernel_soundex,
metaphone), which run over Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import constants as K

#: Accented Latin letters and their bases, by Unicode decomposition.
_ACCENTED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and unicodedata.combining(d[1]) and d[0].isascii()}


def quoted(word: str) -> str:
    """A text as an SQL literal."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_in(words) -> Column:
    """Fixed words as an array; as SQL, since a call for each word takes longer than small queries run."""
    return F.expr("array(" + ", ".join(map(quoted, words)) + ")")


def table_of(entries: dict[str, str]) -> Column:
    """Fixed entries as a map."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in entries.items()) + ")")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_accents(c: Column) -> Column:
    """Accented Latin letters as their bases."""
    return F.translate(c, "".join(_ACCENTED), "".join(_ACCENTED.values()))


def ascii_fold(c: Column) -> Column:
    """Accents folded; whatever else is not ASCII goes."""
    return F.regexp_replace(fold_accents(c), r"[^\x00-\x7F]", "")


def letters(script: str) -> tuple[dict[str, str], dict[str, str], dict[str, str], dict[str, str]]:
    """Consonants, vowels, vowel signs and other signs of a script; of those without a fixed table by their Unicode names."""
    if script in ("devanagari", "bengali"):
        return K.DEVANAGARI if script == "devanagari" else K.BENGALI
    consonants, vowels, signs = {}, {}, {}
    others = {c: c for c in map(chr, range(0x20, 0x7F))}
    for ch in map(chr, range(K.SCRIPTS[script][0], K.SCRIPTS[script][1] + 1)):
        kind, _, sound = unicodedata.name(ch, "").removeprefix(script.upper()).strip().partition(" ")
        if kind == "LETTER" and sound in K.NAMED_VOWELS:
            vowels[ch] = K.NAMED_VOWELS[sound]
        elif kind == "LETTER" and sound.endswith("A") and " " not in sound:
            consonants[ch] = K.NAMED_CONSONANTS.get(sound) or sound[:-1].lower()
        elif kind == "VOWEL" and (sound := sound.removeprefix("SIGN ")) in K.NAMED_VOWELS:
            signs[ch] = K.NAMED_VOWELS[sound]
        elif kind == "SIGN" and sound in K.NAMED_SIGNS:
            others[ch] = K.NAMED_SIGNS[sound]
        elif kind == "DIGIT":
            others[ch] = str(unicodedata.digit(ch))
    return consonants, vowels, signs, others


#: letters() of each script that is romanised.
_LETTERS = {script: letters(script) for script in K.VIRAMA}


def transliterate(text: str, script: str) -> str:
    """Consonants carry their own vowel unless a vowel sign or the silencing sign follows."""
    consonants, vowels, signs, others = _LETTERS[script]
    silence, own = K.VIRAMA[script]
    text = unicodedata.normalize("NFC", text)
    follows = f"[{''.join(signs)}{silence}]"
    out = []
    for m in re.finditer(f"([{''.join(consonants)}])({follows})?|(.)", text, re.S):
        letter, sign, other = m.groups()
        if letter:
            out.append(consonants[letter] + (own if sign is None else signs.get(sign, "")))
        else:
            out.append(vowels.get(other) or others.get(other, ""))
    return "".join(out)


def script_of(text: str) -> str:
    """The script of most characters; ASCII counts as Latin; ties and others: the first seen, or Latin."""
    seen: dict[str, int] = {}
    for ch in text:
        name = "latin" if ch < "\x80" else next((n for n, (a, b) in K.SCRIPTS.items() if a <= ord(ch) <= b), None)
        if name:
            seen[name] = seen.get(name, 0) + 1
    return max(seen, key=seen.get) if seen else "latin"


def romanised(text: str) -> str:
    """Tokens of the five Indic scripts by their letters, others by decomposition, the rest dropped."""
    parts = [transliterate(t, s) if (s := script_of(t)) in K.VIRAMA else t for t in (text or "").split(" ")]
    return unicodedata.normalize("NFKD", " ".join(parts)).encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def _romanise(s: pd.Series) -> pd.Series:
    known = {x: romanised(x) for x in s.dropna().unique()}
    return pd.Series([known.get(x) for x in s], dtype=object)


def any_script(c: Column) -> Column:
    """Latin text by built-in functions; only other scripts go through Python."""
    return F.when(c.rlike(r"^[\x00-ɏ]*$"), ascii_fold(c)).otherwise(_romanise(c))


def script(c: Column) -> Column:
    """The script of most characters."""
    counts = [F.struct(F.length(F.regexp_replace(c, f"[^\\x{{{a:X}}}-\\x{{{b:X}}}]", "")).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, (a, b)) in enumerate([("latin", (0, 0x7F)), *K.SCRIPTS.items()])]
    return F.greatest(*counts)["name"]


def is_latin(c: Column) -> Column:
    """No letter beyond U+00FF."""
    return ~c.rlike(r"[\p{L}&&[^\x00-\xFF]]")


def clean(c: Column) -> Column:
    """Lower case, one space between words."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def normal(c: Column) -> Column:
    """clean(), with ``&`` spelt out and punctuation as spaces."""
    return squeeze(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")), r"[^a-z0-9_\s\x{80}-\x{10FFFF}]", " "))


def plain(c: Column) -> Column:
    """ASCII letters, digits and single spaces."""
    return squeeze(F.regexp_replace(F.lower(ascii_fold(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", " "))


def without_legal(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "(?i)" + "|".join(K.LEGAL_PATTERNS), " "))


def without_legal_words(c: Column) -> Column:
    """Longest legal form first, with a full stop after it if there is one."""
    forms = "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(K.LEGAL_WORDS, key=len, reverse=True))
    return squeeze(F.regexp_replace(c, rf"(?i)\b({forms})\.?\b", " "))


def without_domains(c: Column) -> Column:
    """Each domain ending off the end once, in the order of the list."""
    for d in K.DOMAINS:
        c = F.trim(F.regexp_replace(c, re.escape(d) + "$", ""))
    return c


def compressed(c: Column, endings=K.COMPRESSED_ENDINGS) -> Column:
    """Letters and digits only, each legal ending off the end once, in the order of the list."""
    c = F.regexp_replace(without_domains(clean(c)), "[^a-z0-9]", "")
    for e in endings:
        c = F.regexp_replace(c, e + "$", "")
    return c


def tokens(c: Column, stop=K.STOPWORDS, least: int = 3) -> Column:
    """Sorted distinct words of at least ``least`` characters that are no stop words."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1), lambda x: (F.length(x) >= least) & ~F.array_contains(words_in(stop), x))))


def name_tokens(c: Column) -> Column:
    """Words of the normalised name without legal forms and stop words, two characters at least."""
    return tokens(normal(c), (*K.LEGAL_TOKENS, *K.NAME_STOPWORDS), 2)


def before_alias(c: Column) -> Column:
    """The name before a trade-name marker (d.b.a.), which has to be a word of its own."""
    return F.trim(F.regexp_replace(c, r"(?i)\bd\.?\s*b\.?\s*a\b.*$", ""))


def alias(c: Column) -> Column:
    """The name after the marker, cleaned; empty if there is none."""
    return without_legal_words(plain(F.regexp_extract(c, r"(?i)\bd\.?\s*b\.?\s*a\b\.?\s*:?\s*(.+)$", 1)))


def stripped(c: Column) -> Column:
    """Without record numbers, handles and domains."""
    c = F.regexp_replace(c, r"(?i)\(\s*id\s*[:#]?\s*\d+\s*\)", " ")
    c = F.regexp_replace(c, r"(?<![a-z0-9])@", " ")
    return F.regexp_replace(c, r"(?i)\.(com|net|org|io|co|in|fr|biz|org\.in|gov\.in)\b", " ")


def digits_for_words(c: Column) -> Column:
    for w, d in (*K.NUMBER_WORDS.items(), *K.ORDINALS.items()):
        c = F.regexp_replace(c, rf"\b{w}\b", d)
    return c


def leet(c: Column) -> Column:
    """The whole text decoded, if it has digits and decoding changes it; else empty."""
    decoded = F.translate(c, *K.LEET)
    return F.when(c.rlike("[0-9]") & (decoded != c), decoded).otherwise(F.lit(""))


def leet_words(words: Column) -> Column:
    """Words that mix letters and digits decoded, but for numbers with one letter."""
    return F.transform(words, lambda w: F.when(w.rlike("[a-z]") & w.rlike("[0-9@$]") & ~w.rlike("^[0-9]+[a-z]?$"), F.translate(w, *K.LEET_TOKEN)).otherwise(w))


def index_name(c: Column) -> Column:
    """The cleaner that runs before indexing: script, domain, ampersand, leet, legal forms, stop words."""
    c = without_domains(clean(any_script(c)))
    words = F.regexp_extract_all(F.regexp_replace(c, "[&+]", " and "), F.lit("([a-z0-9@$]+)"), 1)
    return F.array_join(F.filter(leet_words(words), lambda x: (F.length(x) > 1) & ~F.array_contains(words_in((*K.LEGAL_TOKENS, *K.STOPWORDS)), x)), " ")


def index_address(c: Column) -> Column:
    """Leading zeros off numbers, punctuation off."""
    return squeeze(F.regexp_replace(F.regexp_replace(clean(any_script(c)), r"\b0+([0-9]+)\b", "$1"), r"[^a-z0-9_\s]", " "))


def pair_text(c: Column) -> Column:
    """Separators as spaces, domain endings anywhere off."""
    return squeeze(F.regexp_replace(F.regexp_replace(clean(c), r"\.(com|net|org|in|fr|co)\b", " "), r"[#,\-/]", " "))


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; none if the text is shorter."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def numbers_in(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike("^[0-9]+$"))


def first_word(words: Column) -> Column:
    return F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))


def last_word(words: Column) -> Column:
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]", "")


def domain_compact(c: Column) -> Column:
    """Letters and digits of a text that has a full stop or a domain ending, without that ending; else empty."""
    low = F.lower(F.trim(c))
    ending = r"\.(com|net|org|co|in|fr|io|biz)$"
    return F.when(low.rlike(ending) | F.contains(low, F.lit(".")), F.regexp_replace(F.regexp_replace(low, ending, ""), "[^a-z0-9]", "")).otherwise(F.lit(""))


def kernel_soundex_of(word: str) -> str:
    """Vowels, H, W and Y part equal codes; the first letter's code is the one before the second's."""
    if not word:
        return ""
    code = {c: d for letters, d in K.SOUNDEX_CODES.items() for c in letters}
    coded = [code.get(c, "0" if c in "AEHIOUWY" else c) for c in word.upper()]
    kept = [b for a, b in zip(coded, coded[1:], strict=False) if b not in (a, "0")]
    return (word[0].upper() + "".join(kept) + "0000")[:4]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _soundex_all(s: pd.Series) -> pd.Series:
    return s.map(lambda words: sorted({kernel_soundex_of(w) for w in words}))


def soundex_codes(words: Column, letters_only: bool = False) -> Column:
    """Distinct codes of the words; with ``letters_only`` words that don't begin with a letter have none."""
    own = F.filter(words, lambda w: F.length(w) >= 2)
    return _soundex_all(F.filter(own, lambda w: w.rlike("^[a-z]")) if letters_only else own)


def metaphone_of(word: str) -> str:
    """The consonant skeleton of an English word, after the published rules of Metaphone."""
    w = re.sub(r"(.)\1+", lambda m: m.group(0) if m.group(1) == "c" else m.group(1), re.sub("[^a-z]", "", word.lower()))
    w = re.sub("^(ae|gn|kn|pn|wr)", lambda m: m.group(0)[1], w)
    w = re.sub("^x", "s", re.sub("^wh", "w", w))
    out = ""
    for i, c in enumerate(w):
        prev, nxt = w[i - 1 : i], w[i + 1 : i + 2]
        if c in "aeiou":
            out += c if i == 0 else ""
        elif c == "b":
            out += "" if i == len(w) - 1 and prev == "m" else "b"
        elif c == "c":
            out += "x" if w[i : i + 3] == "cia" or nxt == "h" else "s" if nxt in ("i", "e", "y") and nxt and prev != "s" else "" if prev == "s" and nxt in ("i", "e", "y") and nxt else "k"
        elif c == "d":
            out += "j" if nxt == "g" and w[i + 2 : i + 3] in ("e", "y", "i") and w[i + 2 : i + 3] else "t"
        elif c == "g":
            silent = (nxt == "h" and i + 2 < len(w) and w[i + 2] not in "aeiou") or w[i:] in ("gn", "gned")
            out += "" if silent else "j" if nxt in ("i", "e", "y") and nxt and prev != "g" else "k"
        elif c == "h":
            out += "h" if nxt in tuple("aeiou") and prev not in tuple("csptg") else ""
        elif c == "k":
            out += "" if prev == "c" else "k"
        elif c == "p":
            out += "f" if nxt == "h" else "p"
        elif c == "q":
            out += "k"
        elif c == "s":
            out += "x" if nxt == "h" or w[i : i + 3] in ("sio", "sia") else "s"
        elif c == "t":
            out += "x" if w[i : i + 3] in ("tia", "tio") else "0" if nxt == "h" else "" if w[i : i + 3] == "tch" else "t"
        elif c == "v":
            out += "f"
        elif c in "wy":
            out += c if nxt in tuple("aeiou") else ""
        elif c == "x":
            out += "ks"
        elif c == "z":
            out += "s"
        else:
            out += c
    return out
