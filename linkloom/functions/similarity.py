"""String similarity in two profiles, and set similarities.

``indel``: 100 * (1 - insertions and deletions / total length), by the longest common subsequence.
``blocks``: matching blocks as the standard library's difflib finds them, from 0 to 1; equal strings,
also empty ones, are 1. The profiles give different numbers, so the profile is always named.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import metaphone_of

#: Texts, and pairs of them, whose parts and similarities a task remembers.
REMEMBERED = 200_000


def remembered(f: Callable) -> Callable:
    """``f`` of one text, computed once a text, as long as it is remembered. Travels by value, unlike functools' caches."""
    known: dict = {}

    def get(x: str):
        if x not in known:
            if len(known) > REMEMBERED:
                known.clear()
            known[x] = f(x)
        return known[x]

    return get


@remembered
def _places(a: str) -> dict[str, int]:
    """For each character the positions that have it, as bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    places = _places(a)
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / n if n else 100.0


def blocks(a: str, b: str) -> float:
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


@remembered
def _sorted_words(a: str) -> str:
    return " ".join(sorted(a.split()))


@remembered
def _word_set(a: str) -> frozenset[str]:
    return frozenset(a.split())


def token_sort(a: str, b: str, ratio=indel) -> float:
    return ratio(_sorted_words(a), _sorted_words(b))


def token_set(a: str, b: str, ratio=indel) -> float:
    """The best of: shared words against either side, and the two sides, each with its own words after the shared."""
    x, y = _word_set(a), _word_set(b)
    top = 1.0 if ratio is blocks else 100.0
    if a == b and ratio is blocks:
        return top
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(z - (x & y)))))) for z in (x, y))
    if both and ratio is indel and both in (left, right):
        return top
    return max([ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else ())])


def partial(a: str, b: str, ratio=indel) -> float:
    """The best window of the longer text of the shorter's length; ``indel`` also tries shorter windows at the ends.

    Windows are tried by an upper bound, the common subsequence, until the best can't be passed.
    """
    top = 1.0 if ratio is blocks else 100.0
    if a == b:
        return top
    if not a or not b:
        return 0.0
    a, b = sorted((a, b), key=len)
    if a in b:
        return top
    m = len(a)
    windows = [b[i : i + m] for i in range(len(b) - m + 1)]
    if ratio is indel:
        best = max(indel(a, w) for w in dict.fromkeys(windows))
        for i in range(m - 1, 0, -1):
            if 200.0 * i / (i + m) <= best:
                break
            best = max(best, indel(a, b[:i]), indel(a, b[-i:]))
        return best
    best = 0.0
    for bound, w in sorted(((2.0 * common_subsequence(a, w) / (m + len(w)), w) for w in dict.fromkeys(windows)), reverse=True):
        if bound <= best:
            break
        best = max(best, blocks(a, w))
    return best


def jaro_winkler(a: str, b: str, boost_above: float = 0.0) -> float:
    """Jaro similarity, with a bonus of a tenth for each of up to four equal first letters where it is above ``boost_above``."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken: list[int] = []
    used = set()
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        taken.append(-1 if j is None else j)
        if j is not None:
            used.add(j)
    m = len(used)
    if not m:
        return 0.0
    mine, theirs = [a[i] for i, j in enumerate(taken) if j >= 0], [b[j] for j in sorted(used)]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= boost_above:
        return jaro
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


def metaphone_similarity(a: str, b: str) -> float:
    """Of the consonant skeletons; 0.5 if one has none."""
    x, y = metaphone_of(a), metaphone_of(b)
    return blocks(x, y) if x and y else 0.5


#: What parts the variants of a name in one text: full, core, decoded, alias.
VARIANT = "\x01"


def _variants(text: str) -> list[tuple[bool, str]]:
    """(is the alias, variant) of each distinct variant that is not empty; an empty one if there is none."""
    out: dict[str, bool] = {}
    for k, v in enumerate(text.split(VARIANT)):
        if v and v not in out:
            out[v] = k == 3
    return [(alias, v) for v, alias in out.items()]


def _best_of(texts: tuple[str, str]) -> tuple[float, float, float, float, float]:
    """Over all pairs of variants the best of four metrics, and whether the first pair to reach the best of all has an alias."""
    best, used = [0.0] * 4, 0.0
    for x_alias, x in _variants(texts[0]):
        for y_alias, y in _variants(texts[1]):
            own = token_sort(x, y), token_set(x, y), partial(x, y), partial(x.replace(" ", ""), y.replace(" ", ""))
            if max(own) > max(best):
                used = float(x_alias or y_alias)
            best = [max(p) for p in zip(best, own, strict=True)]
    return (*best, used)


_best = remembered(_best_of)

_KINDS = {
    "best_token_sort": lambda a, b: _best((a, b))[0], "best_token_set": lambda a, b: _best((a, b))[1], "best_partial": lambda a, b: _best((a, b))[2],
    "best_nospace_partial": lambda a, b: _best((a, b))[3], "best_is_alias": lambda a, b: _best((a, b))[4],
    "indel": indel, "blocks": lambda a, b: blocks(a, b), "jaro_winkler": jaro_winkler, "jaro_winkler_above": lambda a, b: jaro_winkler(a, b, 0.7),
    "token_sort": token_sort, "token_set": token_set, "partial": partial, "metaphone": metaphone_similarity,
    "token_sort_blocks": lambda a, b: 1.0 if a == b else token_sort(a, b, blocks), "token_set_blocks": lambda a, b: token_set(a, b, blocks),
    "partial_blocks": lambda a, b: partial(a, b, blocks),
}


def measured(wanted: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct with a field for each of ``wanted``: (kind, a, b), a kind of _KINDS; 0 where its name ends in "?" and a text is empty.

    All are computed in one pass over Arrow batches; a task computes equal pairs once, as long as it remembers them.
    """
    names = list(wanted)
    texts: dict[str, int] = {}
    columns: list[Column] = []

    def place(c: Column) -> int:
        if str(c) not in texts:
            texts[str(c)] = len(columns)
            columns.append(F.coalesce(c, F.lit("")))
        return texts[str(c)]

    plan = [(_KINDS[kind.rstrip("?")], kind, place(a), place(b)) for kind, a, b in wanted.values()]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, float] = {}
        for cols in batches:
            if len(known) > REMEMBERED:
                known.clear()
            lists = [c.tolist() for c in cols]
            out = {}
            for name, (f, kind, i, j) in zip(names, plan, strict=True):
                values = []
                for a, b in zip(lists[i], lists[j], strict=True):
                    p = known.get((kind, a, b))
                    if p is None:
                        p = known[kind, a, b] = 0.0 if kind[-1] == "?" and not (a and b) else f(a, b)
                    values.append(p)
                out[name] = values
            yield pd.DataFrame(out, dtype="float64")

    return run(*columns)


def similarity(kind: str, a: Column, b: Column) -> Column:
    """One of the metrics above."""
    return measured({"x": (kind, a, b)})["x"]


def guarded(kind: str, a: Column, b: Column) -> Column:
    """similarity(), or 0 if either text is empty."""
    return similarity(kind + "?", a, b)


def levenshtein(a: Column, b: Column) -> Column:
    """1 - edits / the longer length; 1 for two empty texts."""
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Whether both sets have something and share some of it."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def gram_jaccard(a: Column, b: Column, n: int) -> Column:
    """Of character n-grams; a shorter text is its own only gram."""
    from linkloom.functions.text import grams

    own = lambda c: F.when(F.length(c) < n, F.array(c)).otherwise(grams(c, n))
    return jaccard(own(a), own(b))


def word_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one of four letters or more lies in the other, else the Jaccard of 3-grams."""
    inside = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return F.when(a == b, 1.0).when(inside, 0.9).otherwise(gram_jaccard(a, b, 3))


def best_word_similarity(a: Column, b: Column) -> Column:
    """The mean over ``a``'s words of the best similarity to a word of ``b``; 0 if either has none."""
    best = F.transform(a, lambda x: F.coalesce(F.array_max(F.transform(b, lambda y: word_similarity(x, y))), F.lit(0.0)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)


def house_similarity(a: Column, b: Column, ends: bool = True) -> Column:
    """1 if equal, 0.8 if one begins (or ends) the other, 0 if not, 0.5 if either is empty."""
    begins = F.startswith(a, b) | F.startswith(b, a)
    near = begins | F.endswith(a, b) | F.endswith(b, a) if ends else begins
    return F.when((a == "") | (b == ""), 0.5).when(a == b, 1.0).when(near, 0.8).otherwise(0.0)


def number_conflict(a: Column, post_a: Column, b: Column, post_b: Column) -> Column:
    """Postal codes differ, or the numbers share none and none of three digits or more lies in another's."""
    near = F.exists(a, lambda x: F.exists(b, lambda y: ((F.length(x) >= 3) & F.contains(y, x)) | ((F.length(y) >= 3) & F.contains(x, y))))
    numbers = (F.size(a) > 0) & (F.size(b) > 0) & ~overlap(a, b) & ~near
    return ((post_a != "") & (post_b != "") & (post_a != post_b)) | numbers


def plain_conflict(a: Column, b: Column) -> Column:
    """Both have numbers, and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~overlap(a, b)


def _typo(a: str, b: str) -> bool:
    return len(a) >= 2 and len(b) >= 2 and (a in b or b in a or abs(len(a) - len(b)) <= 1 or indel(a, b) >= 66)


def _near_typo(a: str, b: str) -> bool:
    return len(a) >= 2 and len(b) >= 2 and (a in b or b in a or abs(len(a) - len(b)) <= 1) and indel(a, b) >= 66


def _part(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    return len(a) >= 3 and (a in b or indel(a, b) >= 75)


_NUMBER_TESTS = {"typo": _typo, "near_typo": _near_typo, "part": _part}


def numbers_near(kind: str, a: Column, b: Column) -> Column:
    """Whether some two numbers are near.

    typo: of two digits or more each, one lies in the other, or lengths or digits are near. near_typo: one lies in the
    other or lengths are near, and digits are. part: of three digits or more each, one lies in the other or digits are
    very near. ``a`` and ``b`` are arrays.
    """
    f = _NUMBER_TESTS[kind]

    @F.pandas_udf(T.BooleanType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([any(f(p, q) for p in m for q in n) for m, n in zip(x, y, strict=True)], dtype="bool")

    return run(a, b)


def number_typo(a: Column, b: Column) -> Column:
    """Some two numbers of two digits or more are a typo apart: one in the other, lengths or digits near."""
    return numbers_near("typo", a, b)
