"""String similarities: SQL of those Spark has or can compose, Arrow functions for the rest."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType


def levenshtein_ratio(a: str, b: str) -> str:
    """SQL: 1 - edits / longer length; two empty strings are equal."""
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


def number_similarity(a: str, b: str) -> str:
    """SQL of two house numbers: equal 1, one digit off 0.8, two off of four or more 0.4, one inside the other's end 0.7 or 0.5."""
    off = f"aggregate(zip_with(split({a}, ''), split({b}, ''), (p, q) -> CASE WHEN p = q THEN 0 ELSE 1 END), 0, (s, x) -> s + x)"
    end = f"(startswith({a}, {b}) OR startswith({b}, {a}) OR endswith({a}, {b}) OR endswith({b}, {a}))"
    return f"CASE WHEN {a} = {b} THEN 1.0D WHEN length({a}) = length({b}) THEN CASE WHEN {off} = 1 THEN 0.8D WHEN {off} = 2 AND length({a}) >= 4 THEN 0.4D ELSE 0.0D END WHEN least(length({a}), length({b})) >= 2 AND {end} THEN CASE WHEN abs(length({a}) - length({b})) = 1 THEN 0.7D ELSE 0.5D END ELSE 0.0D END"


def token_close(t: str, others: str) -> str:
    """SQL: 1 if a token is among the others, 0.7 if one shares its first or last three letters and about its length."""
    return f"CASE WHEN array_contains({others}, {t}) THEN 1.0D WHEN exists({others}, o -> length({t}) >= 4 AND length(o) >= 4 AND (left({t}, 3) = left(o, 3) OR right({t}, 3) = right(o, 3)) AND abs(length({t}) - length(o)) <= 2) THEN 0.7D ELSE 0.0D END"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a row each, filled with -1; and their lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), max(1, sizes.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def _in_order(codes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen characters of each row, moved to its front."""
    out = np.full(codes.shape, -1, np.int64)
    row, column = np.nonzero(chosen)
    out[row, (np.cumsum(chosen, 1) - 1)[row, column]] = codes[row, column]
    return out


def jaro_winkler_of(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity of each pair, raised by the common prefix where it is above 0.7; all pairs at once.

    Common characters lie at most half the longer length, less one, apart; every character of the left
    text takes the first free one of the right.
    """
    (a, n), (b, m) = _codes(left), _codes(right)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    place = np.arange(b.shape[1])
    met, taken = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    rows = np.arange(len(a))
    for k in range(a.shape[1]):
        free = (b == a[:, k : k + 1]) & ~taken & (np.abs(place - k) <= reach) & (a[:, k : k + 1] >= 0)
        met[:, k] = free.any(1)
        taken[rows[met[:, k]], free.argmax(1)[met[:, k]]] = True
    common = met.sum(1)
    width = min(a.shape[1], b.shape[1])
    swapped = (_in_order(a, met)[:, :width] != _in_order(b, taken)[:, :width]).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / n + common / m + (common - swapped) / common) / 3, 0.0)
    jaro[(n == 0) & (m == 0)] = 1.0
    first = min(4, width)
    prefix = np.cumprod((a[:, :first] == b[:, :first]) & (a[:, :first] >= 0), 1).sum(1)
    return np.where((jaro > 0.7) & (common > 0), jaro + prefix * 0.1 * (1 - jaro), jaro)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2 * common_subsequence(a, b) / (len(a) + len(b))


def token_set_of(a: str, b: str) -> float:
    """Best ratio among the common words, and the common words with either side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 1.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max([indel_ratio(left, right), *((indel_ratio(both, left), indel_ratio(both, right)) if both else ())])


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter string with a piece of the longer, no longer than it."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    n, m = len(short), len(long)
    if short in long:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << i
    bits, full = [places.get(c, 0) for c in long], (1 << n) - 1
    # a piece has no more characters in order than it has of the shorter string's
    known = [0, *accumulate(1 if b else 0 for b in bits)]
    pieces = [(max(0, k), min(m, k + n)) for k in range(1 - n, m)]
    bound = [2 * (known[e] - known[s]) / (n + e - s) for s, e in pieces]
    best = 0.0
    for k in sorted(range(len(pieces)), key=bound.__getitem__, reverse=True):
        if bound[k] <= best:
            break
        state, (s, e) = full, pieces[k]
        for b in bits[s:e]:
            hit = state & b
            state = ((state + hit) | (state - hit)) & full
        best = max(best, 2 * (n - state.bit_count()) / (n + e - s))
    return best


def _pairwise(function):
    """An Arrow function of two text columns; ``function`` gets lists of distinct pairs, 2000 at a time."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        whole = a.notna() & b.notna()
        pairs = pd.MultiIndex.from_arrays([a[whole], b[whole]])
        of, distinct = pairs.factorize()
        values = np.concatenate([np.zeros(0), *(function(*map(list, zip(*distinct[k : k + 2000], strict=True))) for k in range(0, len(distinct), 2000))])
        out = pd.Series(np.nan, index=a.index, dtype="float64")
        out[whole] = values[of]
        return out.astype(object).where(whole, None)

    return run


def _each(function):
    return lambda left, right: np.fromiter(map(function, left, right), float, len(left))


def jaro_winkler(a, b):
    return _pairwise(jaro_winkler_of)(a, b)


def token_set_ratio(a, b):
    return _pairwise(_each(token_set_of))(a, b)


def partial_ratio(a, b):
    return _pairwise(_each(partial_of))(a, b)


_SOUNDS = {c: d for d, letters in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in letters}


def sound_of(token: str) -> str:
    """Phonetic key: first letter and three digits; tokens that begin with a digit are their own key."""
    if not token or token[0].isdigit():
        return token
    key, last = token[0], _SOUNDS.get(token[0])
    for c in token[1:]:
        digit = int(c) if c.isdigit() else _SOUNDS.get(c)
        if digit is not None and digit != last:
            key += str(digit)
        if c not in "hw":
            last = digit
    return (key + "000")[:4]


@F.pandas_udf(ArrayType(StringType()))
def _sounds(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: [sound_of(t) for t in ts], na_action="ignore")


def sounds(tokens: str):
    """Distinct phonetic keys of a token array: Spark's own soundex for plain letters."""
    plain = F.forall(tokens, lambda t: t.rlike("^[a-z]+$"))
    return F.array_distinct(F.when(plain, F.transform(tokens, lambda t: F.lower(F.soundex(t)))).otherwise(_sounds(tokens)))


def f_half(tp: str, predicted: str, gold: str) -> str:
    """SQL of F0.5 of two sets: both empty 1, one empty 0."""
    return f"CASE WHEN {predicted} = 0 AND {gold} = 0 THEN 1.0D WHEN {tp} = 0 THEN 0.0D ELSE 1.25D * {tp} / (0.25D * {gold} + {predicted}) END"
