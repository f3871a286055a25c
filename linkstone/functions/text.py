"""Normalisation of business names and addresses as column expressions.

Everything runs inside the JVM except the folding of strings with characters beyond ASCII
(romanising Indic scripts, dropping accents), which goes through one Arrow function for those rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkstone.functions import dictionaries as D

INDIC = "[\\u0900-\\u0D7F]"
_FIRST, _LAST = 0x0900, 0x0D80


def _place(ch: str) -> int:
    return ord(ch) & 0x7F if _FIRST <= ord(ch) < _LAST else -1


def _class(places) -> str:
    """A regex class of the characters at these places of all nine blocks."""
    return "[" + "".join(chr(block + p) for block in range(_FIRST, _LAST, 0x80) for p in places) + "]"


_SYLLABLE = re.compile(
    f"(?P<c>{_class(D.CONSONANTS)}){_class([D.NUKTA])}?(?:(?P<bare>{_class([D.VIRAMA])})|(?P<sign>{_class(D.VOWEL_SIGNS)})|(?P<more>(?=[ऀ-ൿ])))?"
    f"|(?P<v>{_class(D.VOWELS)})|(?P<s>{_class(D.VOWEL_SIGNS)})|(?P<m>{_class(D.MARKS)})|(?P<n>{_class(range(0x66, 0x70))})|(?P<x>[ऀ-ൿ])"
)


def romanise(word: str) -> str:
    """Latin form of a word in an Indic script, syllable by syllable; the last inherent vowel is silent."""

    def latin(found: re.Match) -> str:
        if found["c"]:
            sound = D.CONSONANTS[_place(found["c"])]
            if found["bare"]:
                return sound
            if found["sign"]:
                return sound + D.VOWEL_SIGNS[_place(found["sign"])]
            return sound + ("a" if found["more"] is not None else "")
        for group, letters in (("v", D.VOWELS), ("s", D.VOWEL_SIGNS), ("m", D.MARKS)):
            if found[group]:
                return letters[_place(found[group])]
        return str(_place(found["n"]) - 0x66) if found["n"] else ""

    return _SYLLABLE.sub(latin, word)


def fold(text: str, token_map: dict[str, str] | None = None) -> str:
    """Lower-case text in Latin letters without accents; words in Indic scripts by the learned map, else romanised."""
    if re.search("[ऀ-ൿ]", text):
        words = []
        for word in text.split():
            if re.search("[ऀ-ൿ]", word):
                word = word.strip(".,;:()-#")
                word = (token_map or {}).get(word) or romanise(word)
            words.append(word)
        text = " ".join(words)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) or _place(c) >= 0)


def base(text: Column, token_map: dict[str, str] | None = None) -> Column:
    """Lower case, folded where there is anything to fold."""

    @F.pandas_udf(StringType())
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: fold(v, token_map), na_action="ignore")

    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.when(lower.rlike(r"^[\x00-\x7F]*$"), lower).otherwise(folded(lower))


def words_sql(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def map_sql(table: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in table.items()) + ")"


def _tokens(text: str) -> str:
    return f"filter(split(regexp_replace({text}, r'(?U)[^\\w\\s\\u0900-\\u0D7F]', ' '), r'(?U)\\s+'), t -> t <> '')"


def normalise_name(df: DataFrame, column: str, token_map: dict[str, str] | None = None) -> DataFrame:
    """Adds nm, core array<string>, is_dom, has_dba."""
    out = df.withColumn("_s", base(F.col(column), token_map)).withColumn("is_dom", F.col("_s").rlike(D.DOMAIN).cast("tinyint"))
    out = out.withColumn("_s", F.regexp_replace("_s", D.DOMAIN, " $1 "))
    out = out.withColumn("_s", F.regexp_replace("_s", r"(?<=\b[a-z])\.(?=[a-z]\.)|(?<=\b[a-z]\.[a-z])\.", ""))
    out = out.withColumn("has_dba", F.col("_s").rlike(D.SECOND_NAME).cast("tinyint"))
    for old, new in (("&", " and "), ("+", " and "), ("m/s", " "), ("@", " at ")):
        out = out.withColumn("_s", F.replace("_s", F.lit(old), F.lit(new)))
    digits = "length(regexp_replace(t, '[^0-9]', ''))"
    leet = f"CASE WHEN NOT t RLIKE '^[0-9]+$' AND NOT t RLIKE r'^\\p{{L}}+$' AND {digits} <= 2 AND length(t) - {digits} >= 3 THEN translate(t, '{"".join(D.LEET)}', '{"".join(D.LEET.values())}') ELSE t END"
    out = out.withColumn("_t", F.expr(f"transform({_tokens('_s')}, t -> {leet})"))
    out = out.withColumn("_t", F.expr(f"transform(_t, t -> coalesce(try_element_at({map_sql(D.LEGAL_FORMS)}, t), t))"))
    out = out.withColumn("_k", F.expr(f"array_position(transform(_t, t -> t IN ({words_sql(D.HONORIFIC)})), false)"))
    out = out.withColumn("_t", F.expr("CASE WHEN size(_t) = 0 THEN _t ELSE slice(_t, CASE WHEN _k = 0 THEN size(_t) ELSE cast(_k AS int) END, size(_t)) END"))
    stop, legal = words_sql(D.NAME_STOP), words_sql(D.LEGAL)
    out = out.withColumn("core", F.expr(f"filter(_t, t -> t NOT IN ({legal}) AND t NOT IN ({stop}) AND NOT (t RLIKE '^[0-9]+$' AND length(t) >= 4))"))
    out = out.withColumn("core", F.expr(f"CASE WHEN size(core) > 0 THEN core WHEN size(filter(_t, t -> t NOT IN ({stop}))) > 0 THEN filter(_t, t -> t NOT IN ({stop})) ELSE _t END"))
    return out.withColumn("nm", F.array_join("_t", " ")).drop("_s", "_t", "_k")


def normalise_address(df: DataFrame, column: str, token_map: dict[str, str] | None = None) -> DataFrame:
    """Adds ad, nums array<string>, alph array<string>."""
    out = df.withColumn("_s", base(F.col(column), token_map))
    for old, new in (("n°", " no "), ("#", " ")):
        out = out.withColumn("_s", F.replace("_s", F.lit(old), F.lit(new)))
    out = out.withColumn("_s", F.replace(F.regexp_replace("_s", r"\b(\d{3})\s(\d{3})\b", "$1$2"), F.lit("-"), F.lit(" ")))
    # states of several words, longer names first; only rows that have one go through the replacements
    several = [(name, code) for table in (D.STATES_US, D.STATES_IN) for name, code in sorted(table.items(), key=lambda x: -len(x[0])) if " " in name]
    replaced = F.col("_s")
    for name, code in several:
        replaced = F.regexp_replace(replaced, rf"\b{re.escape(name)}\b", code)
    out = out.withColumn("_s", F.when(F.col("_s").rlike("|".join(re.escape(name) for name, _ in several)), replaced).otherwise(F.col("_s")))
    ordinal = "regexp_replace(t, r'^(\\d+)(?:st|nd|rd|th|er|e|eme|ème)$', '$1')"
    states = {**D.STATES_IN, **D.STATES_US}
    out = out.withColumn("_t", F.expr(f"transform({_tokens('_s')}, t -> {ordinal})"))
    out = out.withColumn("_t", F.expr(f"transform(_t, t -> coalesce(try_element_at({map_sql(D.ADDRESS_WORDS)}, t), t))"))
    out = out.withColumn("_t", F.expr(f"transform(_t, t -> coalesce(try_element_at({map_sql({k: v for k, v in states.items() if ' ' not in k})}, t), t))"))
    out = out.withColumn("nums", F.expr("transform(filter(_t, t -> t RLIKE '[0-9]'), t -> coalesce(nullif(ltrim('0', regexp_replace(t, '[^0-9]', '')), ''), '0'))"))
    out = out.withColumn("alph", F.expr(f"filter(_t, t -> NOT t RLIKE '^[0-9]+$' AND (t RLIKE '[0-9]' OR t NOT IN ({words_sql(D.ADDRESS_ARTICLES)})))"))
    return out.withColumn("ad", F.array_join("_t", " ")).drop("_s", "_t")


def normalise(records: DataFrame, token_map: dict[str, str] | None = None) -> DataFrame:
    """Normalised records: entity_id, src, country, nm, core, ad, nums, alph, is_dom, has_dba and what else there was."""
    out = normalise_address(normalise_name(records, "business_name", token_map), "business_address", token_map)
    return out.drop("business_name", "business_address")


def street(alph: str) -> str:
    """SQL of the street: up to three words and the first street type among the first eight, else two words."""
    k = f"array_position(transform(slice({alph}, 2, 7), t -> t IN ({words_sql(D.STREET_TYPES)})), true)"
    return f"array_join(CASE WHEN {k} > 0 THEN slice({alph}, cast(greatest({k} - 2, 1) AS int), cast(least({k} + 1, 4) AS int)) ELSE slice({alph}, 1, 2) END, ' ')"


def model_text(df: DataFrame) -> DataFrame:
    return df.withColumn("model_text", F.when(F.col("ad") != "", F.concat_ws(" | ", "nm", "ad")).otherwise(F.col("nm")))
