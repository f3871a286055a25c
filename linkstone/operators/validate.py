"""Checks of id-list outputs; each finding is a row (check, subject)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """(s1, ids array, bad) of text lines ``value`` without their header."""
    parts = F.split("value", "\t", 2)
    ids = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: x != "")
    return lines.select(F.get(parts, F.lit(0)).alias("s1"), ids.alias("ids"), (~F.col("value").contains("\t")).alias("bad"))


def header_problem(first_line: str | None, columns: tuple[str, str]) -> str | None:
    """What is wrong with a file's first line, if anything."""
    if not first_line:
        return "empty"
    names = [n.strip().lower() for n in first_line.split("\t")]
    if len(names) == 1 and "," in first_line:
        return "comma_separated"
    return None if names == list(columns) else "header"


def validate(lists: DataFrame, queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Findings of ``lists`` (s1, ids[, bad]) against all ``queries`` (s1) and, if given, the ``known`` ids (id)."""
    bad = F.col("bad") if "bad" in lists.columns else F.lit(False)
    rows = lists.select("s1", "ids", bad.alias("bad"))
    found = lambda df, check, subject: df.select(F.lit(check).alias("check"), F.col(subject).alias("subject"))
    good = rows.where("NOT bad")
    each = good.select("s1", F.explode("ids").alias("id"))
    out = found(rows.where("bad"), "malformed", "s1")
    parts = [
        found(good.groupBy("s1").count().where("count > 1"), "duplicate_row", "s1"),
        found(good.where(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicate_id", "s1"),
        found(each.where("id LIKE 'S1-%'"), "self_match", "id"),
        found(each.where("NOT id RLIKE '^S[123]-'"), "wrong_prefix", "id"),
        found(queries.join(good.select("s1").distinct(), "s1", "left_anti"), "missing_row", "s1"),
        found(good.join(queries.select("s1"), "s1", "left_anti"), "extra_row", "s1"),
    ]
    if known is not None:
        parts.append(found(each.where("id RLIKE '^S[23]-'").join(known.select("id"), "id", "left_anti"), "unknown_id", "id"))
    for part in parts:
        out = out.unionByName(part)
    return out


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that are not candidate pairs (a warning)."""
    return matches.join(candidates.select("s1", "cand"), ["s1", "cand"], "left_anti").select(F.lit("not_candidate").alias("check"), F.col("cand").alias("subject"))


def report(findings: DataFrame, examples: int = 5) -> DataFrame:
    """(check, n, examples): findings by kind, with the first few subjects in order."""
    return findings.groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("subject")), 1, examples), ",").alias("examples"))
