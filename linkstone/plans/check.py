"""Checks the files of a finished linkage; the exit status is 1 if a result is wrong.

    spark-submit linkstone/plans/check.py --data DIR --out DIR [--split test]

DIR of --data has {split}_source{1,2,3}.tsv, that of --out has matching_results and, if made,
candidate_pairs.  Matches that are no candidates are told as a warning.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.operators import validate
from linkstone.sources import records as io

LISTS = {"matching_results": "matched_entity_ids", "candidate_pairs": "candidate_entity_ids"}


def _lists(spark: SparkSession, path: str, column: str) -> tuple[DataFrame, str | None]:
    """Parsed lines of an id list, and what is wrong with its header."""
    lines = spark.read.text(path)
    header = lines.where(F.lower("value").startswith("source1_entity_id")).limit(1).collect() or lines.limit(1).collect()
    problem = validate.header_problem(header[0][0] if header else None, ("source1_entity_id", column))
    return validate.parse_lines(lines.where(F.col("value") != F.lit(header[0][0] if header else ""))), problem


def check(spark: SparkSession, data: str, out: str, split: str = "test", names: tuple[str, ...] = ("matching_results",)) -> DataFrame:
    """(file, check, n, examples) of the named lists against the ids of the source files."""
    queries = io.read_first_column(spark, f"{data}/{split}_source1.tsv").withColumnRenamed("entity_id", "s1").distinct()
    known = reduce(DataFrame.unionByName, [io.read_first_column(spark, f"{data}/{split}_source{k}.tsv") for k in (2, 3)]).select(F.col("entity_id").alias("id")).distinct()
    found, pairs = [], {}
    for name in names:
        lists, problem = _lists(spark, f"{out}/{name}", LISTS[name])
        findings = validate.validate(lists, queries, known)
        if problem:
            findings = findings.unionByName(spark.createDataFrame([("header", problem)], "check string, subject string"))
        found.append(validate.report(findings).select(F.lit(name).alias("file"), "check", "n", "examples"))
        pairs[name] = lists.select("s1", F.explode("ids").alias("cand"))
    if len(pairs) == 2:
        apart = validate.report(validate.not_candidates(pairs["matching_results"], pairs["candidate_pairs"]))
        found.append(apart.select(F.lit("matching_results").alias("file"), "check", "n", "examples"))
    return reduce(DataFrame.unionByName, found)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("data", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--split", default="test")
    parser.add_argument("--candidates", action="store_true", help="check candidate_pairs too")
    given = parser.parse_args(args)
    names = ("matching_results", "candidate_pairs") if given.candidates else ("matching_results",)
    rows = check(SparkSession.builder.getOrCreate(), given.data, given.out, given.split, names).collect()
    for row in sorted(rows):
        print("\t".join(map(str, row)))
    return int(any(r["check"] != "not_candidate" for r in rows))


if __name__ == "__main__":
    raise SystemExit(main())
