"""python -m docketry: list the queries, run one, parse briefs, or report on them.

    python -m docketry list
    python -m docketry query NAME SF_DIR [OUT]
    python -m docketry parse BLOCKS RECORDS OUT
    python -m docketry validate BLOCKS RECORDS CASES OUT

BLOCKS and RECORDS are Parquet tables, CASES a folder of case files; OUT is a folder.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from docketry.operators import verify
from docketry.plans import briefs, registry
from docketry.sources import readers


def parsed(spark: SparkSession, blocks: str, records: str) -> briefs.Parsed:
    return briefs.parse(spark.read.parquet(blocks), spark.read.parquet(records))


def save(tables: dict[str, DataFrame], out: str) -> None:
    for name, rows in tables.items():
        readers.write_json(rows, f"{out}/{name}")


def main(args: list[str]) -> int:
    if args == ["list"]:
        print(*sorted(registry.QUERIES), sep="\n")
        return 0
    spark = SparkSession.builder.getOrCreate()
    if len(args) in (3, 4) and args[0] == "query" and args[1] in registry.QUERIES:
        rows = registry.QUERIES[args[1]](spark, args[2])
        rows.write.mode("overwrite").parquet(args[3]) if args[3:] else rows.show(truncate=60)
        return 0
    if len(args) == 4 and args[0] == "parse":
        made = parsed(spark, *args[1:3])
        save({"sections": made.sections, "units": made.units, "citations": made.citations, "propositions": made.propositions, "status": made.status}, args[3])
        return 0
    if len(args) == 5 and args[0] == "validate":
        pages = readers.read_case_pages(spark, args[3])
        cases = verify.case_text(readers.read_cases(spark, args[3]), pages)
        verdicts = briefs.validate(parsed(spark, *args[1:3]), cases, verify.case_pages(pages), args[3])
        save({"validations": verdicts}, args[4])
        readers.write_reports(briefs.report_of(verdicts), f"{args[4]}/reports")
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
