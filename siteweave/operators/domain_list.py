"""Domain lists: accepted domains, rejects, and what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siteweave.functions.domains import extract_domain, normalize_domain
from siteweave.functions.text import strip
from siteweave.plans.skew import first_per_key


def _entries(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor a comment, with their domain."""
    line = strip(F.col("line"))
    return lines.select(
        "line_no", line.alias("line"), extract_domain(F.col("line")).alias("domain")
    ).where((F.col("line") != "") & ~F.col("line").startswith("#"))


def accept(lines: DataFrame) -> DataFrame:
    """Each valid domain once, with the number of its first line.

    One pre-aggregated ``min`` per domain: a domain repeated on a third of all lines costs one row
    per task in the shuffle.
    """
    valid = _entries(lines).where(F.col("domain").isNotNull())
    return first_per_key(valid, "domain", "line_no").select("line_no", "domain")


def reject(lines: DataFrame) -> DataFrame:
    """Invalid and repeated lines with their message, as ``(line_no, reason, message)``.

    A valid line is a repetition unless it is some domain's first line; that test joins on the
    unique line number, not on the domain. Sort by ``line_no`` when writing a report.
    """
    entries = _entries(lines)
    number = F.col("line_no").cast("string")
    invalid = entries.where(F.col("domain").isNull()).select(
        "line_no",
        F.lit("invalid").alias("reason"),
        F.concat(
            F.lit("Line "), number, F.lit(": Invalid domain/URL '"), F.col("line"), F.lit("'")
        ).alias("message"),
    )
    repeated = (
        entries.where(F.col("domain").isNotNull())
        .join(accept(lines).select("line_no"), "line_no", "left_anti")
        .select(
            "line_no",
            F.lit("duplicate").alias("reason"),
            F.concat(
                F.lit("Line "), number, F.lit(": Duplicate domain '"), F.col("domain"), F.lit("'")
            ).alias("message"),
        )
    )
    return invalid.unionByName(repeated)


def limit_domains(accepted: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` accepted domains; all of them without a positive limit."""
    return accepted.orderBy("line_no").limit(limit) if limit and limit > 0 else accepted


def remaining(domains: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``domains`` whose normalized domain is not among the ``done`` ones."""
    keyed = done.select(normalize_domain(F.col("domain")).alias("__done")).distinct()
    return domains.join(keyed, normalize_domain(domains["domain"]) == keyed["__done"], "left_anti")


def stage_pending(domains: DataFrame, stage: DataFrame) -> DataFrame:
    """Domains without a record in a stage table. A failed record counts as done."""
    return domains.join(stage.select("domain").distinct(), "domain", "left_anti")
