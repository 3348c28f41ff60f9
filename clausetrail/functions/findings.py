"""Findings as arrays of small structs: building, ordering and reading them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausetrail import rules as R

FINDING = "struct<id:string,severity:string,confidence:string,detail:array<string>>"


def severity_rank(severity: Column) -> Column:
    chain = F.lit(0)
    for name, rank in R.SEVERITY_RANK.items():
        chain = F.when(severity == name, F.lit(rank)).otherwise(chain)
    return chain


def finding(
    when: Column, id: str, severity: Column | str, detail: Column | None = None, confidence: Column | str | None = None
) -> Column:
    """The finding struct where ``when`` holds, else NULL."""

    def text(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    empty = F.array().cast("array<string>")
    row = F.struct(
        F.lit(id).alias("id"),
        text(severity).alias("severity"),
        text(confidence).alias("confidence"),
        (empty if detail is None else F.coalesce(detail, empty)).alias("detail"),
    ).cast(FINDING)
    return F.when(F.coalesce(when, F.lit(False)), row)


def findings(*items: Column) -> Column:
    """Present findings, most severe first, otherwise in the order given."""
    ranked = F.array_compact(
        F.array(
            *[
                F.when(item.isNotNull(), F.struct((-severity_rank(item["severity"])).alias("rank"), F.lit(i).alias("pos"), item.alias("item")))
                for i, item in enumerate(items)
            ]
        )
    )
    return F.transform(F.array_sort(ranked), lambda r: r["item"])


def ids(found: Column) -> Column:
    """Finding ids in order as one text, for comparing and reports."""
    return F.array_join(F.transform(found, lambda f: f["id"]), "|")


def id_severities(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["id"], f["severity"])), "|")


def max_severity(severities: Column, default: str = "low") -> Column:
    """Highest severity of an array of severities."""
    top = F.array_max(F.transform(severities, severity_rank))
    return F.when(top == 3, F.lit("high")).when(top == 2, F.lit("medium")).otherwise(F.lit(default))
