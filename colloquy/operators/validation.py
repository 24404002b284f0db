"""Row rules: good rows on one side, quarantined rows with their reasons on the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import vocab


@dataclass(frozen=True)
class Rule:
    """A condition a row must meet; null counts as not met."""

    reason: str
    condition: Column


def required(name: str) -> Rule:
    return Rule(f"{name} missing", F.col(name).isNotNull())


def non_empty(name: str) -> Rule:
    return Rule(f"{name} empty", F.coalesce(F.col(name), F.lit("")) != "")


def one_of(name: str, values: list[str], optional: bool = False) -> Rule:
    known = F.col(name).isin(values)
    return Rule(f"{name} unknown", known | F.col(name).isNull() if optional else known)


def between(name: str, low: float, high: float, optional: bool = False) -> Rule:
    inside = F.col(name).between(low, high)
    return Rule(f"{name} out of range", inside | F.col(name).isNull() if optional else inside)


def length_between(name: str, low: int, high: int) -> Rule:
    return Rule(f"{name} length", F.length(F.trim(F.col(name))).between(low, high))


def with_reasons(df: DataFrame, rules: list[Rule]) -> DataFrame:
    broken = [F.when(~F.coalesce(r.condition, F.lit(False)), F.lit(r.reason)) for r in rules]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def validate(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    marked = with_reasons(df, rules)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def claim_rules() -> list[Rule]:
    return [
        non_empty("subject"), non_empty("predicate"), non_empty("object"),
        between("confidence", 0.5, 1.0), one_of("source_stance", vocab.SOURCE_STANCES, optional=True),
    ]


def summary_rules() -> list[Rule]:
    return [
        required("summary"),
        one_of("sentiment", vocab.SENTIMENTS),
        between("confidence", 0, 1),
        one_of("controversy_level", vocab.CONTROVERSY_LEVELS),
        one_of("information_density", vocab.INFORMATION_DENSITIES),
    ]


def search_rules() -> list[Rule]:
    """Limits of a search request table (query, max_results, days, predicate)."""
    return [
        Rule("query too short", F.length(F.trim(F.col("query"))) >= 2),
        Rule("query too long", F.length(F.col("query")) <= 500),
        between("max_results", 1, 100, optional=True),
        between("days", 1, 365, optional=True),
        Rule("predicate too long", F.coalesce(F.length("predicate"), F.lit(0)) <= 100),
    ]
