"""Quality gates: drop, warn and constraint checks with counts, all from tables of named predicates."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.fixed import ABSTRACT_OVER, LEAST_YEAR


class Rule(NamedTuple):
    """A SQL predicate over a row, what unknown counts as, and whether a row that fails it goes."""

    test: str
    unknown: bool = False
    drops: bool = True

    def holds(self, **values: object) -> Column:
        return F.coalesce(F.expr(self.test.format(**values)), F.lit(self.unknown))


WORK_RULES = {
    "valid_id": Rule("work_id IS NOT NULL"),
    "has_title": Rule("length(trim(title)) > 0"),
    "has_abstract": Rule(f"length(narrative_abstract) > {ABSTRACT_OVER}"),
    "plausible_year": Rule(f"publication_year BETWEEN {LEAST_YEAR} AND {{this_year}} + 1", unknown=True),
    "has_citations": Rule("size(referenced_works) > 0", drops=False),
}


def works_gates(this_year: int | None = None) -> dict[str, Column]:
    """Gates of cleaned works that drop a row."""
    year = "year(current_date())" if this_year is None else this_year
    return {name: r.holds(this_year=year) for name, r in WORK_RULES.items() if r.drops}


def warn_gates() -> dict[str, Column]:
    """Gates that count and keep the row."""
    return {name: r.holds() for name, r in WORK_RULES.items() if not r.drops}


def _checks(rules: dict[str, str]) -> dict[str, Column]:
    """Constraints of a table; as in SQL checks, unknown passes."""
    return {name: Rule(test, unknown=True).holds() for name, test in rules.items()}


def keep_passing(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Rows that pass every gate; unknown counts as failure."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(g, F.lit(False)) for g in gates.values()]))


def gate_metrics(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, passed, failed) in one pass over ``df``."""
    counted = df.agg(*[F.count_if(F.coalesce(g, F.lit(False))).alias(f"p_{k}") for k, g in gates.items()], F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(f"p_{k}").alias("passed"), (F.col("n") - F.col(f"p_{k}")).alias("failed")) for k in gates])
    return counted.select(F.inline(rows))


def violations(df: DataFrame, rules: dict[str, str], key: str) -> DataFrame:
    """(key, rule) for each broken constraint."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in _checks(rules).items()]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def valid(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break no constraint."""
    return keep_passing(df, _checks(rules))


def with_owner_check(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """Adds ``verdict`` to (collection_id, user_id): ok, missing (no such collection) or denied.

    Only the owner gets ok: a request without a user is denied, and so is any
    for a collection that nobody owns.
    """
    owners = collections.select("collection_id", F.col("user_id").alias("_owner"), F.lit(True).alias("_there"))
    own = F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    verdict = F.when(F.col("_there").isNull(), "missing").when(own, "ok").otherwise("denied")
    return requests.join(owners, "collection_id", "left").withColumn("verdict", verdict).drop("_owner", "_there")
