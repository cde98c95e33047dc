"""Registration of queries and assembly of their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfledger.registry.tables import Tables
from shelfledger.registry.views import VIEWS
from shelfledger.session import tune


@dataclass(frozen=True)
class Query:
    """One registered query.

    ``digits`` names the columns whose last decimals depend on the order of
    summation; both sides are rounded alike: line amounts to 4 digits, sums of
    money to 3, totals over a whole table to whole units.
    """

    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(tune(spark), sf_dir))
        if self.digits:
            df = df.withColumns({name: F.round(name, n) for name, n in self.digits.items()})
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        if self.digits:
            rounded = ", ".join(
                f"round({name}, {n}) + 0.0 AS {name}" for name, n in self.digits.items()
            )
            body = f"SELECT * REPLACE ({rounded}) FROM (\n{body}\n)"
        elif body.startswith("WITH"):
            body = f"SELECT * FROM (\n{body}\n)"
        views = _needed_views(body)
        if not views:
            return body
        ctes = ",\n".join(f"{name} AS (\n{VIEWS[name].strip()}\n)" for name in views)
        return f"WITH {ctes}\n{body}"


def _needed_views(sql: str) -> list[str]:
    """Views the text refers to, with theirs, in definition order."""
    found: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in VIEWS:
            if name in words and name not in found:
                found.add(name)
                pending.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None, **digits: int):
    """Decorator: register a function of :class:`Tables` with its SQL."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, build, sql, digits)
        return build

    return wrap
