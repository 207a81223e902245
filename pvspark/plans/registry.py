"""The register of the archive's queries with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pvspark.sources.bindings import Bound, ctes

_REGISTERED: dict[str, tuple[Callable[[Bound], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        _REGISTERED[name or f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Bound(spark, sf_dir))) for name, (f, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"{ctes()}{'' if sql.lstrip().startswith(',') else chr(10)}{sql}" for name, (_, sql) in _REGISTERED.items() if sql}
