"""Named checks: a Spark query over the inputs and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from checks.inputs import Inputs


@dataclass(frozen=True)
class Check:
    run: Callable[[Inputs], DataFrame]
    sql: str | None
    bench: bool


CHECKS: dict[str, Check] = {}
FRAGMENTS: dict[str, str] = {}


def check(name: str, sql: str | None = None, bench: bool = False):
    def keep(run: Callable[[Inputs], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"check {name} is defined twice")
        CHECKS[name] = Check(run, sql, bench)
        return run

    return keep
