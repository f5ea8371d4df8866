"""Which workspaces a step may touch."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rehome.functions.names import LITERAL, has_suffix

# Fixed value: the type of an ordinary workspace, and of the one that reports on the others.
WORKSPACE, ADMIN = "Workspace", "AdminInsights"


def in_scope(
    name: Column | str = "Name",
    *,
    include: list[str] = (),
    exclude: list[str] = (),
    exclude_like: list[str] = (),
    suffix: str | None = None,
    match: str = LITERAL,
) -> Column:
    """One predicate from optional lists; an empty list filters nothing.

    Patterns are used as given. As in SQL, a NULL name fails every list that is not empty.
    """
    name = F.col(name) if isinstance(name, str) else name
    tests = [F.lit(True)]
    if include:
        tests.append(name.isin(list(include)))
    if exclude:
        tests.append(~name.isin(list(exclude)))
    tests.extend(~name.like(pattern) for pattern in exclude_like)
    if suffix:
        tests.append(has_suffix(name, suffix, match))
    return reduce(and_, tests)


def scope(df: DataFrame, name: str = "Name", **lists) -> DataFrame:
    return df.filter(in_scope(name, **lists))


def protect(
    df: DataFrame,
    *,
    self_id: str | None = None,
    source_name: str | None = None,
    id: str = "Id",
    name: str = "Name",
) -> DataFrame:
    """Leave out the workspace that runs the recovery and the one that holds the snapshot."""
    if self_id is not None:
        df = df.filter(F.col(id) != self_id)
    if source_name is not None:
        df = df.filter(F.col(name) != source_name)
    return df


def of_type(df: DataFrame, *types: str, column: str = "type") -> DataFrame:
    return df.filter(F.col(column).isin(list(types)))


def distinct_workspaces(workspaces: DataFrame, **lists) -> DataFrame:
    """Distinct (Id, Type, Name) in scope, without the reporting workspace."""
    kept = workspaces.filter(F.col("Type") != ADMIN)
    return scope(kept, **lists).select("Id", "Type", "Name").distinct()
