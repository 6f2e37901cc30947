"""Column names of an operator's own beside whatever columns a caller has."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hidden(df: DataFrame, reserved: Iterable[str]) -> tuple[DataFrame, Callable[[str], str], Callable[..., DataFrame]]:
    """``df`` without columns of the ``reserved`` names: those that clash have other names meanwhile. Also gives the
    name a column has meanwhile, and a function that selects the caller's columns by their own names again, and
    columns that were added."""
    clashes = [c for c in df.columns if c.lower() in set(reserved)]
    other = dict(zip(clashes, free(df, *(f"caller_{c}" for c in clashes))))

    def name(column: str) -> str:
        return other.get(column, column)

    def back(out: DataFrame, *added: str) -> DataFrame:
        return out.select(*[F.col(f"`{name(c)}`").alias(c) for c in df.columns], *added)

    inside = df.select(*[F.col(f"`{c}`").alias(name(c)) for c in df.columns]) if clashes else df
    return inside, name, back
