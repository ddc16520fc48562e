"""Rows in flight: a DataFrame of flat columns, and what its variables are bound to."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BindError(ValueError):
    pass


@dataclass(frozen=True)
class NodeB:
    """Columns {c}__id, {c}__label and {c}__p_{prop} for the loaded properties."""

    c: str
    labels: tuple[str, ...]
    props: tuple[str, ...] = ()
    known: tuple[str, ...] = ()  # all properties of the labels

    def columns(self) -> list[str]:
        return [f"{self.c}__id", f"{self.c}__label", *(f"{self.c}__p_{p}" for p in self.props)]


@dataclass(frozen=True)
class RelB:
    """Columns {c}__src, __slabel, __dst, __dlabel, __type, __eid and {c}__p_{prop}."""

    c: str
    types: tuple[str, ...]
    ends: tuple[tuple[str, str], ...]
    props: tuple[str, ...] = ()
    known: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return [f"{self.c}__{x}" for x in ("src", "slabel", "dst", "dlabel", "type", "eid")] + [f"{self.c}__p_{p}" for p in self.props]


@dataclass(frozen=True)
class PathB:
    """Columns {c}__nodes, {c}__rels (arrays of structs), {c}__len and {c}__cost."""

    c: str
    full: bool = True
    weighted: bool = False

    def columns(self) -> list[str]:
        return [f"{self.c}__len", *([f"{self.c}__nodes", f"{self.c}__rels"] if self.full else []), *([f"{self.c}__cost"] if self.weighted else [])]


@dataclass(frozen=True)
class ValueB:
    c: str

    def columns(self) -> list[str]:
        return [self.c]


Binding = NodeB | RelB | PathB | ValueB


@dataclass
class Scope:
    df: DataFrame | None
    env: dict[str, Binding] = field(default_factory=dict)

    def with_(self, df: DataFrame, **env: Binding) -> Scope:
        return Scope(df, self.env | env)

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for b in self.env.values() for c in b.columns()))

    def trimmed(self) -> Scope:
        return Scope(self.df.select(*self.columns()), dict(self.env))


def renamed(b: Binding, to: str) -> Binding:
    return replace(b, c=to)


def rename_columns(df: DataFrame, b: Binding, to: str) -> tuple[list[Column], Binding]:
    """Columns of ``b`` under the name ``to``, and the binding to them."""
    new = renamed(b, to)
    return [F.col(x).alias(y) for x, y in zip(b.columns(), new.columns(), strict=True)], new
