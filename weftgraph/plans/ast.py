"""Syntax trees of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# ---- expressions


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    key: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple
    default: Any


@dataclass(frozen=True)
class Cast:
    value: Any
    type: str


@dataclass(frozen=True)
class Slice:
    of: Any
    lo: Any
    hi: Any


@dataclass(frozen=True)
class Exists:
    paths: tuple
    where: Any = None


@dataclass(frozen=True)
class CountSub:
    paths: tuple
    where: Any = None


@dataclass(frozen=True)
class Quantifier:
    kind: str
    var: str
    of: Any
    where: Any


# ---- patterns


@dataclass(frozen=True)
class NodePattern:
    var: str
    labels: tuple = ()
    props: tuple = ()
    named: bool = True


@dataclass(frozen=True)
class Hops:
    lo: int = 1
    hi: int | None = None
    mode: str = "WALK"
    weight: str | None = None
    rel_var: str | None = None
    node_var: str | None = None
    where: Any = None
    nodes_kept: tuple | None = None
    rels_kept: tuple | None = None


@dataclass(frozen=True)
class RelPattern:
    var: str
    types: tuple = ()
    props: tuple = ()
    direction: str = "out"
    hops: Hops | None = None
    named: bool = True


@dataclass(frozen=True)
class PathPattern:
    nodes: tuple
    rels: tuple
    var: str | None = None


# ---- clauses


@dataclass
class Match:
    paths: list
    where: Any = None
    optional: bool = False
    hint: Any = None


@dataclass
class Item:
    expr: Any
    alias: str | None = None
    text: str = ""


@dataclass
class Projection:
    items: list
    star: bool = False
    distinct: bool = False
    order: list = field(default_factory=list)
    skip: Any = None
    limit: Any = None
    where: Any = None
    last: bool = False


@dataclass
class Unwind:
    expr: Any
    alias: str


@dataclass
class LoadFrom:
    source: Any
    options: dict
    headers: list | None = None
    where: Any = None


@dataclass
class CallSubquery:
    vars: list | None
    query: Any


@dataclass
class CallFunction:
    name: str
    args: list
    yields: list | None = None
    where: Any = None


@dataclass
class Create:
    paths: list


@dataclass
class Merge:
    path: Any
    on_match: list
    on_create: list


@dataclass
class SetItems:
    items: list


@dataclass
class Delete:
    exprs: list
    detach: bool = False


@dataclass
class Single:
    clauses: list


@dataclass
class Union:
    parts: list
    all: bool


# ---- statements


@dataclass
class CreateNodeTable:
    name: str
    columns: list
    key: str
    if_not_exists: bool


@dataclass
class CreateRelTable:
    name: str
    pairs: list
    columns: list
    multiplicity: str
    if_not_exists: bool
    options: dict


@dataclass
class DropTable:
    name: str
    if_exists: bool


@dataclass
class AlterTable:
    name: str
    action: str
    args: dict


@dataclass
class CopyFrom:
    name: str
    source: Any
    options: dict
    columns: list | None = None


@dataclass
class CopyTo:
    query: Any
    path: str
    options: dict


@dataclass
class CreateMacro:
    """A scalar macro: ``params`` are (name, default or None), ``body`` is an expression over them."""

    name: str
    params: tuple
    body: Any


@dataclass
class Admin:
    action: str
    args: list


@dataclass
class Explain:
    query: Any
    profile: bool = False


def walk(x: Any):
    """All nodes of a syntax tree, x first."""
    yield x
    if hasattr(x, "__dataclass_fields__"):
        for f in x.__dataclass_fields__:
            yield from walk(getattr(x, f))
    elif isinstance(x, (tuple, list)):
        for y in x:
            yield from walk(y)
    elif isinstance(x, dict):
        for y in x.values():
            yield from walk(y)
