"""Bulk loading of whole graphs by a specification, and small graphs to try things on.

A specification names node and relationship tables and where their rows come from::

    {"nodes": [{"label": "Person", "key": "id", "columns": {"id": "INT64", "name": "STRING"}, "source": "person.csv", "options": {"delim": "|"}}],
     "relationships": [{"type": "KNOWS", "from": "Person", "to": "Person", "columns": {"weight": "DOUBLE"}, "source": "knows.csv", "multiplicity": "MANY_TO_MANY"}]}

``source`` is a path, a list of paths or a pattern, relative to the specification's own folder, or a DataFrame; without
one the table stays empty. The first two columns of a relationship's source are the keys of its ends.
"""

from __future__ import annotations

import json
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from .session import GraphDatabase


def read_spec(spark: SparkSession, path: str) -> dict:
    """A specification from a JSON or YAML file, read by Spark, so it may lie in any store that Spark reaches."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML specifications need the yaml package; give JSON") from e
    return yaml.safe_load(text)


def load(db: GraphDatabase, spec: dict | str) -> None:
    """Creates the tables of a specification and loads their rows, nodes first."""
    folder = ""
    if isinstance(spec, str):
        folder, spec = spec.rsplit("/", 1)[0] + "/" if "/" in spec else "", read_spec(db.spark, spec)
    c = db.connect()
    for n in spec.get("nodes", []):
        c.execute(f"CREATE NODE TABLE {n['label']}({_columns(n['columns'])}, PRIMARY KEY({n['key']}))")
    for r in spec.get("relationships", []):
        own = _columns(r.get("columns", {}))
        c.execute(f"CREATE REL TABLE {r['type']}(FROM {r['from']} TO {r['to']}{', ' + own if own else ''}, {r.get('multiplicity', 'MANY_TO_MANY')})")
    for x in [*spec.get("nodes", []), *spec.get("relationships", [])]:
        _copy(db, c, x.get("label") or x["type"], x, folder)


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _copy(db: GraphDatabase, c: Any, name: str, x: dict, folder: str) -> None:
    source = x.get("source")
    if source is None:
        return
    if isinstance(source, DataFrame):
        table = f"_source_{name}"
        db.register_table(table, source)
        try:
            c.execute(f"COPY {name} FROM {table}")
        finally:
            del db.tables[table]
        return
    for path in [source] if isinstance(source, str) else source:
        at = path if path.startswith("/") or ":" in path else folder + path
        options = ", ".join(f"{k}={json.dumps(v)}" for k, v in x.get("options", {}).items())
        c.execute(f"COPY {name} FROM {json.dumps(at)}{f' ({options})' if options else ''}")


def available() -> list[str]:
    return ["modern", "trade"]


def spec(spark: SparkSession, name: str) -> dict:
    """``modern``: six people and programs, as in many graph tutorials; ``trade``: towns, roads with lengths and goods."""
    if name == "modern":
        people = [(1, "marko", 29), (2, "vadas", 27), (4, "josh", 32), (6, "peter", 35)]
        software = [(3, "lop", "java"), (5, "ripple", "java")]
        return {
            "nodes": [
                {"label": "person", "key": "id", "columns": {"id": "INT64", "name": "STRING", "age": "INT32"}, "source": spark.createDataFrame(people, "id long, name string, age int")},
                {"label": "software", "key": "id", "columns": {"id": "INT64", "name": "STRING", "lang": "STRING"}, "source": spark.createDataFrame(software, "id long, name string, lang string")},
            ],
            "relationships": [
                {"type": "knows", "from": "person", "to": "person", "columns": {"weight": "DOUBLE"}, "source": spark.createDataFrame([(1, 2, 0.5), (1, 4, 1.0)], "a long, b long, weight double")},
                {"type": "created", "from": "person", "to": "software", "columns": {"weight": "DOUBLE"}, "source": spark.createDataFrame([(1, 3, 0.4), (4, 3, 0.4), (4, 5, 1.0), (6, 3, 0.2)], "a long, b long, weight double")},
            ],
        }
    if name == "trade":
        towns = [(i, t) for i, t in enumerate(["Ael", "Bor", "Cyn", "Dun", "Ebb"])]
        roads = [(0, 1, 4), (1, 2, 3), (2, 3, 2), (3, 4, 7), (4, 0, 5), (0, 2, 8), (1, 3, 6)]
        return {
            "nodes": [{"label": "town", "key": "id", "columns": {"id": "INT64", "name": "STRING"}, "source": spark.createDataFrame(towns, "id long, name string")}],
            "relationships": [{"type": "road", "from": "town", "to": "town", "columns": {"miles": "INT32"}, "source": spark.createDataFrame(roads, "a long, b long, miles int")}],
        }
    raise ValueError(f"no dataset {name}; there are {', '.join(available())}")
