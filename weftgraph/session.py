"""GraphDatabase, Connection and Result."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import datasets
from .catalog import CatalogError, PropertyGraph
from .operators import ddl, dml
from .plans import ast as A
from .plans.lower import Lowering
from .plans.parser import parse

VERSION = "0.1.0"


class Result:
    """A lazy result; rows are computed when they are asked for."""

    def __init__(self, df: DataFrame | None):
        self.df = df
        self._rows: list | None = None

    @property
    def column_names(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def rows(self) -> list[tuple]:
        if self._rows is None:
            self._rows = [tuple(r) for r in self.df.collect()] if self.df is not None else []
        return self._rows

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.rows())

    def __len__(self) -> int:
        return len(self.rows())

    def __getitem__(self, i: int) -> tuple:
        return self.rows()[i]

    def to_arrow(self):
        return self.df.toArrow()

    def get_bolt_response(self) -> str:
        """Column names and rows as JSON text."""
        rows = [json.loads(x) for x in self.df.toJSON().collect()] if self.df is not None else []
        return json.dumps({"keys": self.column_names, "records": rows})


class GraphDatabase:
    """A property graph; ``mode`` "r" forbids changes. ``path`` is a folder that CHECKPOINT writes and that is opened if it holds a graph."""

    def __init__(self, spark: SparkSession, path: str | None = None, mode: str = "rw", graph: PropertyGraph | None = None):
        self.spark, self.path, self.mode = spark, path, mode
        self.version = VERSION
        self.graph = graph or (ddl.restore(spark, path) if path else None) or PropertyGraph(spark)
        self.functions: dict[str, Any] = {"scalar:": {}, "macro:": {}, "show_loaded_extensions": ddl.loaded_extensions, "show_tables": ddl.show_tables}
        self.tables: dict[str, DataFrame] = {}

    @classmethod
    def from_builtin_dataset(cls, spark: SparkSession, name: str) -> GraphDatabase:
        db = cls(spark)
        db.load_builtin_dataset(name)
        return db

    def load_builtin_dataset(self, name: str) -> None:
        """Adds one of the small graphs named by ``datasets.available()``."""
        self.load_graph(datasets.spec(self.spark, name))

    def load_graph(self, spec: dict | str) -> None:
        """Bulk loading by a specification, given as a dict or as the path of a JSON or YAML file (see ``datasets.load``)."""
        datasets.load(self, spec)

    def connect(self) -> Connection:
        return Connection(self)

    def close(self) -> None:
        self.graph = PropertyGraph(self.spark)

    def register_function(self, name: str, build: Callable) -> None:
        """A scalar function: takes and returns Columns (a Pandas UDF is one such)."""
        self.functions["scalar:"][name.lower()] = build

    def register_table_function(self, name: str, build: Callable) -> None:
        """CALL name(...): takes the graph and the arguments and returns a DataFrame."""
        self.functions[name.lower()] = build

    def register_table(self, name: str, df: DataFrame) -> None:
        """A DataFrame that LOAD FROM and COPY FROM can name."""
        self.tables[name] = df


class Connection:
    def __init__(self, db: GraphDatabase):
        self.db = db

    def execute(self, query: str, access_mode: str = "", parameters: dict[str, Any] | None = None) -> Result:
        statement = parse(query)
        if isinstance(statement, A.Explain):
            df = self._run(statement.query, parameters).df
            plan = df._jdf.queryExecution().toString() if df is not None else ""
            return Result(self.db.spark.createDataFrame([(plan,)], "plan string"))
        if self.db.mode == "r" and dml.changes(statement):
            raise PermissionError("the database is open for reading only")
        return self._run(statement, parameters)

    def _run(self, s: Any, parameters: dict | None) -> Result:
        db = self.db
        low = Lowering(db.graph, parameters, db.functions, db.tables)
        if isinstance(s, (A.Single, A.Union)):
            return Result(dml.run(s, low) if dml.changes(s) else low.query(s))
        if isinstance(s, (A.CreateNodeTable, A.CreateRelTable, A.DropTable, A.AlterTable)):
            ddl.run(s, low)
        elif isinstance(s, A.CreateMacro):
            if s.name in db.functions["macro:"]:
                raise CatalogError(f"macro {s.name} already exists")
            db.functions["macro:"][s.name] = s
        elif isinstance(s, A.CopyFrom):
            dml.copy_from(s, low)
        elif isinstance(s, A.CopyTo):
            dml.copy_to(s, low)
        elif isinstance(s, A.Admin):
            ddl.admin(s, db)
        return Result(None)

    def get_schema(self) -> dict:
        return self.db.graph.schema()

    def close(self) -> None:
        pass
