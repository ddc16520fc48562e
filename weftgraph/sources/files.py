"""Files as tables: CSV, JSON arrays, JSON lines and Parquet, to read and to write."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import spark_type


class FileError(ValueError):
    pass


def kind_of(path: str) -> str:
    name = path.lower().rstrip("*").rstrip("/")
    for end, kind in ((".csv", "csv"), (".jsonl", "jsonl"), (".ndjson", "jsonl"), (".json", "json"), (".parquet", "parquet"), (".tbl", "csv"), (".txt", "csv")):
        if name.endswith(end) or f"{end}/" in name or f"{end}." in name:
            return kind
    raise FileError(f"no format is known for {path}")


def _char(v: Any) -> str:
    return {"\\t": "\t"}.get(str(v), str(v))


def read(spark: SparkSession, paths: list[str], options: dict, headers: list | None = None) -> DataFrame:
    """One DataFrame over files, lists or globs of one format. Options that tune a reader are accepted and left to Spark.

    CSV: delim or delimiter (``|``), header (true), quote, escape, and parallel, batch_size and the like without effect.
    ``headers`` gives names and types; else types are inferred. A file that is a single JSON array is read whole.
    """
    kinds = {options.get("format", kind_of(p)) for p in paths}
    if len(kinds) > 1:
        raise FileError("files of different formats")
    kind = kinds.pop()
    schema = T.StructType([T.StructField(n, spark_type(t)) for n, t in headers]) if headers else None
    if kind == "csv":
        reader = spark.read.option("sep", _char(options.get("delim", options.get("delimiter", options.get("delim_char", "|"))))).option("header", bool(options.get("header", True)))
        reader = reader.option("quote", _char(options.get("quote", '"'))).option("escape", _char(options.get("escape", options.get("quote", '"')))).option("timestampFormat", "yyyy-MM-dd['T'][ ]HH:mm:ss[.SSS]")
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        df = reader.option("multiLine", bool(options.get("multiline", False))).csv(paths)
        if not options.get("header", True) and not schema:
            df = df.toDF(*[f"f{i}" for i in range(len(df.columns))])
        return df
    if kind in ("json", "jsonl"):
        reader = spark.read.option("multiLine", kind == "json")
        return (reader.schema(schema) if schema else reader).json(paths)
    if kind == "parquet":
        df = spark.read.parquet(*paths)
        return df.toDF(*[n for n, _ in headers]) if headers else df
    raise FileError(f"no format {kind}")


def flat(df: DataFrame) -> DataFrame:
    """Structs, lists and maps as JSON texts, for CSV."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task's JSON values as one array; of no rows too."""
    first = True
    for b in batches:
        lines = [f",{x}" for x in b[0].to_pylist()]
        if first and lines:
            lines[0], first = f"[{lines[0][1:]}", False
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])


def write(df: DataFrame, path: str, options: dict) -> None:
    """Writes a folder of part files, as Spark does; for JSON, each of them is an array. Rows stay in their tasks, in order."""
    kind = options.get("format", kind_of(path))
    if kind == "csv":
        w = flat(df).write.mode("overwrite").option("sep", _char(options.get("delim", options.get("delimiter", "|")))).option("header", bool(options.get("header", True)))
        w.option("quote", _char(options.get("quote", '"'))).option("escape", _char(options.get("escape", '"'))).csv(path)
    elif kind == "jsonl":
        df.write.mode("overwrite").json(path)
    elif kind == "json":
        rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
        rows.mapInArrow(_array_lines, "value string").write.mode("overwrite").text(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise FileError(f"no format {kind}")
