"""Scans and sinks of files: JSON lines, Parquet, dumps by step, metric logs, and results that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, where: Column | None = None) -> DataFrame:
    """Lines of JSON; blank lines are skipped, a line that isn't JSON is an error. The schema is given, so that the files are read once."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if where is None else rows.where(where)


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> str:
    """A line of JSON for each row, null fields included; with `by`, in a folder for each of its values."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def dump_generations(rows: DataFrame, path: str, extras: list[str] | None = None) -> str:
    """(step, input, output, gts, score and extras) in a folder for each step; other columns stay behind."""
    return write_jsonl(rows.select("step", "input", "output", "gts", "score", *(extras or [])), path, "step")


def browse_dumps(spark: SparkSession, path: str, schema: str, mask: str = "") -> DataFrame:
    """All dumps below path, with strings that the pattern matches replaced by * in input and output."""
    rows = spark.read.schema(schema).json(path)
    if not mask:
        return rows
    return rows.withColumns({c: F.regexp_replace(c, mask, "*") for c in ("input", "output")})


def nested(df: DataFrame, keys: list[str]) -> Column:
    """A column by a path of field names."""
    out = F.col(keys[0])
    for k in keys[1:]:
        out = out[k]
    return out


def prompt_response(df: DataFrame, prompt: list[str], response: list[str]) -> DataFrame:
    """The two texts of supervised rows, wherever they are nested."""
    return df.select("*", nested(df, prompt).cast("string").alias("prompt_text"), nested(df, response).cast("string").alias("response_text"))


def flatten_fields(schema: T.StructType, sep: str = "/", head: tuple[str, ...] = ()) -> list[Column]:
    """A column for each leaf of a nested row, named by its path."""
    out: list[Column] = []
    for f in schema.fields:
        path = (*head, f.name)
        if isinstance(f.dataType, T.StructType):
            out += flatten_fields(f.dataType, sep, path)
        else:
            out.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
    return out


def sanitized_key(name: Column) -> Column:
    """A metric's name for stores that take few signs: @ is written out, runs of slashes are one, other signs become underscores."""
    return F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("@"), F.lit("_at_")), "/+", "/"), r"[^/\w.\- :]", "_")


def metric_lines(long: DataFrame) -> DataFrame:
    """(step, name, value) -> step, data: a line of a metric file for each step."""
    return long.groupBy("step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("data"))


def console_line(step: Column, metrics: Column) -> Column:
    """step:1 - name:value - ..., in the order of the array of (name, value)."""
    return F.concat(F.lit("step:"), step.cast("string"), F.array_join(F.transform(metrics, lambda m: F.concat(F.lit(" - "), m["name"], F.lit(":"), m["value"].cast("string"))), ""))


def computed_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where it is missing or can't be read in whole, it is made and written first."""
    try:
        found = spark.read.parquet(path)
        found.count()
        return found
    except Exception as e:  # noqa: BLE001  a missing path and a broken file have several classes
        if "PATH_NOT_FOUND" not in str(e) and "CANNOT_READ" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_key(*parts: object) -> str:
    """Experiment, project, batch size and number of samples, as a folder's name."""
    return "_".join(str(p).replace("/", "_") for p in parts)


def with_responses(samples: DataFrame, row: str, order: str, text: str) -> DataFrame:
    """A table of samples (row, order, text) as one row for each `row` with its responses in order."""
    return samples.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("responses"))
