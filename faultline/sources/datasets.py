"""Labelled datasets: scan, cleaning, alignment of two datasets, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schema

DEFAULT_DATASET = "all_projects_combined.csv"
_DESCRIPTION = {
    "file_path": "string",
    "function_name": "string",
    "function_start_line": "int",
    "function_end_line": "int",
    "is_method": "boolean",
    "class_name": "string",
    "commit_hash": "string",
    "commit_message": "string",
    "author": "string",
    "date": "string",
    "label": "string",
}


def read_labelled(
    spark: SparkSession, path: str | None = None, default: str = DEFAULT_DATASET, format: str | None = None
) -> DataFrame:
    """A labelled dataset from CSV (typed by the known column names), Parquet or another format."""
    path = path or default
    format = format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if format != "csv":
        df = spark.read.format(format).load(path)
    else:
        header = spark.read.option("header", True).csv(path).columns
        types = _DESCRIPTION | {f: "string" for f in header if f not in _DESCRIPTION}
        fields = ", ".join(f"`{c}` {types[c]}" for c in header)
        df = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .schema(fields)
            .csv(path)
        )
    if "label" not in df.columns:
        raise ValueError("a labelled dataset needs a 'label' column holding BUGGY or CLEAN")
    return df


def write_dataset(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(format).save(path)
    return path


def sanitized(column: Column | str) -> Column:
    """A finite double; anything else is 0."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.coalesce(F.when(~bad, value), F.lit(0.0))


def binary_label(label="label") -> Column:
    return F.coalesce((F.col(label) == schema.BUGGY).cast("int"), F.lit(0))


def feature_columns(df: DataFrame, whitelist: list[str], extra: list[str] | None = None) -> list[str]:
    """Whitelisted columns of the data, then the derivable ones, then any extra features asked for."""
    present = [c for c in whitelist if c in df.columns and c not in schema.LEAKING_COLUMNS]
    if "added_lines" in df.columns:
        present += [c for c in ("total_changes", "net_lines", "code_churn") if c not in present]
    return present + [c for c in (extra or []) if c in df.columns and c not in present]


def prepare(
    df: DataFrame,
    whitelist: list[str] | None = None,
    keep: list[str] | None = None,
    extra_features: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Narrow to safe features, derive missing ones, clean numbers, add the 0/1 label ``y``."""
    columns = feature_columns(df, whitelist or schema.SAFE_FEATURES, extra_features)
    a, d = (sanitized(c) if c in df.columns else F.lit(0.0) for c in ("added_lines", "deleted_lines"))
    derived = {"total_changes": a + d, "net_lines": a - d, "code_churn": a + d}
    features = [
        (sanitized(c) if c in df.columns else derived[c]).alias(c) for c in columns
    ]
    return df.select(*(keep or []), *features, binary_label().alias("y")), columns


def size_warning(df: DataFrame, mined: bool = False) -> DataFrame:
    """One row: number of rows and a verdict on whether that is enough to learn from."""
    n = F.count(F.lit(1))
    verdict = F.when(n < 20, "very small").when(n < 100, "small").otherwise("ok")
    if mined:
        verdict = F.when(n < 50, "very small mined set").otherwise(verdict)
    return df.agg(n.alias("n_rows"), verdict.alias("verdict"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _default_for(name: str, kind: T.DataType) -> Column:
    if name == "label":
        return F.lit(schema.CLEAN)
    if name in schema.TEXT_COLUMNS or isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(kind)


def aligned_union(base: DataFrame, mined: DataFrame) -> DataFrame:
    """All rows of both over the union of their columns; missing ones get typed defaults, label last."""
    kinds = {f.name: f.dataType for f in [*mined.schema, *base.schema]}
    names = [*base.columns, *[c for c in mined.columns if c not in base.columns]]
    order = [c for c in names if c != "label"] + ["label"]
    kinds.setdefault("label", T.StringType())

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(
            *[
                (F.col(c).cast(kinds[c]) if c in df.columns else _default_for(c, kinds[c])).alias(c)
                for c in order
            ]
        )

    return shaped(base).unionByName(shaped(mined))
