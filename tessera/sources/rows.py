"""Row files: strict JSON lines, tolerant record files, CSV and durable logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.keys import unique_index


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a fixed schema. Blank lines are skipped; a line that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON list (or object) per file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_records(spark: SparkSession, path: str, record: T.StructType, wrappers: Sequence[str] = ("data", "dialogues", "conversations", "items")) -> DataFrame:
    """Records from JSON lines, a list, or an object that wraps a list under one of some names.

    Files are read whole, one to a row, and their shape is told by their first character and parse; files stay apart.
    A line that is no JSON fails the read.
    """
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = T.ArrayType(record)
    wrapped = T.StructType([T.StructField(w, listed) for w in wrappers])
    as_object = F.from_json("v", wrapped)
    inner = F.coalesce(*[as_object[w] for w in wrappers])
    lines = F.filter(F.transform(F.filter(F.split("v", r"\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, record, {"mode": "FAILFAST"})), lambda r: r.isNotNull())
    rows = F.when(F.col("v").startswith("["), F.from_json("v", listed)).when(inner.isNotNull(), inner).otherwise(lines)
    return raw.select(F.explode(rows).alias("r")).select("r.*")


def sorted_fields(df: DataFrame) -> DataFrame:
    """Columns and nested fields by name, so that written objects are canonical."""

    def order(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, order(f.dataType), f.nullable) for f in sorted(kind.fields, key=lambda f: f.name)])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(order(kind.elementType), kind.containsNull)
        return kind

    def pick(col, kind: T.DataType):
        if isinstance(kind, T.StructType):
            fields = sorted(kind.fields, key=lambda f: f.name)
            return F.when(col.isNotNull(), F.struct(*[pick(col[f.name], f.dataType).alias(f.name) for f in fields]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(col, lambda x: pick(x, kind.elementType))
        return col

    return df.select(*[pick(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def canonical_json(df: DataFrame) -> DataFrame:
    """``json``: each row as one object with sorted fields, nulls kept."""
    s = sorted_fields(df)
    return s.select(F.to_json(F.struct(*s.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite; Spark's committer makes the new files visible together."""
    sorted_fields(df).write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append to a durable log, from which ``resume`` finds what is done."""
    sorted_fields(df).write.mode("append").json(path)


def resume(jobs: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Jobs that the log at ``path`` has no row for; all of them if there is no log."""
    from pyspark.errors import AnalysisException

    kinds = dict(jobs.dtypes)
    try:
        done = jobs.sparkSession.read.schema(", ".join(f"`{k}` {kinds[k]}" for k in keys)).json(path).distinct()
        return jobs.join(done, list(keys), "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return jobs


def read_keyed(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Strict rows whose keys are whole and unique; fails otherwise."""
    return unique_index(read_jsonl(spark, path, schema), keys)


def read_annotations(spark: SparkSession, path: str, domain: Sequence[str] = ("A", "B", "tie")) -> DataFrame:
    """CSV files of one annotator each, who is named by the file; values outside the domain fail the job when they are read."""
    schema = "pair_code string, preference string, notes string"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    who = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1)
    bad = F.raise_error(F.concat(F.lit("preference outside the domain: "), F.coalesce("preference", F.lit("null"))))
    return rows.select("pair_code", F.when(F.col("preference").isin(*domain), F.col("preference")).otherwise(bad.cast("string")).alias("preference"), "notes", who.alias("annotator"))


def write_summary_csv(df: DataFrame, path: str, places: int = 3) -> None:
    """One small file with a header, doubles rounded."""
    cols = [F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def usage_totals(df: DataFrame, usage: str, price_in: float, price_out: float) -> DataFrame:
    """Sums of a nested usage struct's tokens, nulls as 0, and their price per million."""
    n = lambda f: F.coalesce(F.sum(F.coalesce(F.col(f"{usage}.{f}"), F.lit(0))), F.lit(0))
    cost = (n("prompt_tokens") * price_in + n("completion_tokens") * price_out) / 1e6
    return df.agg(F.count("*").alias("calls"), n("prompt_tokens").alias("prompt_tokens"), n("completion_tokens").alias("completion_tokens"), n("cached_tokens").alias("cached_tokens"), cost.alias("cost"))
