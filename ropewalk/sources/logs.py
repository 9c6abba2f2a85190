"""Tables out of JSON reports: scan, extraction, unfolding of iterations, summaries, long form, partitioned files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, report): each report's text; empty files are left out."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("report")).filter(F.trim("report") != "")


def extract(reports: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Adds a column for each name: the value at its JSON path as a number where it is one (else null), and NAME_text."""
    for name, path in fields.items():
        text = F.get_json_object("report", path)
        reports = reports.withColumn(f"{name}_text", text).withColumn(name, F.expr(f"try_cast({name}_text AS DOUBLE)"))
    return reports


def iterations(reports: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """A row for each place of the arrays at the given paths, with its number as iteration."""
    for name, path in arrays.items():
        reports = reports.withColumn(name, F.from_json(F.get_json_object("report", path), "array<double>"))
    zipped = F.arrays_zip(*(F.col(n) for n in arrays))
    rest = [c for c in reports.columns if c not in arrays]
    return reports.select(*rest, F.posexplode(zipped).alias("iteration", "__z")).select(*rest, "iteration", *(F.col(f"__z.{n}").alias(n) for n in arrays))


def options(reports: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The named ones of the key=value pairs, separated by semicolons, that column holds."""
    pairs = F.str_to_map(F.col(column), F.lit(";"), F.lit("="))
    return reports.select("*", *(F.try_element_at(pairs, F.lit(n)).alias(n) for n in names))


def labelled(rows: DataFrame, parts: list[str], name: str = "label") -> DataFrame:
    return rows.withColumn(name, F.concat_ws(" ", *(F.col(p).cast("string") for p in parts)))


def warm(rows: DataFrame) -> DataFrame:
    """Without each report's first iteration."""
    return rows.filter("iteration > 0")


def combined(*tables: DataFrame) -> DataFrame:
    """Rows of all, columns matched by name, missing ones null."""
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def summary(rows: DataFrame, by: list[str], value: str, least: int = 1) -> DataFrame:
    """rows counted, their files, and mean, least and largest value for each group of at least least rows."""
    files = F.concat_ws(",", F.sort_array(F.collect_set("file")))
    values = F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest")
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("nrows"), files.alias("files"), *values)
    return agg.filter(F.col("nrows") >= least)


def means_long(rows: DataFrame, values: list[str], drop: list[str] | None = None) -> DataFrame:
    """Means over all other columns' groups, a row for each value: (…, variable, value)."""
    by = [c for c in rows.columns if c not in values and c not in (drop or [])]
    wide = rows.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))
    return wide.unpivot(by, values, "variable", "value")


def encoded(rows: DataFrame, column: str, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """rows with a number for each label, from 1 in order, and the table of numbers."""
    names = rows.select(column).distinct().withColumn(code, F.row_number().over(Window.orderBy(column)))
    return rows.join(F.broadcast(names) if names.limit(10_001).count() <= 10_000 else names, column), names


def write_parts(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)
