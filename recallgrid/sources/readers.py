"""Files that feed the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import text

DOCUMENT = "id string, source string, text string, meta map<string,string>"


def spool(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON-lines spool; blank and broken lines are left out. A document without id takes one from its text."""
    rows = spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path)
    return with_id(rows.where("text IS NOT NULL OR id IS NOT NULL"))


def with_id(documents: DataFrame) -> DataFrame:
    return documents.withColumn("id", F.coalesce(F.when(F.length("id") > 0, F.col("id")), text.short_hash(F.coalesce("text", F.lit("")), 16)))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, section) of Markdown files cut at the section sign."""
    return split_sections(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")), "§")


def split_sections(texts: DataFrame, sign: str) -> DataFrame:
    parts = F.explode(F.split("text", sign))
    keep = [c for c in texts.columns if c != "text"]
    return texts.select(*keep, parts.alias("section")).select(*keep, F.trim(F.regexp_replace("section", r"^(?U)\s+|\s+$", "")).alias("section")).where("section <> ''")


def json_list(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The objects of an array field of a JSON file."""
    return spark.read.schema(f"{field} array<struct<{schema}>>").json(path, multiLine=True).select(F.explode(field).alias("x")).select("x.*")


def calendar(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, status string, summary string, description string, location string, start string, `end` string"
    return spark.read.schema(schema).json(path, multiLine=True)


def table(spark: SparkSession, path: str, schema: str, without: str | None = None) -> DataFrame:
    """A Parquet table in parts (part=...), or an empty one where there is none; without leaves one part out."""
    from pyspark.errors import AnalysisException
    from pyspark.sql.types import StringType, StructType

    wanted = StructType.fromDDL(schema)
    try:
        found = spark.read.schema(StructType(wanted.fields).add("part", StringType())).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], wanted)
    if without is not None:
        found = found.where(F.col("part").isNull() | (F.col("part") != without))
    return found.select(*wanted.names)


def settings(path: str) -> dict:
    """Settings from a JSON file or one of plain ``name: value`` lines; lists are comma-separated in brackets. A missing file has none.

    Values of either kind may be left to the environment: ``${NAME}`` stands for the variable, or for nothing where it is unset.
    """
    import json
    import os
    import re

    try:
        with open(path, encoding="utf-8") as file:
            body = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), file.read())
    except FileNotFoundError:
        return {}
    if body.lstrip().startswith("{"):
        return json.loads(body)

    def value(word: str):
        word = word.strip()
        if word.startswith("[") and word.endswith("]"):
            return [value(x) for x in word[1:-1].split(",") if x.strip()]
        if word.lower() in ("true", "false"):
            return word.lower() == "true"
        try:
            return int(word) if re.fullmatch(r"[-+]?\d+", word) else float(word)
        except ValueError:
            return word.strip("'\"")

    found = {}
    for line in body.splitlines():
        name, sign, rest = line.split("#")[0].partition(":")
        if sign and rest.strip() and not line.startswith((" ", "-")):
            found[name.strip()] = value(rest)
    return found
