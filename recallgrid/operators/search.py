"""Finding which of many names occur in which of many texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that a name and a text must have in common before they are compared; names are at least as long.
GRAM = 4


def grams(hay):
    """All runs of GRAM letters of a text, each once; one pass over it."""
    return F.array_distinct(F.regexp_extract_all(hay, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def ending(low):
    """The run of letters that a name ends in; a text that holds the name has it among its ``grams``."""
    return F.right(low, F.lit(GRAM))


def holding(texts: DataFrame, names: DataFrame, hay: str, low: str) -> DataFrame:
    """Rows of texts beside every row of names whose low is part of hay; both in lower case.

    A text holds a name only if it holds the name's last GRAM letters, so they meet in a join on these; names shorter
    than that have no partner. What is multiplied out is a hash of the text beside its letters; the text itself is joined to the names it may hold.
    """
    keyed = texts.withColumn("__text", F.xxhash64(hay))
    parts = keyed.where(F.length(hay) >= GRAM).select("__text", F.explode(grams(F.col(hay))).alias("__end"))
    tails = names.where(F.length(low) >= GRAM).select(F.col(low).alias("__low"), ending(F.col(low)).alias("__end")).distinct()
    met = parts.join(tails, "__end").select("__text", "__low").distinct()
    return keyed.join(met, "__text").where(F.col(hay).contains(F.col("__low"))).join(names, F.col("__low") == F.col(low)).drop("__text", "__low")
