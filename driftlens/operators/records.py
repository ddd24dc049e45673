"""Record items of files: read from lines, compared within each file, consolidated across files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import diff
from .dedup import last_wins, pick

ITEM = ("code", "description", "unit", "category")


def items(lines: DataFrame, file: list[str], line: str = "line", pos: str = "pos") -> DataFrame:
    """file, code, description, unit, category, pos: the most complete record of each code in a file, the first on a tie.

    Lines that aren't records, and null ones, give nothing; a null file is a file.
    """
    read = lines.select(*file, F.col(pos).alias("pos"), text.record(F.col(line)).alias("r")).filter("r IS NOT NULL").select(*file, "r.*", "pos")
    size = sum((F.length(F.coalesce(c, F.lit(""))) for c in ITEM), F.lit(0))
    return pick(read, [*file, "code"], -size, F.col("pos"))


def of_analyses(rows: DataFrame, file: list[str]) -> DataFrame:
    """Items of the lines in ``units``, as ``sources.files.analyses`` makes them."""
    each = rows.select(*file, F.explode("units").alias("u")).select(*file, F.col("u.text").alias("line"), F.col("u.pos").alias("pos"))
    return items(each, file)


def changes(old: DataFrame, new: DataFrame, file: list[str]) -> DataFrame:
    """kind (added, removed, updated), file, code, and both sides' description, unit and class, by (file, code). A null file never meets another."""
    sides = [d.withColumnRenamed("category", "class") for d in (old, new)]
    named = diff.keyed(*sides, [*file, "code"], ["description", "unit", "class"], ("added", "removed", "updated"))
    return named.withColumnRenamed("category", "kind")


def consolidated(found: DataFrame, order: str) -> DataFrame:
    """One row of each (kind, code) over all files: the one of the file that comes last by ``order``, a number. Sort by kind and code to show them."""
    return last_wins(found, ["kind", "code"], order)
