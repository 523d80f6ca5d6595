"""Label files."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line ends as str.splitlines knows them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines(text: Column) -> Column:
    """Lines of a text; an end of the last line opens no further line."""
    parts = F.split(text, LINE_END, -1)
    ends = F.element_at(parts, -1) == ""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(ends, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def distinct_lines(rows: DataFrame, *, text: str = "text", keys: list[str]) -> DataFrame:
    """(keys, label_idx, species): first occurrences of each text's lines in
    order, blank ones too.  Within a row, so nothing is shuffled."""
    return rows.select(*keys, F.posexplode(F.array_distinct(lines(F.col(text)))).alias("label_idx", "species"))


def read_label_files(spark: SparkSession, paths: str | list[str], encoding: str = "utf8") -> DataFrame:
    """(path, label_idx, species) of text files with a label a line."""
    files = spark.read.format("binaryFile").load(paths)
    return distinct_lines(files.select("path", F.decode("content", encoding.upper().replace("UTF8", "UTF-8")).alias("text")), keys=["path"])


def get_species_from_file(species_file, /, *, encoding: str = "utf8") -> list[str]:
    """The labels of one driver-side file, in order, each once."""
    with open(species_file, encoding=encoding, newline="") as file:
        return list(dict.fromkeys(file.read().splitlines()))


def two_fields(line: Column, delimiter: str = ",") -> Column:
    """Fields of unquoted rows and whether there are two."""
    fields = F.split(line, delimiter, -1)
    return F.struct(fields.alias("fields"), (F.size(fields) == 2).alias("valid"))


def read_code_csv(spark: SparkSession, path: str) -> DataFrame:
    """(code, species) of CSV rows without a header; quoted fields are read as
    such, and a row that has not two fields, as a blank one, is an error."""
    rows = spark.read.text(path)
    parsed = F.from_csv(F.regexp_replace("value", "\r$", ""), "a string, b string, c string", {"mode": "PERMISSIVE"})
    rows = rows.select(parsed.alias("f"))
    valid = F.col("f.b").isNotNull() & F.col("f.c").isNull()
    return rows.select(F.when(valid, F.col("f.a")).otherwise(F.raise_error(F.lit("a label row has not two fields"))).alias("code"), F.col("f.b").alias("species"))


def species_of_code_csv(path) -> list[str]:
    """Second fields of one driver-side file, in order, each once."""
    with open(path, encoding="utf8", newline="") as file:
        rows = list(csv.reader(file))
    if any(len(row) != 2 for row in rows):
        raise ValueError(f"a row of {path} has not two fields")
    return list(dict.fromkeys(row[1] for row in rows))


def names(species: Column) -> Column:
    """Scientific and common name; null parts if there is not one ``_``."""
    parts = F.split(species, "_")
    ok = F.size(parts) == 2
    return F.struct(F.when(ok, parts[0]).alias("scientific"), F.when(ok, parts[1]).alias("common"))
