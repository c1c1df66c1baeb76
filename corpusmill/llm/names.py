"""Source names: one spelling for a database, a company and a document source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def database_name(c: Column) -> Column:
    """A database id in lower case with underscores: folders and file endings go, blanks, hyphens, dots and case steps become underscores.

    Null and names without a letter or digit give null.
    """
    name = _trim(F.regexp_replace(c, r"\\", "/"))
    name = F.regexp_replace(F.regexp_replace(name, r"/+$", ""), r"^.*/", "")
    name = F.regexp_replace(name, r"(?i)\.(sqlite3?|db3?)$", "")
    name = F.lower(F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2"))
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.nullif(name, F.lit(""))


def company_code(c: Column) -> Column:
    """The company of a report path (company/year/page) in capitals: the part before the year, else the first part.

    Encoded and repeated slashes, backslashes, leading folders and blanks are allowed; null and empty paths give null.
    """
    path = F.regexp_replace(F.regexp_replace(c, r"(?i)%2f|%5c|\\", "/"), r"(?i)%20", " ")
    before = F.regexp_extract(path, r"(?U)(?:^|/)([^/]*[^/\s][^/]*)/+\s*\d{4}\s*(?:/|$)", 1)
    first = F.regexp_extract(path, r"(?U)^(?:[\s./]*/)?\s*([^/]+)", 1)
    code = F.upper(_trim(F.when(before != "", before).otherwise(first)))
    return F.nullif(code, F.lit(""))


def source_name(c: Column) -> Column:
    """A document source in lower case with underscores; null stays null."""
    name = F.regexp_replace(F.lower(_trim(c)), r"(?U)[\s\-_]+", "_")
    return F.nullif(name, F.lit(""))
