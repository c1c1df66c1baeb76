"""Duplicates hidden by formatting differences.

Byte-identical rows are counted first; only their distinct survivors are canonicalised (in Arrow batches); the survivors
are then grouped on the full canonical text with the counts summed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest128
from ..session import cut_lineage

_BLANK = re.compile(r"[\s​-‏⁠﻿­]+")
_THOUSANDS = re.compile(r"(?<![\d.,])(\d{1,3})((?:,\d{3})+)(?![\d,])")
_MARKUP = re.compile(r"^(?:```[a-z]*|[`*_#>~\"'‘’“”«»])+|(?:```|[`*_~\"'‘’“”«»])+$")
_CLOSING = re.compile(r"[.;,!?:…]+$")
_MONEY = re.compile("[$€£¥₹%‰]")
_QUOTES = re.compile("[\"'`\\[\\]‘’“”«»„]")
_FIELD = re.compile(r"^[\s*`\"']*([A-Za-z][\w ]*?)[\s*`\"']*[:=]\s*(.*)$", re.S)
_NAME_AHEAD = re.compile(r"[;|\n]|,(?=\s*[\"'`*]*[A-Za-z][\w ]*?[\"'`*]*\s*[:=])")
_NUMBER = re.compile(r"^-?[\d.]+$")


def canonical_query(text: str) -> str:
    """A query without case, blanks, quotes and closing signs; operators, digits, signs, commas and inner dots stay."""
    text = text.strip()
    text = re.sub(r"^```[A-Za-z]*\s|```$", "", text).strip("*`~ \n\t\r ")
    # quotes go first, so that a dot or semicolon inside them closes nothing else
    return _CLOSING.sub("", _BLANK.sub("", _QUOTES.sub("", text)).lower().replace("−", "-"))


def canonical_value(text: str) -> str:
    """A value without case, blanks, quotes, markup, closing signs, thousands separators, currency and percent signs."""
    text = _BLANK.sub("", text.replace("−", "-").replace("–", "-").lower())
    while True:
        short = _CLOSING.sub("", _MARKUP.sub("", text))
        if short == text:
            break
        text = short
    text = _QUOTES.sub("", _MONEY.sub("", text)) if not _FIELD.match(text) else text
    text = _THOUSANDS.sub(lambda m: m[1] + m[2].replace(",", ""), text)
    return _CLOSING.sub("", text.replace("*", "") if _NUMBER.match(text.replace("*", "")) else text)


def _is_query(text: str) -> bool:
    return bool(re.match(r"[\s(]*(?:select|with)\b", text, re.I))


def _any(value: object) -> str:
    if isinstance(value, str):
        return canonical_query(value) if _is_query(value) else canonical_value(value)
    if isinstance(value, _Pairs):
        return _fields(list(value))
    if isinstance(value, list):
        return "[" + ",".join(_any(v) for v in value) + "]"
    return canonical_value("null" if value is None else str(value))


def _fields(pairs: list[tuple[str, object]]) -> str:
    return "{" + "|".join(sorted(f"{canonical_value(k)}={_any(v)}" for k, v in pairs)) + "}"


class _Pairs(list):
    """The fields of a JSON object, repeated names included; numbers stay as they were written."""


def canonical(text: str) -> str:
    """The text that two writings of the same prediction share.

    An object of named fields (JSON, or name and value pairs between semicolons, bars, commas or line ends) becomes its
    sorted fields; a query loses what canonical_query drops, anything else what canonical_value drops.
    """
    bare = text.strip().strip("*`").strip()
    bare = re.sub(r"^json\s*(?=\{)", "", bare)
    if bare.startswith("{"):
        try:
            value = json.loads(bare.rstrip(";. \n"), object_pairs_hook=_Pairs, parse_float=str, parse_int=str, parse_constant=str)
        except (ValueError, RecursionError):
            value = None
        if isinstance(value, _Pairs):
            return _fields(list(value))
    if _is_query(bare):
        return "q:" + canonical_query(text)
    inner = bare.strip("{}()")
    if _FIELD.match(inner):
        parts = [p for p in _NAME_AHEAD.split(inner) if p.strip(" *`;.,\n\r\t ")]
        found = [_FIELD.match(p.strip()) for p in parts]
        if all(found) and len(found) > 1:
            return _fields([(m[1], m[2]) for m in found])  # type: ignore[index]
    return "v:" + canonical_value(text)


def _canonical_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["canon"] = [canonical(t) for t in batch["pred"]]
        yield batch


def predictions(graded: DataFrame) -> DataFrame:
    """(row_id, id, pred) of the rows with a prediction; rows of null id group together as the empty id."""
    return graded.select("row_id", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("pred_sql", "pred_answer").alias("pred")).filter("pred is not null and row_id is not null")


def survivors(rows: DataFrame) -> DataFrame:
    """(id, pred, n, first_row, canon): byte-identical rows collapsed, then canonicalised. Counts are combined on the map side."""
    raw = rows.groupBy("id", "pred").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    return raw.mapInPandas(_canonical_batches, "id string, pred string, n bigint, first_row bigint, canon string")


def copy_counts(graded: DataFrame) -> DataFrame:
    """(id, kept_row_id, copies, writings): one row for each set of equal predictions of an item, with the rows and distinct writings it had.

    Null predictions are no members; empty ones are equal to each other. An empty table gives no rows.
    """
    return survivors(predictions(graded)).groupBy("id", "canon").agg(F.min("first_row").alias("kept_row_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("writings")).drop("canon")


def copies(graded: DataFrame) -> DataFrame:
    """(kept_row_id, copy_row_id): each row of a set of equal predictions but the first, with the smallest row id of the set.

    The sets are grouped on the full canonical text; only writings of sets with more than one row are joined back to the rows, by 128
    bits of the item and the raw text. AQE splits a hot key of the join; the side of the sets has one row for each key.
    """
    rows = predictions(graded)
    r1, r2 = digest128(F.col("id"), F.col("pred"))
    distinct = cut_lineage(survivors(rows).select(r1.alias("r1"), r2.alias("r2"), "id", "canon", "n", "first_row"))
    sets = distinct.groupBy("id", "canon").agg(F.min("first_row").alias("kept_row_id"), F.sum("n").alias("copies")).filter("copies > 1").drop("copies")
    members = distinct.join(sets, ["id", "canon"]).select("r1", "r2", "kept_row_id")
    return rows.select("row_id", r1.alias("r1"), r2.alias("r2")).join(members, ["r1", "r2"]).filter("row_id <> kept_row_id").select("kept_row_id", F.col("row_id").alias("copy_row_id"))
