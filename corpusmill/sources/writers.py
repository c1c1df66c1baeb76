"""Writers: JSON lines, manifests and markdown tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, append: bool = False, nulls: bool = True) -> None:
    """A folder of JSON line files; with order the rows are in order inside and across the files. nulls: keys of null values are written too."""
    out = df.orderBy(*order) if order else df
    out.write.mode("append" if append else "overwrite").option("ignoreNullFields", str(not nulls).lower()).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(path: str, counts: DataFrame, arguments: dict[str, object], files: DataFrame | None = None) -> dict:
    """A JSON file of one row of counters, the arguments, and the digests of files."""
    content = {"counts": counts.first().asDict(recursive=True), "arguments": arguments}
    if files is not None:
        content["files"] = {r["file"]: r["sha256"] for r in files.collect()}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(content, file, indent=1, default=str, sort_keys=True)
    return content


def markdown(df: DataFrame, digits: int = 2, most_rows: int = 1000) -> str:
    """A small result as a markdown table; numbers rounded, nulls 'n/a'. More than most_rows rows raise."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows are no report")

    def cell(v: object) -> str:
        if v is None or v != v:
            return "n/a"
        return f"{v:,.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def write_report(path: str, sections: dict[str, DataFrame], arguments: dict[str, object] | None = None, most_rows: int = 1000) -> dict:
    """A JSON file of small results by name: a section of one row as an object, of several as a list. More than most_rows rows raise. Beside it, a markdown file of the same."""
    content: dict[str, object] = {"arguments": arguments or {}}
    for name, df in sections.items():
        rows = [r.asDict(recursive=True) for r in df.limit(most_rows + 1).collect()]
        if len(rows) > most_rows:
            raise ValueError(f"{name}: more than {most_rows} rows are no report")
        content[name] = rows[0] if len(rows) == 1 else rows
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(content, file, indent=1, default=str, sort_keys=True)
    with open(f"{os.path.splitext(path)[0]}.md", "w", encoding="utf-8") as file:
        file.write("\n".join(f"## {name}\n\n{markdown(df, most_rows=most_rows)}" for name, df in sections.items()))
    return content
