"""DuckDB-flavoured SQL to Spark SQL: only table references and MATERIALIZED differ."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources import tables

PIECES = re.compile(
    r"""(?P<comment>--[^\n]*)
      | (?P<file>\b(?:FROM|JOIN)\s+'(?:[^']|'')*')
      | (?P<call>\bread_parquet\s*\(\s*'(?:[^']|'')*'[^)]*\))
      | (?P<text>'(?:[^']|'')*')
      | (?P<mat>\bAS\s+(?:NOT\s+)?MATERIALIZED\b)
      | (?P<quoted>"(?:[^"]|"")*")""",
    re.I | re.X,
)
OPTION = re.compile(r",\s*(\w+)\s*=\s*(true|false)\b", re.I)


def _in_place(path: str, options: dict[str, bool]) -> str:
    return f"parquet.`{path}`"


def rewrite(text: str, root: str = "", reference: Callable[[str, dict[str, bool]], str] = _in_place) -> str:
    """'file' and read_parquet('file', ...) become parquet.`file`, "name" becomes `name`.

    reference: gives what stands for a path with the options of its call.
    """

    def place(path: str, options: dict[str, bool]) -> str:
        path = path.replace("''", "'")
        return reference(path if "://" in path or path.startswith("/") or not root else f"{root}/{path}", options)

    def piece(m: re.Match) -> str:
        s = m[0]
        if m["comment"]:
            return ""
        if m["file"]:
            word, path = s.split(None, 1)
            return f"{word} {place(path[1:-1], {})}"
        if m["call"]:
            path = re.search(r"'((?:[^']|'')*)'", s)
            return place(path[1], {k.lower(): v.lower() == "true" for k, v in OPTION.findall(s, path.end())})
        if m["mat"]:
            return "AS"
        if m["quoted"]:
            return "`" + s[1:-1].replace('""', '"') + "`"
        return s

    return PIECES.sub(piece, text).strip().rstrip(";")


def run(spark: SparkSession, text: str, root: str = "", args: dict | None = None) -> DataFrame:
    """The rows of a query. Globs give the columns of their key=value folders unless
    hive_partitioning = false; file_row_number = true adds the place of each row in its file."""
    views = []

    def reference(path: str, options: dict[str, bool]) -> str:
        fixed = re.split(r"/[^/]*[*?\[{]", path, maxsplit=1)[0]
        folders = fixed != path and options.get("hive_partitioning", True)
        if not folders and not options.get("file_row_number"):
            return _in_place(path, options)
        df = (spark.read.option("basePath", fixed) if folders else spark.read).parquet(path)
        if options.get("file_row_number"):
            df = tables.with_row_index(df)
        views.append(f"quern_{uuid.uuid4().hex}")
        df.createOrReplaceTempView(views[-1])
        return views[-1]

    try:
        return spark.sql(rewrite(text, root, reference), args=args or {})
    finally:  # the query is bound by now
        for v in views:
            spark.catalog.dropTempView(v)
