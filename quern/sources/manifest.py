"""A manifest of files with bounds per column: files are ruled out before any is opened."""

from __future__ import annotations

import datetime
import decimal
import json
import struct
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.predicates import Comparison, could_match


def build_manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per file: path, rows, low and high of each column. One aggregate over the scan."""
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), *bounds)


def write_manifest(df: DataFrame, columns: list[str], path: str) -> None:
    build_manifest(df, columns).coalesce(1).write.mode("overwrite").parquet(path)


def alike(bound, value):
    """A bound and a value as things that compare: a date stands for its midnight beside a time, an
    aware time for the same moment in UTC. Other mixtures raise TypeError: no order is right for them."""

    def moment(x):
        if isinstance(x, datetime.datetime):
            return x.astimezone(datetime.timezone.utc).replace(tzinfo=None) if x.tzinfo else x
        return datetime.datetime.combine(x, datetime.time()) if isinstance(x, datetime.date) else x

    one, other = moment(bound), moment(value)
    number = (int, float, decimal.Decimal)
    if not (type(one) is type(other) or isinstance(one, number) and isinstance(other, number)):
        raise TypeError(f"bound {bound!r} and value {value!r} don't compare")
    return one, other


def may_hold(file: dict, test: Comparison) -> bool:
    ends = [file.get(f"{end}_{test.column}") for end in ("low", "high")]
    if None in ends:  # a column without bounds rules nothing out
        return True
    (low, value), (high, _) = (alike(x, test.value) for x in ends)
    return could_match(test.op, value, low, high)


def prune_files(manifest: Iterable[dict], tests: Iterable[Comparison]) -> list[str]:
    """Paths of the files that may hold a match."""
    tests = list(tests)
    return [f["path"] for f in manifest if all(may_hold(f, t) for t in tests)]


def read_pruned(spark: SparkSession, manifest_path: str, tests: list[Comparison], schema_of: str) -> DataFrame:
    """Scan only the files that the manifest lets through.

    The bounds are tested by Spark over the manifest table; the driver receives the paths that
    are left, which it needs in any case to plan the scan.
    """
    m = spark.read.parquet(manifest_path)
    keep = F.lit(True)
    for t in tests:
        low, high, v = F.col(f"low_{t.column}"), F.col(f"high_{t.column}"), F.lit(t.value)
        rule = {
            "=": (low <= v) & (v <= high),
            "!=": ~((low == v) & (high == v)),
            "<": low < v,
            "<=": low <= v,
            ">": high > v,
            ">=": high >= v,
        }[t.op]
        keep = keep & F.coalesce(rule, F.lit(True))
    paths = [r.path for r in m.where(keep).select("path").toLocalIterator()]
    shape = spark.read.parquet(schema_of)
    df = spark.read.schema(shape.schema).parquet(*paths) if paths else shape.where(F.lit(False))
    for t in tests:
        df = df.where(t.to_column())
    return df


#: How bounds are written in metadata.json: the comparator's struct code, None for plain bytes.
PACKED = {"I32": "<i", "I64": "<q", "F64": "<d", "BYTES": None}


def bounds_of(t: pa.Table) -> dict[str, dict[str, str]]:
    """Bounds of each column of one file as metadata.json has them: hex of PLAIN values."""
    out = {}
    for f in t.schema:
        date = pa.types.is_date32(f.type)
        kind = "I32" if date or pa.types.is_int32(f.type) else "I64" if pa.types.is_int64(f.type) else "F64" if pa.types.is_float64(f.type) else "BYTES"
        values = t.column(f.name).cast(pa.int32()) if date else t.column(f.name)
        ends = pc.min_max(values).as_py()
        if ends["min"] is not None:
            code = PACKED[kind]
            pack = (lambda x: struct.pack(code, x)) if code else str.encode  # noqa: B023
            out[f.name] = {"comparator": kind, "lower": pack(ends["min"]).hex(), "upper": pack(ends["max"]).hex()}
    return out


def load_metadata(text: str) -> list[dict]:
    """Files of a metadata.json, as `prune_files` takes them. Columns without bounds are left out."""
    about = json.loads(text)
    dates = {c.split(":")[0] for c in about["schema"] if c.split(":")[1].strip().startswith("date32")}
    day_0 = datetime.date(1970, 1, 1)

    def plain(column: str, kind: str, digits: str):
        data = bytes.fromhex(digits)
        x = struct.unpack(PACKED[kind], data)[0] if PACKED[kind] else data.decode()
        return day_0 + datetime.timedelta(x) if column in dates else x

    files = []
    for f in about["files"]:
        ends = {f"{end}_{c}": plain(c, b["comparator"], b[name]) for c, b in f["bounds"].items() for end, name in (("low", "lower"), ("high", "upper"))}
        files.append({"path": f["path"], "rows": f["rows"], **ends})
    return files


def months_to_read(paths: Iterable[str], start: str, end: str) -> list[str]:
    """Paths whose month=YYYY-MM part meets [start, end)."""
    out = []
    for p in paths:
        month = next((x[6:] for x in p.split("/") if x.startswith("month=")), None)
        if month is None or start[:7] <= month <= end[:7] and not (month == end[:7] and end[8:10] == "01"):
            out.append(p)
    return out
