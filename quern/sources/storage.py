"""A source that filters and projects where the file is read, through Spark's Python data
source API: Spark hands the tests down, the reader returns Arrow batches of what is left.

Spark pushes tests into it when spark.sql.python.filterPushdown.enabled is true. The path must
be readable by pyarrow on each executor."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    Not,
)

OPS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class RowGroup(InputPartition):
    def __init__(self, path: str, index: int):
        self.path, self.index = path, index


def files_of(path: str) -> list[str]:
    """The Parquet files at a path: itself, or those in a folder."""
    import pyarrow.dataset as ds

    return sorted(ds.dataset(path, format="parquet", exclude_invalid_files=False).files)


class StorageReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters):
        for f in filters:
            # != comes as Not(EqualTo)
            inner = f.child if type(f) is Not and type(f.child) is EqualTo else f
            if type(inner) in OPS and len(inner.attribute) == 1:
                self.tests.append((inner.attribute[0], OPS[type(inner)] if inner is f else "!=", inner.value))
            else:
                yield f

    def partitions(self):
        import pyarrow.parquet as pq

        return [RowGroup(path, i) for path in files_of(self.path) for i in range(pq.read_metadata(path).num_row_groups)]

    def read(self, partition):
        import operator

        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        kernel = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
        test = None
        for name, op, value in self.tests:
            one = kernel[op](pc.field(name), value)
            test = one if test is None else test & one
        (fragment,) = ds.dataset(partition.path, format="parquet").get_fragments()
        yield from fragment.subset(row_group_ids=[partition.index]).to_batches(columns=self.columns, filter=test)


class StorageSource(DataSource):
    @classmethod
    def name(cls):
        return "quern_storage"

    def schema(self):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        whole = pq.read_schema(files_of(self.options["path"])[0])
        wanted = self.options.get("columns")
        return from_arrow_schema(whole if not wanted else whole.__class__.empty_table(whole).select(wanted.split(",")).schema)

    def reader(self, schema):
        return StorageReader(self.options["path"], schema.fieldNames())


def storage_scan(spark: SparkSession, path: str, columns: list[str]):
    spark.dataSource.register(StorageSource)
    return spark.read.format("quern_storage").option("columns", ",".join(columns)).load(path)
