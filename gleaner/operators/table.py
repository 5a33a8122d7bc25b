"""Tables in Parquet: scans, aggregates, ordering, and changes as before/after frames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(df: DataFrame, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows that fit, before projection to some columns (all by default); unknown columns are an error."""
    out = df if where is None else df.where(where)
    return out.select(*columns) if columns else out


def first_match(df: DataFrame, where: Column | None = None, columns: list[str] | None = None, order: list | None = None):
    """One row that fits; LookupError if there is none."""
    out = scan(df, where)
    out = out.orderBy(*order) if order else out
    row = (out.select(*columns) if columns else out).limit(1).collect()
    if not row:
        raise LookupError("No record found")
    return row[0]


def count(df: DataFrame, where: Column | None = None) -> DataFrame:
    return scan(df, where).agg(F.count(F.lit(1)).alias("n"))


def total(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """The sum as a double, 0 without rows; a value that is no number is an error, in whichever row."""
    value = F.col(column).cast("double")
    fits = F.lit(True) if where is None else where
    # The maximum is over all values, so each is cast; only those that fit are added.
    out = df.agg(F.max(value).alias("m"), F.sum(F.when(fits, value)).alias("s"))
    return out.select(F.when(F.col("m").isNull(), 0.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("total"))


def extremes(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """(least, most), both 0 without rows."""
    value = F.col(column).cast("double")
    return scan(df, where).agg(F.coalesce(F.min(value), F.lit(0.0)).alias("least"), F.coalesce(F.max(value), F.lit(0.0)).alias("most"))


def order_by(df: DataFrame, fields: list[str], types: list[str], descending: bool = False) -> DataFrame:
    """Sorted by numeric keys in one direction; keys of type string are left out."""
    keys = [F.col(f).cast("double" if t.startswith("float") else "long") for f, t in zip(fields, types) if t != "string"]
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys]) if keys else df


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df with rows; a column that they lack is the empty text (null if it is not text)."""
    for f in df.schema:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit("" if f.dataType.simpleString() == "string" else None).cast(f.dataType))
    return df.unionByName(rows.select(*df.columns))


def update(df: DataFrame, values: dict, where: Column | None = None) -> DataFrame:
    fits = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.select(*[F.when(fits, F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def upsert(df: DataFrame, values: dict, where: Column | None = None) -> DataFrame:
    """All rows that fit are updated; if there are none, one is inserted."""
    if not scan(df, where).isEmpty():
        return update(df, values, where)
    names = [c for c in df.columns if c in values]
    row = df.sparkSession.range(1).select(*[F.lit(values[c]).cast(df.schema[c].dataType).alias(c) for c in names])
    return insert(df, row)


def upsert_rows(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """df with rows, which replace those of equal keys."""
    return df.join(rows, keys, "left_anti").select(*df.columns).unionByName(rows.select(*df.columns))


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Without the rows that fit; without any if there is no condition."""
    return df.limit(0) if where is None else df.where(~F.coalesce(where, F.lit(False)))


def union_count(tables: list[DataFrame], where: Column | None = None) -> DataFrame:
    """The number of rows that fit in tables of one group."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return count(out, where)


def argsort(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """(place, rows' columns): df with each row's place by a number, from 0; ties by the other columns."""
    from .ring import ranked

    value = F.col(column).cast("double")
    rest = F.to_json(F.struct(*[c for c in df.columns if c != column]))
    out = df.withColumn("_o", -value if descending else value).withColumn("_t", rest)
    return ranked(out, "_o", "_t").withColumnRenamed("rank", "place").drop("_o", "_t")


def decode(df: DataFrame, fields: str, schema: str) -> DataFrame:
    """Typed columns of rows of texts (a column array<string>); a row of another length, or with a value that doesn't fit, is an error.

    A boolean is 1 or 0 (or true or false), as insert() and encode() write it.
    """
    types = T.StructType.fromDDL(schema).fields
    row = F.col(fields)
    wrong = F.concat(F.lit("row has "), F.size(row).cast("string"), F.lit(f" fields, not {len(types)}"))
    checked = F.when(F.size(row) == len(types), row).otherwise(F.raise_error(wrong).cast("array<string>"))
    out = df.withColumn("_fields", checked)
    return out.select(*[F.get("_fields", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(types)])


def encode(df: DataFrame, name: str = "fields") -> DataFrame:
    """Rows as texts (array<string>): numbers in their shortest form, booleans as 1 or 0, null as the empty text."""
    text = lambda f: (F.col(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else F.col(f.name)).cast("string")
    return df.select(F.array(*[F.coalesce(text(f), F.lit("")) for f in df.schema]).alias(name))


class Store:
    """Named tables under a folder. A table is a row of versions, each a row of parts; the newest version's complete parts count.

    Each version has its schema beside its rows, so an empty table keeps it. A reader sees
    all of an append or a change, or nothing of it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def path(self, table: str, group: str = "") -> str:
        return f"{self.root}/{group or table}/{table}"

    def _parts(self, table: str, group: str) -> list[tuple[int, int]]:
        """(version, part) of those whose last file, the mark of success, is there."""
        path = self.path(table, group)
        fs, _ = self._fs(path)
        names = [n for n in self._names(path) if n.startswith("v") and fs.exists(self._fs(f"{path}/{n}/_SUCCESS")[1])]
        return sorted(tuple(map(int, n[1:].split("."))) for n in names)

    def exists(self, table: str, group: str = "") -> bool:
        return bool(self._parts(table, group))

    def create(self, table: str, schema: str, group: str = "", if_missing: bool = False) -> DataFrame:
        if self.exists(table, group):
            if not if_missing:
                raise ValueError(f"table {table} exists")
        else:
            self.write(table, self.spark.createDataFrame([], schema), group)
        return self.read(table, group)

    def schema(self, table: str, group: str = "") -> T.StructType:
        parts = self._parts(table, group)
        if not parts:
            raise LookupError(f"there is no table {table}")
        lines = self.spark.read.text(f"{self.path(table, group)}/s{parts[-1][0]}").collect()  # one line
        return T.StructType.fromJson(json.loads(lines[0].value))

    def read(self, table: str, group: str = "") -> DataFrame:
        schema, parts = self.schema(table, group), self._parts(table, group)
        newest = [p for v, p in parts if v == parts[-1][0]]
        return self.spark.read.schema(schema).parquet(*[f"{self.path(table, group)}/v{parts[-1][0]}.{p}" for p in newest])

    def append(self, table: str, rows: DataFrame, group: str = "") -> None:
        """Adds a part to the newest version; rows need its columns."""
        parts = self._parts(table, group)
        if not parts:
            return self.write(table, rows, group)
        schema = self.schema(table, group)
        version, part = parts[-1]
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").parquet(f"{self.path(table, group)}/v{version}.{part + 1}")

    def write(self, table: str, df: DataFrame, group: str = "") -> None:
        """Replaces a table by a new version; df may read it. Older versions than the one before are deleted."""
        path, parts = self.path(table, group), self._parts(table, group)
        new = parts[-1][0] + 1 if parts else 1
        # The schema is there before the rows, and so before the mark of success.
        one = self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1)
        one.write.mode("overwrite").text(f"{path}/s{new}")
        df.write.mode("overwrite").parquet(f"{path}/v{new}.0")
        fs, p = self._fs(path)
        for v, part in parts:
            if v < new - 1:
                fs.delete(self._fs(f"{path}/v{v}.{part}")[1], True)
                fs.delete(self._fs(f"{path}/s{v}")[1], True)

    def truncate(self, table: str, group: str = "") -> None:
        self.write(table, self.read(table, group).limit(0), group)

    def drop(self, table: str, group: str = "") -> None:
        fs, p = self._fs(self.path(table, group))
        fs.delete(p, True)

    def drop_all(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)

    def tables(self, group: str) -> list[str]:
        return sorted(t for t in self._names(f"{self.root}/{group}") if self.exists(t, group))

    def catalog(self) -> DataFrame:
        """(group, table, place, column, type): the definition of each table, empty ones too."""
        rows = []
        for group in sorted(self._names(self.root)):
            for table in self.tables(group):
                rows += [(group, table, i, f.name, f.dataType.simpleString()) for i, f in enumerate(self.schema(table, group))]
        return self.spark.createDataFrame(rows, "group string, table string, place int, column string, type string")
