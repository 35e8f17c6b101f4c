"""Tables by SQL: databases over JDBC, bound statements, ordered results by position, and typed tables with defaults."""

from __future__ import annotations

import os
import re
import zipfile
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArguments, NotSupported
from ..session import delete, exists

#: The types that a field may have, as Spark's.
TYPES = {"int": "int", "int64": "bigint", "string": "string", "text": "string", "float": "double", "timestamp": "timestamp", "boolean": "boolean"}


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "error", **options: str) -> None:
    """Writes rows to a database's table. The driver class comes with the database's jar."""
    rows.write.mode(mode).options(**options).jdbc(url, table)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database's table. With a whole-number ``key`` it is read in ``parts`` ranges of it, each by a task of its own."""
    reader = spark.read.options(**options)
    if key is None:
        return reader.jdbc(url, table)
    low, high = reader.jdbc(url, table).agg(F.min(key), F.max(key)).first()
    return reader.jdbc(url, table) if low is None else reader.jdbc(url, table, column=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts)


def load_derby(rows: DataFrame, path: str, table: str) -> str:
    """Loads rows into a new Derby database in a shared folder and gives the URL by which all executors read it.

    Derby has no server here and one process alone may write its files, so tasks write the rows as files, Derby imports
    these by its own statement, and the closed database is put into an archive, a form that any number of processes may
    open at once, to read. Derby reads files of a mounted file system alone. Types but numbers and strings are
    refused, as is a value that isn't finite.
    """
    if urlsplit(path).scheme not in ("", "file"):
        raise NotSupported(f"Derby can't open {path}")
    odd = [f.name for f in rows.schema if f.dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal", "string")]
    if odd:
        raise NotSupported(f"not imported by Derby: {', '.join(odd)}")
    local = unquote(urlsplit(path).path) if path.startswith("file:") else path
    quoted = lambda f: F.concat(F.lit('"'), F.replace(F.col(f), F.lit('"'), F.lit('""')), F.lit('"'))
    values = [F.coalesce(quoted(f.name) if f.dataType.typeName() == "string" else F.col(f.name).cast("string"), F.lit("")) for f in rows.schema]
    rows.select(F.concat_ws(",", *values)).write.text(f"{path}/rows")
    url, drivers = f"jdbc:derby:{local}/db", rows.sparkSession.sparkContext._jvm.java.sql.DriverManager
    write_jdbc(rows.limit(0), f"{url};create=true", table)  # the table alone: no task has a row
    connection = drivers.getConnection(url)
    try:
        call = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        for name in sorted(f for f in os.listdir(f"{local}/rows") if f.startswith("part-")):
            call.setString(1, table.upper())
            call.setString(2, f"{local}/rows/{name}")
            call.execute()
    finally:
        connection.close()
        try:
            drivers.getConnection(f"{url};shutdown=true")
        except Py4JJavaError as e:  # Derby says by an error that it has closed a database
            if e.java_exception.getSQLState() != "08006":
                raise
    with zipfile.ZipFile(f"{local}/db.jar", "w", allowZip64=True) as jar:
        for folder, _, names in os.walk(f"{local}/db"):
            for name in names:
                jar.write(f"{folder}/{name}", os.path.relpath(f"{folder}/{name}", local))
    delete(rows.sparkSession, f"{path}/rows")
    delete(rows.sparkSession, f"{path}/db")
    return f"jdbc:derby:jar:({local}/db.jar)db"


def view(rows: DataFrame, name: str) -> DataFrame:
    """Makes rows a view that statements name."""
    rows.createOrReplaceTempView(name)
    return rows


def prepared(spark: SparkSession, sql: str, *values, **named) -> DataFrame:
    """A statement with its values bound, "?" by place or ":name" by name; values are never part of the text."""
    return spark.sql(sql, args=list(values) if values else named or None)


def seek(rows: DataFrame, order: list[Column], start: int, n: int) -> DataFrame:
    """n rows of an ordered result from the start-th on, counted from 0: each task passes on its first start + n."""
    if start < 0 or n < 0:
        raise InvalidArguments("a position is at least 0")
    return rows.orderBy(*order).offset(start).limit(n)


@dataclass
class Field:
    name: str
    kind: str
    default: object = None
    key: bool = False

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.name) or self.kind not in TYPES:
            raise InvalidArguments(f"not a field: {self.name!r} {self.kind!r}")


@dataclass
class Table:
    """A typed table: Parquet in a shared folder. Fields of the key tell rows apart; the last one written wins."""

    spark: SparkSession
    path: str
    fields: list[Field]

    @property
    def schema(self) -> str:
        return ", ".join(f"{f.name} {TYPES[f.kind]}" for f in self.fields)

    def create(self) -> None:
        """Does nothing where the table is."""
        if not exists(self.spark, self.path):
            self.spark.createDataFrame([], f"{self.schema}, at_ long").write.parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)

    def append(self, rows: DataFrame) -> None:
        """Adds rows; a field that they lack, or that is null there, gets its default."""
        cols = [(F.coalesce(F.col(f.name), F.lit(f.default)) if f.name in rows.columns else F.lit(f.default)).cast(TYPES[f.kind]).alias(f.name) for f in self.fields]
        last = self._stored().agg(F.coalesce(F.max("at_"), F.lit(0))).first()[0]
        rows.select(*cols, F.lit(last + 1).alias("at_")).write.mode("append").parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, at_ long").parquet(self.path)

    def read(self) -> DataFrame:
        keys = [f.name for f in self.fields if f.key]
        if not keys:
            return self._stored().drop("at_")
        others = [f.name for f in self.fields if not f.key]
        last = self._stored().groupBy(*keys).agg(F.max_by(F.struct(*others), "at_").alias("v_"))
        return last.select(*[F.col(f.name) if f.key else F.col(f"v_.{f.name}").alias(f.name) for f in self.fields])
