"""Keep-latest tables in files: buckets by key, numbered saves, point reads of one bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


def _saves(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the saves below a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removeprefix("save=")) for n in names if n.startswith("save="))


@dataclass(frozen=True)
class Store:
    """A table below ``path`` with one current row per ``key``.

    A save writes its rows to folders of its own, one per bucket it touches; nothing is read or rewritten. The current row of a key
    is that of its last save; of several rows of a key in one save the greatest by ``order``, then by its text, is saved.
    """

    path: str
    key: str
    buckets: int = BUCKETS

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def save(self, rows: DataFrame, order: Sequence[str] = ()) -> int:
        """Store the rows; each needs a key. Returns the number of the save."""
        spark, key = rows.sparkSession, F.col(self.key)
        missing = F.raise_error(F.concat(F.lit(self.key), F.lit(" is required")))
        checked = rows.withColumn(self.key, F.when(F.coalesce(key.cast("string"), F.lit("")) == "", missing).otherwise(key))
        kept = [c for c in rows.columns if c != self.key]
        last = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*kept)))
        single = checked.groupBy(self.key).agg(F.max_by(F.struct(*kept), last).alias("_r")).select(self.key, "_r.*")
        number = max(_saves(spark, self.path), default=0) + 1
        self._write(single, number)
        return number

    def _write(self, rows: DataFrame, number: int) -> None:
        bucket = self.bucket(F.col(self.key))
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/save={number}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All saved rows with their ``save`` and ``bucket``."""
        if not _saves(spark, self.path):
            raise FileNotFoundError(f"nothing saved below {self.path}")
        return spark.read.parquet(self.path)

    def latest(self, spark: SparkSession) -> DataFrame:
        """The current row of every key."""
        return self._current(self.rows(spark))

    def get(self, spark: SparkSession, value: str) -> DataFrame:
        """The current row of one key, from the files of one bucket; no row where there is none."""
        key = F.lit(value)
        return self._current(self.rows(spark).where((F.col("bucket") == self.bucket(key)) & (F.col(self.key).cast("string") == key)))

    def _current(self, rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in (self.key, "save", "bucket")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*kept), "save").alias("_r")).select(self.key, "_r.*")


@dataclass(frozen=True)
class ResultStore:
    """Whole comparison results: a header per comparison and, by the same save number, the rows of its result tables."""

    path: str
    key: str = "comparison_id"
    buckets: int = BUCKETS

    def _table(self, name: str) -> Store:
        return Store(f"{self.path}/{name}", self.key, self.buckets)

    def save(self, header: DataFrame, tables: Mapping[str, DataFrame]) -> int:
        """Store results; every table has the key. The header is written last: a result counts when it is whole."""
        spark, head = header.sparkSession, self._table("header")
        taken = [n for name in ("header", *tables) for n in _saves(spark, f"{self.path}/{name}")]
        number = max(taken, default=0) + 1
        for name, rows in tables.items():
            self._table(name)._write(rows, number)
        head._write(header, number)
        return number

    def current(self, spark: SparkSession, name: str, value: str | None = None) -> DataFrame:
        """A table's rows of the last whole save of every comparison, or of one. Saved again without rows there, it has none."""
        head, rows = self._table("header").rows(spark), self._table(name).rows(spark)
        if value is not None:
            only = (F.col("bucket") == self._table(name).bucket(F.lit(value))) & (F.col(self.key).cast("string") == F.lit(value))
            head, rows = head.where(only), rows.where(only)
        last = head.groupBy(self.key).agg(F.max("save").alias("save"))
        return rows.join(last, [self.key, "save"]).drop("save", "bucket")

    def load(self, spark: SparkSession, value: str, tables: Sequence[str]) -> dict[str, DataFrame]:
        """The header and the given tables of one comparison. Raises when it was never saved."""
        found = {name: self.current(spark, name, value) for name in ("header", *tables)}
        if found["header"].isEmpty():
            raise FileNotFoundError(f"no comparison result {value!r}")
        return found
