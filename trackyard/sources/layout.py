"""Stored layouts that let a request read, or rewrite, only the files it touches.

``TextIndex`` (FLT3): a table in parts with trigram postings for substring search.
``PageIndex`` (LIM1): a table in page order, cut into parts, with running counts per part.
``PartitionedTable`` (SNK4, SNK6-SNK8, SNK12): a table in partitions with an index from key to
partition; a mutation rewrites only the partitions of the keys it names.

Both write below the folder they are given; on a cluster that is a shared one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackyard.operators.filters import search
from trackyard.session import scratch_path
from trackyard.sources.tables import Storage

MAX_BROADCAST = 100_000                 # partition names that are broadcast

Order = Sequence[tuple[str, bool]]      # (column, ascending); NOT NULL columns, the last ones make it total


def _sorting(order: Order) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def _after(order: Order, prefix: str, values: Sequence) -> Column:
    """Whether the row of columns ``prefix + name`` comes after the given values in the order."""
    cases = []
    for k, (c, up) in enumerate(order):
        same = [F.col(prefix + order[i][0]) == F.lit(values[i]) for i in range(k)]
        step = F.col(prefix + c) > F.lit(values[k]) if up else F.col(prefix + c) < F.lit(values[k])
        cases.append(reduce(lambda a, b: a & b, [*same, step]))
    return reduce(lambda a, b: a | b, cases)


class PageIndex:
    """Pages of a stored table by rank or after a key, from the few parts that hold them."""

    def __init__(self, spark: SparkSession, path: str, order: Order):
        self.spark, self.path, self.order = spark, path, list(order)

    @classmethod
    def build(cls, df: DataFrame, path: str, order: Order, rows_per_part: int = 100_000) -> PageIndex:
        """Write ``df`` in page order in parts of about ``rows_per_part`` rows, then the index (one row per part)."""
        spark = df.sparkSession
        size = df.count()
        if not size:                                   # partitioned writes leave no file, and so no schema
            df.limit(0).write.parquet(f"{path}/rows/_part=0")
        parts = max(1, -(-size // rows_per_part))
        ranged = df.repartitionByRange(parts, *_sorting(order)).withColumn("_part", F.spark_partition_id())
        ranged.sortWithinPartitions("_part", *_sorting(order)).write.mode("append").partitionBy("_part").parquet(
            f"{path}/rows")
        keys = spark.read.parquet(f"{path}/rows").select("_part", *[c for c, _ in order])
        w = Window.partitionBy("_part")
        last = (keys.withColumn("_n", F.count(F.lit(1)).over(w))
                .withColumn("_r", F.row_number().over(w.orderBy(*_sorting(order)))).where(F.col("_r") == F.col("_n")))
        # running counts over one row per part
        before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        last.select("_part", "_n", F.coalesce(before, F.lit(0)).alias("_before"),
                    *[F.col(c).alias(f"_last_{c}") for c, _ in order]).coalesce(1).write.parquet(f"{path}/index")
        return cls(spark, path, order)

    def _index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def _rows(self, parts: Sequence[int]) -> DataFrame:
        base = f"{self.path}/rows"
        if not parts:
            return self.spark.read.parquet(base).drop("_part").limit(0)
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/_part={p}" for p in parts]).drop("_part")

    def page(self, page: int = 1, limit: int = 20) -> DataFrame:
        """Rows ``(page - 1) * limit`` up to ``page * limit`` of the order."""
        start = (max(1, int(page)) - 1) * limit
        held = (self._index().where((F.col("_before") < start + limit) & (F.col("_before") + F.col("_n") > start))
                .orderBy("_part").collect())          # the parts of one page
        skip = start - held[0]["_before"] if held else 0
        return self._rows([r["_part"] for r in held]).orderBy(*_sorting(self.order)).offset(skip).limit(limit)

    def after(self, key: Sequence, limit: int = 20) -> DataFrame:
        """The next ``limit`` rows after a key (values of the order's columns)."""
        held, have = [], -1
        for r in self._index().where(_after(self.order, "_last_", key)).orderBy("_part").toLocalIterator():
            held.append(r["_part"])
            have = 0 if have < 0 else have + r["_n"]  # the first part may end right after the key
            if have >= limit:
                break
        return self._rows(held).where(_after(self.order, "", key)).orderBy(*_sorting(self.order)).limit(limit)


class PartitionedTable:
    """A table stored in partitions by ``part`` (an expression of its columns, never NULL), with an index key -> partition.

    The index is stored in key order, so that a lookup of few keys reads few of its files.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, part: Column):
        self.spark, self.path, self.key, self.part = spark, path, key, part

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str, part: Column) -> PartitionedTable:
        table = cls(df.sparkSession, path, key, part)
        table._write(df.withColumn("_part", part.cast("string")), "errorifexists")
        return table

    def read(self) -> DataFrame:
        return self._stored().drop("_part")

    def _stored(self) -> DataFrame:
        # partition values are text, whatever they look like
        found = self.spark.read.parquet(f"{self.path}/rows").schema
        text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "_part" else f.dataType) for f in found])
        return self.spark.read.schema(text).parquet(f"{self.path}/rows")

    def _write(self, rows: DataFrame, mode: str) -> None:
        # rebalance: files of the advisory size, a large partition in several, a small one in one
        (rows.hint("rebalance", "_part").write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("_part").parquet(f"{self.path}/rows"))
        pairs = rows.select(self.key, "_part")
        if mode == "overwrite":                        # rows that are new, or moved
            pairs = pairs.join(self._keys(), [self.key, "_part"], "left_anti")
        pairs.repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("append").parquet(f"{self.path}/keys")

    def _keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/keys")

    def parts_of(self, keys: DataFrame) -> DataFrame:
        """(_part) of the stored rows with one of the keys; a key that moved may name its old partition too."""
        return self._keys().join(keys.select(self.key).distinct(), self.key, "left_semi").select("_part").distinct()

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], also: DataFrame | None = None) -> int:
        """Replace the touched partitions by ``change`` of their rows; returns how many they are.

        keys: the keys that the requests name; ``change`` must leave rows of other keys alone.  ``also``:
        (_part) partitions that rows may move or be added to.  The new rows are staged in a folder of
        their own first: if the overwrite is lost half-way, it is repeated from there.
        """
        touched = self.parts_of(keys)
        if also is not None:
            touched = touched.unionByName(also.select(F.col("_part").cast("string").alias("_part"))).distinct()
        staged = scratch_path(self.spark, "staged")
        touched.write.parquet(f"{staged}/parts")
        touched = self.spark.read.parquet(f"{staged}/parts")
        rows = self._stored().join(F.broadcast(touched) if touched.count() <= MAX_BROADCAST else touched, "_part", "left_semi")
        new = change(rows.drop("_part")).withColumn("_part", self.part.cast("string"))
        new.write.parquet(f"{staged}/rows")
        new = self.spark.read.parquet(f"{staged}/rows")
        stray = new.join(touched, "_part", "left_anti")
        if not stray.isEmpty():
            raise ValueError("rows move to partitions that are not among the touched ones: name them in `also`")
        self._write(new, "overwrite")
        # dynamic partitions leave those alone that no row is left in
        gone = {r["_part"] for r in touched.join(new.select("_part").distinct(), "_part", "left_anti").toLocalIterator()}
        storage = Storage(self.spark)
        for name in storage.folders(f"{self.path}/rows") if gone else ():
            if name.startswith("_part=") and unquote(name[len("_part="):]) in gone:
                storage.remove(f"{self.path}/rows/{name}")
        return touched.count()


class TextIndex:
    """Substring search (FLT3) that reads only the parts of a stored table whose trigrams allow a match.

    The table is stored in parts of neighbouring rows; postings name the parts in which a trigram occurs in a
    column (lower-cased, as ILIKE compares).  A search intersects the postings of the trigrams that
    each match must contain and scans what is left with the plain operator, so the answer is that
    operator's, wildcards included.  Texts without three literal characters in a row scan all parts.
    """

    def __init__(self, spark: SparkSession, path: str, cols: Sequence[str]):
        self.spark, self.path, self.cols = spark, path, list(cols)

    @classmethod
    def build(cls, df: DataFrame, path: str, cols: Sequence[str], order: Sequence[str], rows_per_part: int = 100_000) -> TextIndex:
        """``order``: columns by which rows become neighbours, for instance the one that is searched most."""
        PageIndex.build(df, path, [(c, True) for c in order], rows_per_part)
        rows = df.sparkSession.read.parquet(f"{path}/rows")

        def trigrams(col: str) -> Column:
            text = F.lower(F.col(col).cast("string"))
            places = F.sequence(F.lit(1), F.length(text) - 2)
            tris = F.transform(places, lambda i: F.substring(text, i, F.lit(3)))
            return F.when(F.length(text) >= 3, F.array_distinct(tris))

        found = [rows.select("_part", F.lit(c).alias("col"), F.explode(trigrams(c)).alias("tri")).distinct() for c in cols]
        postings = reduce(DataFrame.unionByName, found)
        postings.repartitionByRange("tri", "col").sortWithinPartitions("tri", "col").write.parquet(f"{path}/postings")
        return cls(df.sparkSession, path, cols)

    @staticmethod
    def required(text: str) -> list[str]:
        """Trigrams of the literal runs of a text whose ``%`` and ``_`` are wildcards and ``\\`` escapes."""
        runs, at = [""], 0
        while at < len(text):
            if text[at] == "\\" and at + 1 < len(text):
                at += 1
                runs[-1] += text[at]
            elif text[at] in "%_":
                runs.append("")
            else:
                runs[-1] += text[at]
            at += 1
        return sorted({low[i:i + 3] for low in map(str.lower, runs) for i in range(len(low) - 2)})

    def parts(self, text: str) -> list[int] | None:
        """The parts that can hold a match; None: all of them."""
        wanted = self.required(text)
        if not wanted:
            return None
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("tri").isin(*wanted) & F.col("col").isin(*self.cols))
        full = hits.groupBy("col", "_part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
        return [r["_part"] for r in full.select("_part").distinct().orderBy("_part").toLocalIterator()]

    def search(self, text: str) -> DataFrame:
        """The rows in which one of the columns contains the text, as ``filters.search`` finds them."""
        parts = self.parts(text)
        if parts is None:
            return search(self.spark.read.parquet(f"{self.path}/rows").drop("_part"), self.cols, text)
        return search(PageIndex(self.spark, self.path, [])._rows(parts), self.cols, text)
