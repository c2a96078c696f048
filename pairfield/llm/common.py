"""What the operators of this subpackage share: readers, word rules, lineage cuts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import ranked
from ..session import cut, shared_dir  # noqa: F401  operators take cut from here

#: A word is a maximal run of characters other than these.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_as(keep: tuple[str, ...], own: tuple[str, ...]) -> dict[str, str]:
    """Names under which an operator passes columns on: a name that is one of the operator's own results gets ``_in`` behind it."""
    out: dict[str, str] = {}
    for c in keep:
        name = c
        while name in own or name in out.values():
            name += "_in"
        out[c] = name
    return out


def kept(keep: tuple[str, ...], own: tuple[str, ...]) -> tuple[Column, list[Column]]:
    """The passed-on columns as one struct ``__kept``, out of the way of an operator's working columns, and what takes them out of it."""
    names = kept_as(keep, own)
    whole = F.struct(*[F.col(c).alias(n) for c, n in names.items()]) if names else F.struct(F.lit(0).alias("none"))
    return whole.alias("__kept"), [F.col("__kept")[n].alias(n) for n in names.values()]


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def by_row(df: DataFrame, text: str, doc_id: str, nulls: bool = False) -> tuple[DataFrame, str]:
    """df and a column that tells its rows apart: the ids themselves, or where some repeat, numbers of the rows in order of id and a
    hash of the text, null ids last. Null ids keep a null unless ``nulls`` are to be told apart as well."""
    ids = df.select(F.col(doc_id).alias("id"))
    ids = ids if nulls else ids.filter("id IS NOT NULL")
    if ids.groupBy("id").count().filter("count > 1").limit(1).isEmpty():
        return df, doc_id
    name = fresh("__row", df)
    out = ranked(df, name, F.col(doc_id).asc_nulls_last(), F.xxhash64(text))
    return (out if nulls else out.withColumn(name, F.when(F.col(doc_id).isNotNull(), F.col(name)))), name


def words(text: Column) -> Column:
    """Whitespace-delimited words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else that matters for ASCII words.

    ``lower`` is vectorised in the JVM but also maps two other characters to ASCII letters (the Kelvin sign and the
    dotted capital I); texts that hold one of them take the slower ``translate``.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    return shared_dir(spark.sparkContext)


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows behind a Parquet table in the shared folder, and its path for ``discard``."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Executions planned inside delete their shuffle files as they end, when their rows stand in a table or checkpoint."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, n):
            yield whole.slice(at, n)


def blocks(texts: list, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters or bytes, so that temporary arrays stay small; one long text is a range of its own."""
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= limit:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def give_back(spark: SparkSession) -> None:
    """Has executors collect their garbage, so that heaps which one stage has filled shrink before the next one's Python workers start."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def trimmed(run: Callable) -> Callable:
    """The function for ``mapInArrow``, which at its end gives freed memory back: workers live on for other stages."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the system's pool keeps nothing back that malloc_trim does not reach
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner
