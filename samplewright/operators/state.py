"""Run tables: upsert by key, resume, result cache, event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplewright.session import settle


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key. Write the result to a new path, then exchange the paths.

    Of several rows of one key the last by ``order`` counts, and of equal ones the highest; a null key is a key of its own.
    """
    rest = [*order, *(c for c in rows.columns if c not in key and c not in order)]
    last = rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__r")).select(*key, "__r.*") if rest else rows.distinct()
    named = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)])
    same = [table[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(key)]
    return table.join(named, same, "left_anti").unionByName(last.select(*table.columns))


def pending(planned: DataFrame, recorded: DataFrame, key: Sequence[str], finished: Sequence[str] = ("succeeded", "skipped")) -> DataFrame:
    """Planned nodes without a finished result; a resumed job runs these."""
    done = recorded.filter(F.col("status").isin(*finished)).select(*key)
    return planned.join(done, list(key), "left_anti")


def split_by_cache(planned: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned nodes with a stored result of their ``cache_key``, and those to run."""
    results = cache.select("cache_key", "result_digest").dropDuplicates(["cache_key"])
    return planned.join(results, "cache_key"), planned.join(results, "cache_key", "left_anti")


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table; a count reads only the files' footers."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest_attempts(runs: DataFrame, key: Sequence[str] = ("job_id", "node_id")) -> DataFrame:
    """The row of the highest attempt of each node; repeated rows count once."""
    rest = [c for c in runs.columns if c not in key and c != "attempt"]
    best = runs.groupBy(*key).agg(F.max(F.struct("attempt", *rest)).alias("r"))
    return best.select(*key, "r.*")


def event_counts(events: DataFrame, key: str = "$.k") -> DataFrame:
    """Events per type from a log with JSON properties; a truncated line counts as broken and is not lost."""
    value = F.get_json_object("props", key)
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(value).alias("with_key"), F.count_if(F.col("props").isNotNull() & value.isNull()).alias("broken"))


def read_event_log(spark, path: str, schema: str) -> DataFrame:
    """An append-only JSON lines log; truncated lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


#: Bytes of the largest artifact that is stored.
MOST_BYTES = 256 * 1024 * 1024


def write_once(rows: DataFrame, folder: str, digest: str = "digest", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Append artifacts by content digest; a digest already stored is not written again.

    Gives the rows that were refused, with ``problem``: bytes that do not match their digest, no bytes, or more than ``most_bytes``.
    """
    spark = rows.sparkSession
    rows = settle(rows, "artifacts")
    problem = F.when(F.col("content").isNull(), "no content").when(F.length("content") > most_bytes, "too large").when(~F.sha2("content", 256).eqNullSafe(F.col(digest)), "digest differs")
    wrong = rows.withColumn("problem", problem).filter("problem is not null")
    good = rows.filter(problem.isNull()).dropDuplicates([digest])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        good = good.join(spark.read.parquet(folder).select(digest), digest, "left_anti")
    good.withColumn("prefix", F.substring(digest, 1, 2)).write.mode("append").partitionBy("prefix").parquet(folder)
    return wrong


def read_artifacts(spark, folder: str, wanted: DataFrame, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """Stored artifacts of the wanted digests whose bytes still match, and the digests that are missing or damaged.

    Only the folders of their first two digits are read.
    """
    wanted = wanted.select(digest).distinct()
    prefixes = [r[0] for r in wanted.select(F.substring(digest, 1, 2)).distinct().collect()]  # 256 at most
    kept = [f for f in spark.read.parquet(folder).schema if f.name != "prefix"]
    # Stated, because two hexadecimal digits such as 2d may look like a number.
    stored = spark.read.schema(T.StructType([*kept, T.StructField("prefix", T.StringType())])).parquet(folder)
    found = stored.filter(F.col("prefix").isin(prefixes)).join(wanted, digest, "left_semi").drop("prefix")
    good = found.filter(F.sha2("content", 256) == F.col(digest))
    return good, wanted.join(good.select(digest), digest, "left_anti")
