"""Exact and near duplicates of fingerprints and embeddings, and the ordered choice between them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from samplewright.functions import segments
from samplewright.session import arrow_files, scratch, settle, ship

BITS = 64


def average_hash(pixels: Column) -> Column:
    """64-bit average hash of an array of 64 grey values, row by row: a bit is set where a value exceeds the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda t, v: t + v.cast("double")) / 64
    return F.aggregate(pixels, F.lit(0).cast("bigint"), lambda t, v: F.shiftleft(t, 1).bitwiseOR(F.when(v.cast("double") > mean, 1).otherwise(0).cast("bigint")))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(bits: Column) -> Column:
    return 1 - bits / BITS


def hash_pairs(rows: DataFrame, threshold: int = 6) -> DataFrame:
    """``a, b, distance`` of different hashes within the threshold, a < b, from a column ``hash``.

    Works on distinct values, so copies of one image (a third of all rows, say) are one row; rows are joined back by value.
    The keys by which hashes meet (:mod:`samplewright.functions.segments`) are as long as the number of values asks for, so buckets stay small.
    """
    values = settle(rows.select(F.col("hash").alias("h")).filter("h is not null").distinct(), "dedup-values")
    pieces = segments.pieces_for(values.count(), threshold)
    return segments.near_among(segments.index(values, "h", pieces, threshold), pieces, threshold).filter("a < b")


def exact_groups(rows: DataFrame, key: str, item: str) -> DataFrame:
    """One row per repeated value: its first item and number of rows."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(item).alias("first_item")).filter("n > 1")


def resolve(records: DataFrame, references: DataFrame | None = None, threshold: int = 6) -> DataFrame:
    """Ordered duplicate control: ``item, kept, kind, reference, distance`` for records ``item, ord, hash``.

    In order of ``ord`` a record is a duplicate if it is within the threshold of a reference or of an earlier kept record; a
    duplicate is no reference for later ones. Settled in rounds on distinct values: a
    value's earliest open record is kept once no earlier record near it is open or kept. Records without a hash are kept.
    """
    records = settle(records.select("item", "ord", "hash"), "dedup-records")
    pool = references.select(F.col("item").alias("ref"), "hash").filter("hash is not null") if references is not None else None
    hashes = records.select("hash") if pool is None else records.select("hash").union(pool.select("hash"))
    pairs = hash_pairs(hashes, threshold)
    near = settle(pairs.select(F.col("a").alias("hash"), F.col("b").alias("other"), "distance").union(pairs.select("b", "a", "distance")), "dedup-near")
    reach = lambda values: values.withColumn("distance", F.lit(0)).unionByName(near.join(values.withColumnRenamed("hash", "other"), "other").drop("other"))
    # Of the records of one value only the earliest can ever be kept.
    first = records.filter("hash is not null").groupBy("hash").agg(F.min(F.struct("ord", "item")).alias("m")).select("hash", F.col("m.ord").alias("ord"), F.col("m.item").alias("item"))
    if pool is not None:
        pool = settle(pool.groupBy("hash").agg(F.min("ref").alias("ref")), "dedup-pool")
        first = first.join(reach(pool.select("hash")).select("hash").distinct(), "hash", "left_anti")
    state = settle(first.withColumn("kept", F.lit(None).cast("boolean")), "dedup-round")
    kept: list[DataFrame] = []
    nothing = F.lit(None).cast(records.schema["ord"].dataType)
    while not (waiting := state.filter("kept is null").select("hash", "ord", "item")).isEmpty():
        # A kept value settles all its later neighbours in the round after, so only the last round's are looked at.
        marks = waiting.select(F.col("hash").alias("other"), F.col("ord").alias("open"), nothing.alias("held")).unionByName(state.filter("kept").select(F.col("hash").alias("other"), nothing.alias("open"), F.col("ord").alias("held")))
        around = near.join(marks, "other").groupBy("hash").agg(F.min("open").alias("open"), F.min("held").alias("held"))
        seen = waiting.join(around, "hash", "left")
        verdict = F.when(F.col("held") < F.col("ord"), False).when(F.col("open").isNull() | (F.col("open") > F.col("ord")), True)
        state = settle(seen.select("hash", "ord", "item", verdict.alias("kept")), "dedup-round")
        kept.append(state.filter("kept").select("hash", "ord", "item"))
    held = reduce(DataFrame.unionByName, kept) if kept else first.limit(0)
    held = settle(held.select("hash", "ord", "item"), "dedup-kept")
    marks = reach(held.select("hash", F.lit(1).alias("pool"), F.col("ord").alias("since"), F.col("item").alias("ref")))
    if pool is not None:
        marks = marks.unionByName(reach(pool.select("hash", F.lit(0).alias("pool"), nothing.alias("since"), "ref")))
    met = records.join(marks, "hash").filter("since is null or since < ord")
    best = met.groupBy("item").agg(F.min(F.struct("distance", "pool", "since", "ref")).alias("m"))
    out = records.select("item").join(best, "item", "left")
    return out.select("item", F.col("m").isNull().alias("kept"), F.when(F.col("m").isNull(), "unique").when(F.col("m.distance") == 0, "exact").otherwise("near").alias("kind"), F.col("m.ref").alias("reference"), F.col("m.distance").alias("distance"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero norm or different lengths."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, v: t + v)
    double = lambda x: x.cast("array<double>")
    dot = total(F.zip_with(double(a), double(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))))
    norm = lambda x: F.sqrt(total(F.transform(double(x), lambda v: v * v)))
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), F.try_divide(dot, scale)).otherwise(0.0)


#: Vectors that one comparison takes from either side.
QUERY_BLOCK, ITEM_BLOCK = 2048, 8192


def cosine_matches(queries: DataFrame, accepted: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``query, item, similarity`` of every accepted vector at or above the threshold, from columns ``id, vector`` with BIGINT ids.

    A stated query set against all rows, in blocks. The queries are stored once in the shared folder; every task walks its own accepted vectors in
    blocks and reads the queries past them, so no vector is shuffled or copied, and a task holds one block of either side and their
    similarities. Vectors of no length or of another length than the query's have similarity 0.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.dataset as ds

    spark = queries.sparkSession
    ship(spark)
    folder = scratch(spark, "cosine-queries")
    queries.select("id", F.col("vector").cast("array<double>").alias("vector")).filter("id is not null and vector is not null").write.parquet(folder)
    schema = pa.schema([("query", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64())])

    def unit(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Rows and vectors of length one, by their dimension."""
        sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
        starts, out = np.r_[0, np.cumsum(sizes)[:-1]], {}
        for d in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == d)
            v = np.nan_to_num(flat[starts[at][:, None] + np.arange(d)])
            out[int(d)] = at, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = arrow_files(folder)
        stored = ds.dataset(path, filesystem=system, format="parquet")
        for batch in batches:
            for at in range(0, batch.num_rows, ITEM_BLOCK):
                part = batch.slice(at, ITEM_BLOCK)
                items = unit(part.column(1).cast(pa.list_(pa.float64())))
                names = part.column(0).to_numpy(zero_copy_only=False)
                for block in stored.to_batches(columns=["id", "vector"], batch_size=QUERY_BLOCK):
                    asked = block.column(0).to_numpy(zero_copy_only=False)
                    for d, (i, q) in unit(block.column(1)).items():
                        if d in items:
                            j, r = items[d]
                            similarity = q @ r.T
                            a, b = np.nonzero(similarity >= threshold)
                            if len(a):
                                yield pa.RecordBatch.from_arrays([pa.array(asked[i[a]]), pa.array(names[j[b]]), pa.array(similarity[a, b])], schema=schema)

    return accepted.select(F.col("id").cast("bigint"), "vector").filter("id is not null and vector is not null").mapInArrow(compare, "query bigint, item bigint, similarity double")


def latest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).filter("__r = 1").drop("__r")
