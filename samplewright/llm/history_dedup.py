"""Problem 1: new batches against everything accepted before them.

:class:`DuplicateIndex` keeps the history in a folder: the segments of its hashes by position, bucketed by key, and its
digests, bucketed by their first 16 digits. ``check`` lets a batch probe it: only the buckets that
the batch's own segments fall into are read, met strings are verified by their distance, and members
of the batch are compared with each other by the same keys. ``accept`` appends the segments of what
the batch added. The history is never compared again.

Many ordered batches may be checked in one call, as ``p1_found`` does with all jobs: the samples are
accepted first, then the candidates of all jobs probe the stored index and each other once, and the order is settled on the links.

Settling: a candidate is a case if an earlier member of the history is linked to it, and a case
never joins, so "linked to an earlier candidate" is not enough. In rounds, every open candidate
without an earlier open neighbour is kept, and every one linked to an earlier kept one is a
case. Neighbours meet through their value (one digest, one hash), of which only the earliest open
and the earliest newly kept order are carried: a value shared by a third of all rows costs one row a task. A kept candidate
settles all its later neighbours in the next round, so a round reads nothing of the rounds before the last.

Defined cases: unreadable hashes and digests count as missing and equal nothing; a candidate with
neither always joins; repeated rows count once; a job without created_at comes last; candidates
without an id are left out; an empty history or batch is allowed; a batch that was accepted before is not stored again.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import clean, segments
from samplewright.llm.tables import latest
from samplewright.session import scratch, settle, shuffled, sweep


def history_values(samples: DataFrame) -> DataFrame:
    """``id, d, h`` of the samples that the history starts with."""
    return samples.filter(clean.bare(F.col("state")).isin("source", "accepted")).select(F.col("sample_id").alias("id"), clean.digest(F.col("digest")).alias("d"), clean.fingerprint(F.col("perceptual_hash")).alias("h"))


def batch_values(candidates: DataFrame, provenance: DataFrame, jobs: DataFrame) -> DataFrame:
    """``id, ord, d, h`` of current accepted candidates; ``ord`` is the order of checking."""
    current = latest(candidates, ["candidate_id"], [F.col("updated_at")], {"state": clean.bare(F.col("state")), "job_id": F.col("job_id"), "d": clean.digest(F.col("output_digest"))}).filter("state = 'accepted'")
    hashes = latest(provenance, ["candidate_id"], [F.col("created_at")], {"h": clean.fingerprint(F.col("perceptual_hash"))})
    when = jobs.filter("job_id is not null").groupBy("job_id").agg(F.min("created_at").alias("job_at"))
    far = F.lit("9999-12-31 00:00:00").cast(jobs.schema["created_at"].dataType)
    joined = current.join(shuffled(hashes), "candidate_id", "left").join(when, "job_id", "left")
    return joined.select(F.col("candidate_id").alias("id"), F.struct(F.coalesce("job_at", far).alias("at"), F.col("candidate_id").alias("id")).alias("ord"), "d", "h")


def _keys(rows: DataFrame, *columns: str) -> DataFrame:
    """Long form of the values: ``columns``, ``kind`` ('d' or 'h'), ``key``."""
    both = F.array(F.struct(F.lit("d").alias("kind"), F.col("d").alias("key")), F.struct(F.lit("h").alias("kind"), F.col("h").cast("string").alias("key")))
    return rows.select(*columns, F.inline(F.filter(both, lambda x: x["key"].isNotNull())))


def _settle_order(batch: DataFrame, struck: DataFrame, linked: DataFrame) -> DataFrame:
    """``id, ord, kept`` of a batch ``id, ord, d, h``.

    ``struck`` are the values ``kind, key`` that the history holds or is near to, ``linked`` the linked values ``kind, key, near`` within the batch.
    """
    nothing = F.lit(None).cast(batch.schema["ord"].dataType)
    rows = _keys(batch, "id", "ord").join(shuffled(struck.withColumn("hit", F.lit(True))), ["kind", "key"], "left")
    hit = rows.groupBy("id").agg(F.max("ord").alias("ord"), F.max("hit").alias("hit"), F.collect_list(F.struct("kind", "key")).alias("keys"))  # two values a row at most
    state = settle(hit.select("id", "ord", "keys", F.when(F.col("hit"), False).alias("kept")), "p1-round")
    decided = [batch.filter("d is null and h is null").select("id", "ord", F.lit(True).alias("kept")), state.filter("kept is not null").select("id", "ord", "kept")]
    while not (open_rows := state.filter("kept is null")).isEmpty():
        waiting = open_rows.select("id", "ord", F.inline("keys"))
        fresh = state.filter("kept").select("ord", F.inline("keys"))
        # The earliest open and the earliest newly kept order of every value, then of every value together with its linked ones.
        first = waiting.select("kind", "key", F.col("ord").alias("open"), nothing.alias("held")).unionByName(fresh.select("kind", "key", nothing.alias("open"), F.col("ord").alias("held")))
        first = first.groupBy("kind", "key").agg(F.min("open").alias("open"), F.min("held").alias("held"))
        around = linked.select("kind", F.col("near").alias("key"), F.col("key").alias("own")).join(shuffled(first), ["kind", "key"]).select("kind", F.col("own").alias("key"), "open", "held")
        around = first.unionByName(around).groupBy("kind", "key").agg(F.min("open").alias("open"), F.min("held").alias("held"))
        seen = waiting.join(shuffled(around), ["kind", "key"]).groupBy("id").agg(F.max("ord").alias("ord"), F.min("open").alias("open"), F.min("held").alias("held"), F.collect_list(F.struct("kind", "key")).alias("keys"))
        verdict = F.when(F.col("held") < F.col("ord"), False).when(F.col("open") >= F.col("ord"), True)
        state = settle(seen.select("id", "ord", "keys", verdict.alias("kept")), "p1-round")
        decided.append(state.filter("kept is not null").select("id", "ord", "kept"))
    return reduce(DataFrame.unionByName, decided)


class DuplicateIndex:
    """The stored history: hash segments and digests in bucket folders of a shared folder, extended batch by batch.

    ``buckets`` and ``pieces`` are fixed when the folder is first used; :meth:`compact` changes them and merges the files of many batches.
    The more buckets, the less a small batch reads: a hash falls into one bucket a key.
    """

    _SEGMENTS, _DIGESTS, _VALUES = "key bigint, h bigint, ref string, seq int, bucket int", "d string, ref string, seq int, bucket int", "id string, d string, h bigint, seq int"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, pieces: int = segments.SEGMENTS) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._names("layout"):
            self._mark(f"layout/0-{buckets}-{pieces}")
        # Each compaction has a folder of its own; the marker of the newest is what readers go by.
        generation, self.buckets, self.pieces = max(tuple(map(int, n.split("-"))) for n in self._names("layout"))
        self._generation, self._root = generation, f"{self.folder}/{generation}"

    def _names(self, part: str) -> list[str]:
        path = self._path(f"{self.folder}/{part}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _mark(self, name: str) -> None:
        self._fs.create(self._path(f"{self.folder}/{name}"), True).close()

    def _stored(self, part: str, schema: str, touched: list[int] | None = None) -> DataFrame:
        """Rows of the batches whose last write was marked, of the touched buckets only."""
        paths = [f"{self._root}/{part}/batch={b}" for b in self._names(f"{self._generation}/commits")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self._root}/{part}").parquet(*paths)
        return rows if touched is None else rows.filter(F.col("bucket").isin(touched))

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of some ``key`` values; never more than there are buckets."""
        return [r[0] for r in keys.select(self._bucket(F.col("key"))).distinct().collect()]

    def existing(self) -> DataFrame:
        """Everything accepted so far: ``id, d, h``."""
        return self._stored("values", self._VALUES).select("id", "d", "h")

    def _write(self, rows: DataFrame, part: str, batch: str) -> None:
        by = rows.repartition("bucket").sortWithinPartitions("bucket", rows.columns[0])
        by.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self._root}/{part}/batch={batch}")

    def _append(self, rows: DataFrame, name: str) -> None:
        """Write ``id, d, h, seq`` rows with their digests and segments; the batch counts once its marker stands."""
        first = F.min(F.struct("seq", F.col("id").alias("ref"))).alias("m")
        hashes = rows.filter("h is not null").groupBy("h").agg(first).select("h", "m.*")
        # The reference of a hash stands with its first key only.
        keys = hashes.select("h", "ref", "seq", F.posexplode(F.array(*segments.key_columns("h", self.pieces))).alias("at", "key"))
        only = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
        self._write(keys.select("key", "h", only("ref"), only("seq"), self._bucket(F.col("key"))), "segments", name)
        digests = rows.filter("d is not null").groupBy("d").agg(first).select("d", "m.ref", "m.seq", self._bucket(segments.prefix("d")))
        self._write(digests, "digests", name)
        rows.select("id", "d", "h", "seq").write.mode("overwrite").parquet(f"{self._root}/values/batch={name}")
        self._mark(f"{self._generation}/commits/{name}")
        sweep(self.spark)

    def accept(self, rows: DataFrame, batch: str) -> None:
        """Append the ``id, d, h`` rows of a batch: its values, digests and segments.

        A batch is stored only once, however often it is sent; a write that broke off is written over when it is sent again.
        """
        name = quote(batch, safe="")
        known = {*self._names(f"{self._generation}/commits"), *self._names(f"{self._generation}/merged")}
        if name not in known:
            self._append(settle(rows.select("id", "d", "h", F.lit(len(known)).alias("seq")), "index-batch"), name)

    def compact(self, buckets: int | None = None, pieces: int | None = None) -> None:
        """Merge the files of all batches into one, laid out for as many hashes as there are now unless ``pieces`` says otherwise.

        Readers see the old files until the merged ones are complete; the names of merged batches stay known.
        """
        values = self._stored("values", self._VALUES)
        names = [*self._names(f"{self._generation}/commits"), *self._names(f"{self._generation}/merged")]
        old, self.buckets = self._root, buckets or self.buckets
        self.pieces = pieces or segments.pieces_for(values.select("h").distinct().count())
        self._generation += 1
        self._root = f"{self.folder}/{self._generation}"
        for n in names:
            self._mark(f"{self._generation}/merged/{n}")
        self._append(values, "%merged")
        self._mark(f"layout/{self._generation}-{self.buckets}-{self.pieces}")
        self._fs.delete(self._path(old), True)

    def links(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Linked values of a settled batch: ``kind, key, near, distance`` to the history, and the same within the batch, where ``key`` and ``near`` differ."""
        hashes = segments.index(batch.select("h").filter("h is not null").distinct(), "h", self.pieces)
        digests = batch.select("d").filter("d is not null").distinct()
        stored = self._stored("segments", self._SEGMENTS, self._touched(hashes)).select("key", "h")
        near_old, near_own = segments.near_pairs(hashes, stored, self.pieces), segments.near_among(hashes, self.pieces)
        known = self._stored("digests", self._DIGESTS, self._touched(digests.select(segments.prefix("d").alias("key")))).select(F.col("d").alias("b"))
        same_old = segments.prefix_pairs(digests, known)
        same_own = segments.prefix_pairs(digests, digests.select(F.col("d").alias("b"))).filter("a <> b")
        both = lambda near, same: near.select(F.lit("h").alias("kind"), F.col("a").cast("string").alias("key"), F.col("b").cast("string").alias("near"), "distance").unionByName(
            same.select(F.lit("d").alias("kind"), F.col("a").alias("key"), F.col("b").alias("near"), F.lit(0).alias("distance"))
        )
        met = settle(both(near_old, same_old), "p1-met")
        sweep(self.spark)
        linked = settle(both(near_own, same_own), "p1-links")
        sweep(self.spark)
        return met, linked

    def decide(self, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Decisions ``id, ord, kept`` for every row of a stored ``id, ord, d, h``, with its links to the history and within."""
        met, linked = self.links(batch)
        return _settle_order(batch, met.select("kind", "key").distinct(), linked), met, linked

    def check(self, batch: DataFrame) -> DataFrame:
        """``id, ord, kept`` for a stored batch of ``id, ord, d, h``; only the buckets it touches are read."""
        return self.decide(batch)[0]

    def references(self, met: DataFrame) -> DataFrame:
        """``kind, near, seq, ref``: the member accepted first of each value in ``near``, read from the touched buckets."""
        near = met.select("kind", "near").distinct()
        hashes = near.filter("kind = 'h'").select("near", F.col("near").cast("bigint").alias("h"))
        hashes = hashes.select("near", "h", segments.key_columns("h", self.pieces)[0].alias("key"))
        digests = near.filter("kind = 'd'").select("near", F.col("near").alias("d"))
        first = lambda rows, kind: rows.groupBy("near").agg(F.min(F.struct("seq", "ref")).alias("m")).select(F.lit(kind).alias("kind"), "near", "m.seq", "m.ref")
        by_hash = self._stored("segments", self._SEGMENTS, self._touched(hashes)).filter("ref is not null").select("key", "h", "seq", "ref")
        by_digest = self._stored("digests", self._DIGESTS, self._touched(digests.select(segments.prefix("d").alias("key")))).select("d", "seq", "ref")
        return first(hashes.join(shuffled(by_hash), ["key", "h"]), "h").unionByName(first(digests.join(shuffled(by_digest), "d"), "d"))


def _after_samples(samples: DataFrame, batch: DataFrame) -> DuplicateIndex:
    """A new stored index that holds the samples in state source or accepted, with keys long enough for the batch as well."""
    history = settle(history_values(samples), "p1-history")
    sweep(samples.sparkSession)
    hashes = history.select(F.count("h").alias("n")).first()["n"] + batch.select(F.count("h").alias("n")).first()["n"]
    index = DuplicateIndex(samples.sparkSession, scratch(samples.sparkSession, "p1-index"), pieces=segments.pieces_for(hashes))
    index.accept(history, "samples")
    return index


def found(candidates: DataFrame, provenance: DataFrame, jobs: DataFrame, samples: DataFrame) -> DataFrame:
    """Ids of the candidates that repeat, exactly or nearly, something accepted before."""
    batch = settle(batch_values(candidates, provenance, jobs), "p1-batch")
    decided = _after_samples(samples, batch).check(batch)
    return decided.filter("not kept").select(F.col("id").alias("candidate_id"))


def decisions(candidates: DataFrame, provenance: DataFrame, jobs: DataFrame, samples: DataFrame) -> DataFrame:
    """``candidate_id, kind, reference_id, distance`` of every case.

    The reference is the nearest member of the history at that time; samples come before candidates, then the earliest.
    ``kind`` is exact for distance 0 (equal digest or hash), else near.
    """
    batch = settle(batch_values(candidates, provenance, jobs), "p1-batch")
    index = _after_samples(samples, batch)
    decided, met, linked = index.decide(batch)
    decided = settle(decided, "p1-decided")
    nothing = F.lit(None).cast(batch.schema["ord"].dataType)
    cases = _keys(batch, "id", "ord").join(shuffled(decided.filter("not kept").select("id")), "id")
    old = index.references(met).select("kind", "near", F.lit(0).alias("pool"), nothing.alias("since"), "ref")
    old = cases.join(shuffled(met), ["kind", "key"]).join(shuffled(old), ["kind", "near"]).select("id", "distance", "pool", "since", "ref")
    # One reference per value: of equal members only the first could ever be named.
    kept = _keys(batch, "id", "ord").join(shuffled(decided.filter("kept").select("id")), "id").groupBy("kind", "key").agg(F.min(F.struct("ord", "id")).alias("m")).select("kind", F.col("key").alias("near"), F.lit(1).alias("pool"), F.col("m.ord").alias("since"), F.col("m.id").alias("ref"))
    own = cases.select("id", "ord", "kind", F.col("key").alias("near"), F.lit(0).alias("distance")).unionByName(cases.join(shuffled(linked), ["kind", "key"]).select("id", "ord", "kind", "near", "distance"))
    own = own.join(shuffled(kept), ["kind", "near"]).filter("since < ord").select("id", "distance", "pool", "since", "ref")
    best = old.unionByName(own).groupBy("id").agg(F.min(F.struct("distance", "pool", "since", "ref")).alias("m"))
    return best.select(F.col("id").alias("candidate_id"), F.when(F.col("m.distance") == 0, "exact").otherwise("near").alias("kind"), F.col("m.ref").alias("reference_id"), F.col("m.distance").alias("distance"))
