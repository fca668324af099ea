"""Frequency of every term over a collection of records, kept up to date by signed deltas.

The store holds two logs in hash buckets: what each record contributes (record, term, n) and the changes of the counts per
term (term, occurrences, records).  A change set names records that were added, changed or deleted, with their full new
content.  Only those records are aggregated: their old contributions count minus, their new ones plus.  Both are appended
as files of a new version, so a change set costs what it changes, not what the store holds: nothing is written again, and
of the old contributions only the buckets it touches are read.  The counts are the sums of their log, the contributions of a
record those of its last version; a bucket with more than ``most_versions`` versions is merged into one.  A small JSON
state names the versions of each bucket and is replaced at the end, so a failed apply changes nothing and a store can be
opened again by its path.

Aggregation is by (record, term), then by term, each with partial sums before its shuffle, and buckets are written
rebalanced, so neither a term in a third of all entries nor a large bucket is a hot spot.

Defined cases: a null term counts for no term, its record still counts as a record; a null record is left out; a record
that appears in a change set without content is deleted, or was never there; repeated rows are repeated occurrences; an
empty change set changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisframe.store import Files
from axisframe.workspace import fresh_path

#: The row of the null term stands for the records as such; with n = -1 it says that the record was deleted.
_SCHEMAS = {"records": "record long, term string, n long, version int", "counts": "term string, occurrences long, records long"}
_KEYS = {"records": "record", "counts": "term"}
_STATE = "state.json"


class TermCounts:
    """Persistent counts under ``path`` (by default in the session's shared folder).  The number of buckets is fixed when
    the store is made."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64, most_versions: int = 8):
        self.spark, self.path, self.most_versions = spark, path or fresh_path(spark, "term_counts"), most_versions
        self.files = Files(spark, self.path)
        known = json.loads(self.files.read(_STATE)) if self.files.exists(_STATE) else {"buckets": buckets, "version": 0, "records": {}, "counts": {}}
        self.buckets, self.version = known["buckets"], known["version"]
        #: For each table the versions with files of each bucket.
        self.versions: dict[str, dict[str, list[int]]] = {name: known[name] for name in _SCHEMAS}

    @property
    def current(self) -> dict[str, dict[str, int]]:
        """For each table the version that each bucket was last written in."""
        return {name: {b: max(v) for b, v in of.items()} for name, of in self.versions.items()}

    def _read(self, name: str, only: set[str] | None = None) -> DataFrame:
        """The log of a table, or some buckets of it."""
        found = [f"{self.path}/{name}/v{v}/bucket={b}" for b, versions in self.versions[name].items() if only is None or b in only for v in versions]
        return self.spark.read.schema(_SCHEMAS[name]).parquet(*found) if found else self.spark.createDataFrame([], _SCHEMAS[name])

    @staticmethod
    def _summed(log: DataFrame) -> DataFrame:
        return log.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("records > 0")

    @staticmethod
    def _last(log: DataFrame) -> DataFrame:
        """The contributions of each record's last version, deleted records among them."""
        last = F.max("version").over(Window.partitionBy("record"))
        return log.withColumn("__last", last).where("version = __last").drop("__last")

    def counts(self) -> DataFrame:
        """(term, occurrences, records) of every term that occurs."""
        return self._summed(self._read("counts").where("term is not null"))

    def record_count(self) -> int:
        return self._read("counts").where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first().n

    @staticmethod
    def contributions(changed: DataFrame) -> DataFrame:
        """(record, term, n) of changed records, given as (record, term) with a row for each occurrence; the row of the
        null term stands for the record as such and has n = 0."""
        rows = changed.where(F.col("record").isNotNull()).select(F.col("record").cast("long").alias("record"), F.explode(F.array(F.col("term").cast("string"), F.lit(None).cast("string"))).alias("term"))
        return rows.groupBy("record", "term").agg(F.when(F.col("term").isNull(), 0).otherwise(F.count("*")).alias("n"))

    @staticmethod
    def deltas(new: DataFrame, old: DataFrame | None) -> DataFrame:
        """(term, occurrences, records): the signed change of the counts when contributions ``old`` give way to ``new``."""
        signed = new.select("term", F.col("n").alias("occurrences"), F.lit(1).alias("records"))
        if old is not None:
            signed = signed.unionByName(old.select("term", (-F.col("n")).alias("occurrences"), F.lit(-1).alias("records")))
        return signed.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").cast("long").alias("records"))

    def _write(self, name: str, rows: DataFrame, version: int) -> set[str]:
        """Write rows as a version of a table; the buckets it has."""
        bucket: Column = F.pmod(F.hash(_KEYS[name]), F.lit(self.buckets)).alias("bucket")
        rows.select("*", bucket).hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}/v{version}")
        return {x.removeprefix("bucket=") for x in self.files.list(f"{name}/v{version}") if x.startswith("bucket=")}

    def apply(self, changed: DataFrame, deleted: DataFrame | None = None) -> None:
        """Append a change set to the store.  ``changed``: (record, term), the full new content of every added or
        changed record; ``deleted``: (record)."""
        after = self.version + 1
        for name in _SCHEMAS:
            self.files.delete(f"{name}/v{after}")  # of an apply that failed
        rows = self.contributions(changed)
        if deleted is not None:
            gone = deleted.select(F.col("record").cast("long").alias("record")).where("record is not null").distinct()
            gone = gone.join(changed.select(F.col("record").cast("long").alias("record")), "record", "left_anti")
            rows = rows.unionByName(gone.select("record", F.lit(None).cast("string").alias("term"), F.lit(-1).cast("long").alias("n")))
        touched = self._write("records", rows.withColumn("version", F.lit(after)), after)
        log = self.spark.read.schema(_SCHEMAS["records"]).parquet(*[f"{self.path}/records/v{after}/bucket={b}" for b in sorted(touched)]) if touched else None
        following = {name: {b: list(v) for b, v in of.items()} for name, of in self.versions.items()}
        if log is not None:
            old = None
            if touched & set(self.versions["records"]):
                named = log.where("term is null").select("record")
                old = self._last(self._read("records", touched).join(named, "record", "left_semi")).where("n >= 0")
            delta = self.deltas(log.where("n >= 0"), old).where("occurrences <> 0 or records <> 0")
            for name, buckets in (("records", touched), ("counts", self._write("counts", delta, after))):
                for b in buckets:
                    following[name].setdefault(b, []).append(after)
        self._settle(following, after)
        self._compact()

    def _settle(self, versions: dict, version: int) -> None:
        self.files.write(_STATE, json.dumps({"buckets": self.buckets, "version": version} | versions))
        self.version, self.versions = version, versions

    def _compact(self) -> None:
        """Merge the buckets that have too many versions, each table in one write."""
        for name in _SCHEMAS:
            full = {b for b, v in self.versions[name].items() if len(v) > self.most_versions}
            if not full:
                continue
            after, log = self.version + 1, self._read(name, full)
            whole = self._last(log).where("n >= 0") if name == "records" else self._summed(log)
            written = self._write(name, whole, after)
            outdated = [f"{name}/v{v}/bucket={b}" for b in full for v in self.versions[name][b]]
            kept = {b: v for b, v in self.versions[name].items() if b not in full} | {b: [after] for b in written}
            self._settle(self.versions | {name: kept}, after)
            for path in outdated:
                self.files.delete(path)


def variable_names(lines: DataFrame) -> DataFrame:
    """(j, name) of a names file with (j, raw_line): what stands before the first tab, without surrounding spaces,
    no-break spaces and carriage returns, in lower case; lines without a name are left out, repeated ones count once."""
    edge = "[ \u00a0\r]+"
    name = F.regexp_replace(F.substring_index("raw_line", "\t", 1), f"^{edge}|{edge}$", "")
    return lines.select("j", F.lower(name).alias("name")).where("j is not null and name <> ''").distinct()


def entry_terms(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """(record, term): a row for each entry (i, j, seq), however often it was delivered; the term is null where j is null
    or has no name."""
    once = entries.select("i", "j", "seq").distinct()
    return once.join(variable_names(lines), "j", "left").select(F.col("i").alias("record"), F.col("name").alias("term"))


def counts_of_entries(entries: DataFrame, lines: DataFrame, store: TermCounts) -> TermCounts:
    """Load matrix entries into ``store`` in two deliveries, as they arrived: first those written up to the middle of the
    time covered, then, as changed records with their whole content, the rows that later ones touch."""
    span = entries.agg(F.min("written_at").alias("a"), F.max("written_at").alias("b"))
    middle = span.select(F.timestamp_micros(((F.unix_micros(F.col("a").cast("timestamp")) + F.unix_micros(F.col("b").cast("timestamp"))) / 2).cast("long")).alias("m")).first()
    if middle is None or middle.m is None:
        store.apply(entry_terms(entries, lines))
        return store
    late = F.coalesce(F.col("written_at").cast("timestamp") > F.lit(middle.m), F.lit(True))
    store.apply(entry_terms(entries.where(~late), lines))
    touched = entries.where(late).select("i").distinct()
    store.apply(entry_terms(entries.join(touched, "i", "left_semi"), lines))
    return store


def rare_and_common(store: TermCounts, rare_below: int = 5, common_share: tuple[int, int] = (1, 2)) -> DataFrame:
    """(term, occurrences, records, mark): ``rare`` for terms in fewer than ``rare_below`` records, ``common`` for those
    in more than the given share (numerator, denominator) of all records, else null.  Rare goes first."""
    over = F.col("records") * common_share[1] > common_share[0] * store.record_count()
    mark = F.when(F.col("records") < rare_below, "rare").when(over, "common")
    return store.counts().withColumn("mark", mark)
