"""Repeated lines leave all documents but the first, by levelled sorted runs of line hashes.

Spark SQL functions only: no Python workers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bind import let
from ..session import cut_lineage
from .common import drop_folder, new_folder, settings

#: Stripped at both ends of a line, letters that are lower-cased, second seed of the line hash.
BLANKS, UPPER, LOWER, SEED = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", 0x5EED
KEY = ["h1", "h2"]


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _key(line: Column) -> Column:
    bare = _bare(line)
    # lower() has a fast path for plain ASCII, where it changes nothing but A-Z
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id, row_hash, pos, h1, h2`` of every line whose key has at least ``least`` code points.

    The two seeds make a hash of 128 bits. ``row_hash`` tells texts of a repeated doc_id apart.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    # lower-casing keeps the length, so the test needs the stripped line alone
    return lines.where(F.char_length(_bare(F.col("line"))) >= least).select(
        "doc_id", "row_hash", "pos", F.xxhash64(_key(F.col("line"))).alias("h1"), F.xxhash64(F.lit(SEED), _key(F.col("line"))).alias("h2"))


class LineRuns:
    """All line hashes seen so far, as sorted runs in levels.

    A run is a table bucketed and sorted by the hash in the shared folder, so a merge join with a new batch
    shuffles and sorts only the batch. A run of level l+1 is the merge of ``fan`` runs of level l; every hash
    is in one run, and with n batches it is rewritten at most log(n) to the base ``fan`` times.
    """

    def __init__(self, spark: SparkSession, fan: int = 2, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.levels, self.names = new_folder(spark, "runs"), [[]], []

    def _store(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return name

    def _hashes(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not known").select(*KEY)

    def compact(self) -> None:
        """Merges every full level into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan:
                first, *rest = (self._hashes(n) for n in self.levels[level])
                for r in rest:
                    first = first.unionAll(r)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                merged = first.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
                self.levels[level + 1].append(self._store(merged.withColumn("known", F.lit(False))))
                self.levels[level] = []
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge-joins a batch of ``line_hashes`` with all runs and stores what the runs lack as a new run.

        Every document of a batch must come after all documents of earlier batches.
        Returns ``doc_id, row_hash, pos`` of the lines to drop.
        """
        with settings(self.spark, **{"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}):
            self.compact()
            keys = lines.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
            seen = [F.lit(False)]
            for i, name in enumerate(n for level in self.levels for n in level):
                keys = keys.join(self._hashes(name).withColumn(f"in{i}", F.lit(True)).hint("merge"), KEY, "left")
                seen.append(F.coalesce(f"in{i}", F.lit(False)))
            known = seen[0]
            for s in seen[1:]:
                known = known | s
            run = self._store(keys.select(*KEY, "first", "last", "n", known.alias("known")))
            self.levels[0].append(run)
            # keys of earlier batches lose all lines here, others those behind their first document
            answers = self.spark.table(run).where("known or first < last").select(*KEY, "n", F.when(~F.col("known"), F.col("first")).alias("keep"))
            total = self.spark.table(run).agg(F.sum("n")).first()[0] or 0
            # the most frequent lines meet their documents by broadcast, at most 4 rows a bucket
            hot = F.col("n") > max(1000, total // (4 * self.buckets))
            behind = "keep is null or doc_id > keep"
            often = F.broadcast(answers.where(hot).drop("n"))
            out = [lines.join(often, KEY).where(behind), lines.join(often, KEY, "left_anti").join(answers.where(~hot).drop("n").hint("merge"), KEY).where(behind)]
            return cut_lineage(out[0].unionAll(out[1]).select("doc_id", "row_hash", "pos"))

    def drop(self) -> None:
        """Forgets all runs and deletes their files."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(self.folder)
        self.levels, self.names = [[]], []


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: the texts without the lines that ``drops`` names."""
    gone = drops.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("gone")).toDF("_doc", "_hash", "gone").hint("shuffle_hash")
    all_docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    met = all_docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_hash") == F.col("_hash")), "left")

    def kept(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), text.alias("text"))

    parts = let(_lines(F.col("text")), kept)
    done = met.select("doc_id", parts.alias("kept"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_dropped"))
    return done.select("doc_id", "kept.n_lines", "n_dropped", "kept.text")


def dedup_lines(docs: DataFrame, batches: int = 4, fan: int = 2, least: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row of ``docs`` (doc_id, text; others are not read).

    A line's key is the line stripped of blanks at both ends, A-Z lower-cased. Keys of at least ``least`` code
    points found in two documents or more lose all their lines but those of the smallest doc_id holding it. The table is taken in as
    ``batches`` ranges of doc_id, one after the other, as if they arrived in time. A null text is one empty line.
    Rows of one doc_id are one document; rows without one are one document that comes last. Equal rows stay.
    An empty table gives no rows.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for c in sorted(set(cuts or [])):
        batch = batch + F.when(F.col("doc_id") > c, 1).otherwise(0)
    lines_at = new_folder(spark, "lines")
    line_hashes(docs, least).withColumn("batch", F.when(F.col("doc_id").isNull(), batches).otherwise(batch)).write.partitionBy("batch").parquet(lines_at)
    schema = "doc_id long, row_hash long, pos int, h1 long, h2 long, batch int"
    lines, runs, drops = spark.read.schema(schema).parquet(lines_at), LineRuns(spark, fan), None
    for b in sorted(r[0] for r in lines.select("batch").distinct().collect()):
        now = runs.add(lines.where(F.col("batch") == b).drop("batch"))
        drops = now if drops is None else drops.unionAll(now)
    runs.drop()
    drop_folder(lines_at)
    return without_lines(docs, drops if drops is not None else spark.createDataFrame([], "doc_id long, row_hash long, pos int"))
