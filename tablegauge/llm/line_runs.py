"""Line dedup against levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, its A-Z lower-cased. Keys of at least ``LEAST_CHARS`` code
points found in at least ``LEAST_DOCS`` documents are claimed by the largest doc_id that holds them; all other
documents lose their lines of that key.

Claims are kept in runs: tables of 128-bit key hashes, hashed into buckets and sorted in each. Documents come in
batches of falling doc_id. The keys of a batch are merge-anti-joined with every run, bucket by bucket and without a
shuffle of the runs; those that no run holds are new, the batch claims them and adds them as a run of level 0.
Whenever a level holds ``FANOUT`` runs they are merged into one of the next level, so there are about
``FANOUT * log(batches)`` runs at any time and each claim is rewritten once a level. ``LineRuns`` can be kept and fed
further batches: lines of later batches whose keys are claimed already are the ones to drop.

A key is counted once a document by a flag on its first line, so counts collapse before the shuffle however common
a line is. The lines of common keys meet their claims in as many parts as their number asks for.

Defined results: a null or empty text is one empty line. Rows count as documents: rows that repeat a doc_id are
several documents, and if it is the largest with a key they all keep their lines; rows without an id are smaller than
all others and keep the lines only they hold. If all lines go, an empty text stays. Further columns are not read
and not returned, so their names cannot clash. An empty table gives none. Ids are integers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.quality import let
from tablegauge.operators.skew import hot_key_join
from tablegauge.session import durable, shared_folder

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
FANOUT = 2
KEY = ["h1", "h2"]
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_BLANK))
    # plain ASCII has a fast lower(); elsewhere lower() would change more than A-Z
    return F.when(F.length(line) == F.octet_length(line), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("row", F.xxhash64("text"))


def long_lines(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row, h1, h2, pos, first) of each line with a long key; ``first`` marks a document's first of its key."""

    def hashed(key: Column, pos: Column) -> Column:
        entry = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), pos.alias("pos"))
        return F.when(F.length(key) >= least_chars, entry)

    def marked(lines: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            before = lines[i - 1]
            first = (i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"])
            return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), first.alias("first"))

        return F.transform(lines, mark)

    keys = F.transform(F.split("text", "\n"), key_of)
    return rows.select("doc_id", "row", F.inline(let(F.array_sort(F.array_compact(F.transform(keys, hashed))), marked)))


class LineRuns:
    """Levelled sorted runs of claimed keys, in tables of ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or 2 * spark.sparkContext.defaultParallelism
        self.levels: list[list[str]] = []

    def write(self, keys: DataFrame) -> str:
        """Keep ``keys`` as a table of sorted buckets; its name."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = keys.repartition(self.buckets, *KEY)
        writer = dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}")
        writer.saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.folder}/{name}")

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unclaimed(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` that no run holds."""
        for run in self.runs:
            keys = keys.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Claim those of the different ``keys`` of a batch that are new."""
        name, level = self.write(self.unclaimed(keys)), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            merged, self.levels[level] = self.levels[level], []
            name, level = self.write(self._union(merged)), level + 1
            for old in merged:
                self.drop(old)

    def _union(self, names: list[str]) -> DataFrame:
        whole = self.spark.table(names[0])
        for name in names[1:]:
            whole = whole.unionByName(self.spark.table(name))
        return whole

    def claims(self) -> DataFrame:
        """All claimed keys, each once."""
        return self._union([name for level in self.levels for name in level])


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped_lines(
    rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES
) -> DataFrame:
    """(doc_id, row, drops): the sorted positions of the lines that documents lose."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    cuts = [i / batches for i in range(1, batches)]
    bounds = rows.approxQuantile("doc_id", cuts, 0.01) if cuts else []
    # equal ids share a batch, rows without an id are in the last one
    below = sum((F.when(F.col("doc_id") < b, 1).otherwise(0) for b in bounds), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(below)
    lines = f"{folder}/lines"
    long_lines(rows, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(lines)
    kind = rows.schema["doc_id"].dataType.simpleString()
    written = f"doc_id {kind}, row bigint, h1 bigint, h2 bigint, pos int, first boolean, batch int"
    kept = spark.read.schema(written).parquet(lines)
    runs = LineRuns(spark, folder)
    counts = kept.groupBy(*KEY).agg(F.count_if("first").alias("docs"), F.count(F.lit(1)).alias("lines"))
    common = runs.write(counts.where(F.col("docs") >= least_docs).select(*KEY, "lines"))
    for i in range(batches):
        own = kept.where(F.col("batch") == i).groupBy(*KEY).agg(F.max("doc_id").alias("keeper"))
        runs.add(own.join(spark.table(common).hint("merge"), KEY))
    claims = runs.claims()
    total = claims.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    held = hot_key_join(
        kept.select("doc_id", "row", "pos", *KEY), claims.withColumn("total", F.lit(total)), KEY, ["doc_id", "row", "pos"], "lines", "total"
    )
    drops = held.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "row")
    result = durable(drops.agg(F.sort_array(F.collect_set("pos")).alias("drops")))
    for name in [common, *(name for level in runs.levels for name in level)]:
        runs.drop(name)
    remove(spark, folder)
    return result


def without(lines: Column, drops: Column) -> Column:
    """``lines`` but those at the sorted positions ``drops``: the stretches between them."""

    def stretch(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(drops[i - 1] + 1)
        end = F.when(i == F.size(drops), F.size(lines)).otherwise(drops[i])
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), stretch))


def deduplicated(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES
) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay) of every document."""
    rows = _rows(docs)
    drops = dropped_lines(rows, least_chars, least_docs, batches).withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    beside = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    stay = let(F.split("text", "\n"), lambda lines: F.concat_ws("\n", without(lines, F.col("drops"))))
    return beside.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(stay).alias("text"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The counts of every document, and the digest of what stays of it."""
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), common AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
