"""Document fingerprints by SpotSigs: chains of content words that follow common words.

A text is cut into lower-case words of letters and digits. Each common word (the fixed list of the quality rules) is
an anchor; its signature is the anchor and the next two words that are not common themselves. A fingerprint is the
set of 32-bit hashes of the signatures, written as sorted hex digits. A text with fewer than
``LEAST_CHAINS`` different signatures takes all its words instead, one without words its characters as they are.

Near pairs: a pair of likeness t has set lengths within the factor t, so sets are dealt by length class and
compared with their own and the next longer class only. Within a class pair, two sets that are alike enough
share one of the first ``n - ceil(t n) + 1`` of their sorted hashes; candidates by those are compared whole.

Defined results: null text is empty and has an empty fingerprint, two empty ones are alike by 1; a row without
an id has no next document; of rows with one id the text decides the order; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.quality import COMMON, let

LEAST_CHAINS = 3
BUCKETS_PER_PARTITION = 8
_MASK = (1 << 32) - 1
_ANCHOR = r"(?<= )(?:" + "|".join(sorted(set(COMMON))) + r")(?= )"
# A run of anchors, the content word after it, and the next one past any anchors. Possessive loops run without
# recursion, and a run is read once however long it is.
_RUN = r"((?:~\S++ )++)([^~ ]\S*+ )(?=(?:~\S++ )*+([^~ ]\S*+ ))"
# Two words that end every text, so that each run matches; signatures that hold them are dropped.
_END = "# # "


def _hashed(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(_MASK)))))


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes of a text."""
    spaced = F.concat(F.lit(" "), F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(spaced, r" {2,}", " "), _ANCHOR, "~$0")

    def of(s: Column) -> Column:
        ended = F.concat(s, F.lit(_END))
        runs, near, far = (F.regexp_extract_all(ended, F.lit(_RUN), F.lit(k)) for k in (1, 2, 3))

        def signed(anchors: Column, content: Column) -> Column:
            whole = F.transform(F.array_distinct(F.array_remove(F.split(anchors, " "), "")), lambda a: F.concat(a, F.lit(" "), content))
            return F.when(F.contains(content, F.lit("#")), F.array().cast("array<string>")).otherwise(whole)

        chains = F.flatten(F.zip_with(runs, F.zip_with(near, far, lambda a, b: F.concat(a, b)), signed))
        words = F.array_remove(F.split(s, " "), "")

        def chosen(c: Column) -> Column:
            return F.when(F.size(c) >= LEAST_CHAINS, c).otherwise(
                F.when(F.size(words) > 0, words).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
            )

        return let(F.array_distinct(chains), lambda c: _hashed(chosen(c)))

    return let(marked, of)


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both)),
    )


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, extra, bucket): every row with the text of the next id, the last with that of the first.

    Ids are dealt to ranges, as many as ``BUCKETS_PER_PARTITION`` times the shuffle partitions; the first rows of a
    range also stand, as extra ones, at the end of the range before.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    ends = docs.select(F.min("doc_id").cast("long").alias("low"), F.max("doc_id").cast("long").alias("high")).first()
    ranges = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = ends["low"] or 0
    width = ((ends["high"] or 0) - low) / ranges + 1.0 / ranges
    bucket = F.least(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(ranges - 1)).cast("long")
    # one row per range: a bounded table
    heads = rows.where("doc_id is not null").groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("head"))
    every = Window.partitionBy(F.lit(0)).orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy(F.lit(0)))
    heads = heads.select(F.col("head").alias("head"), F.coalesce(F.lag("bucket").over(every), last).alias("before"))
    placed = rows.withColumn("bucket", F.coalesce(bucket, -1 - F.pmod(F.xxhash64("text"), F.lit(ranges))))
    dealt = placed.join(F.broadcast(heads), F.col("doc_id") == F.col("head"), "left").select(
        "doc_id",
        "text",
        F.explode(
            F.when(F.col("head").isNull(), F.array(F.struct("bucket", F.lit(False).alias("extra")))).otherwise(
                F.array(F.struct("bucket", F.lit(False).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra")))
            )
        ).alias("at"),
    )
    order = Window.partitionBy("bucket").orderBy("extra", "doc_id", "text")
    dealt = dealt.select("doc_id", "text", "at.bucket", "at.extra")
    following = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    return dealt.select("*", following.alias("next_text"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = followed(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    tail = F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), tail))
    signed = rows.select(
        "doc_id",
        "bucket",
        "extra",
        "n_chars",
        "text",
        F.sha2("edited", 256).alias("edited_sha256"),
        signatures(F.col("text")).alias("own"),
        F.when(~F.col("extra"), signatures(F.col("edited"))).alias("changed"),
    )
    order = Window.partitionBy("bucket").orderBy("extra", "doc_id", "text")
    following = F.when(F.col("doc_id").isNotNull(), F.lead("own").over(order))
    beside = signed.select("*", F.coalesce(following, F.array().cast("array<bigint>")).alias("next")).where("not extra")
    return beside.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, near): the pairs of different fingerprints alike by ``least``, each named by its smallest doc_id."""
    signed = docs.select("doc_id", signatures(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own"))
    sets = signed.where(F.size("own") > 0).groupBy("own").agg(F.min("doc_id").alias("doc_id"))
    size = F.size("own")
    # lengths of one class differ by less than the factor ``least``
    length_class = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)) + F.lit(1e-9)).cast("int")
    prefix = F.slice("own", 1, (size - F.ceil(size * F.lit(least) - F.lit(1e-9)) + 1).cast("int"))
    keyed = sets.select("doc_id", size.alias("n"), length_class.alias("length"), F.explode(prefix).alias("key"))
    left = keyed.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), "key", "length")
    right = keyed.select(
        F.col("doc_id").alias("y"), F.col("n").alias("ny"), "key", F.explode(F.array("length", F.col("length") - 1)).alias("length")
    )
    fits = (F.col("ny") >= F.col("nx")) & (F.col("nx") >= F.col("ny") * F.lit(least) - F.lit(1e-9)) & (
        (F.col("ny") > F.col("nx")) | (F.col("x") < F.col("y"))
    )
    pairs = left.join(right, ["key", "length"]).where(fits).select("x", "y").distinct()
    near = likeness(F.col("sx"), F.col("sy"))
    whole = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("own").alias("sx")), "x").join(
        sets.select(F.col("doc_id").alias("y"), F.col("own").alias("sy")), "y"
    )
    return whole.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), near.alias("near")).where(F.col("near") >= least - 1e-9)
