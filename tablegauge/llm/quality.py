"""Quality rules of documents: counted defects, then divergence from the language's distributions.

A document's character classes and common words are histograms. The reference of a language pools the
histograms of all its documents; a document is compared to the reference of its own language, or to
that of all documents where the language is null. Its verdict is the Jensen-Shannon distance (the root
of the divergence, base 2) of each histogram against a limit; a histogram with too few counts is not judged.

``word_distance`` compares the common words among themselves; ``vocabulary_distance`` has one bin more, for all
other words, and judges every text of ``LEAST_WORDS`` words, most of all one without common words. Its limit comes from the language's own
texts of a like length (within a factor of two): the median of distance times root of the word count, plus ``MOST_SPREAD`` standard deviations, taken
from the lower quartile, which texts that diverge do not move. Fewer than ``LEAST_TEXTS`` such texts take the limit of
the whole language, then of all documents.

Everything is one expression over the text: words and lines are arrays of a row, repeated windows are
found by sorting (hash, place) pairs inside the row, and only counts leave it.

Defined results: null or wordless text has no words, fails the base rules and is not kept; rows without an id and rows that
repeat one are judged like any other; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.session import durable

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
# A histogram with fewer counts is not judged.
LEAST_CHARS, LEAST_COMMON = 200, 20
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.30, 0.75
# Spread of vocabulary distances: texts that a limit needs, standard deviations, and the width of a counted step.
LEAST_TEXTS, MOST_SPREAD, STEP = 20, 3.5, 0.01
# Up to so many languages the references and limits are broadcast.
FEW_LANGUAGES = 500
WORD_GAP = r"[\x20\x09-\x0D]+"
# Characters of each class, and frequent words of four languages.
CLASSES = {
    "lower": "a-z", "upper": "A-Z", "digit": "0-9", "blank": r"\s", "stop": r".,;:!?'\"()\-", "symbol": r"#*$%&|<>@~^_=+/\\\[\]{}",
}
COMMON = (
    "the of and to in a is it that for was on with as be by this are from at der die das und von zu mit den des ist für auf im nicht "
    "le les et un une est du pour qui dans sur par el los las y en que de la por con se un del"
).split()


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _equal_to(word: str):
    return lambda x: x == word


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text."""

    def covered(places: Column) -> Column:
        # a place covers itself and two more words, as far as the next place
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda p, q: F.least(F.coalesce(q - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def found(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            keyed,
            lambda s: covered(
                F.array_sort(
                    F.transform(
                        F.filter(
                            F.transform(
                                s,
                                lambda x, k: F.struct(
                                    x["i"].alias("i"),
                                    (x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])).alias("twice"),
                                ),
                            ),
                            lambda x: x["twice"],
                        ),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return let(
            hashed,
            lambda h: F.transform(
                F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
            ),
        )

    none = F.lit(0).cast("long")
    return F.when(
        F.size(words) >= 4,
        let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(found(h))),
    ).otherwise(none)


def _length_of(text: Column, outside: str) -> Column:
    """How many characters the class ``outside`` does not match."""
    return F.length(F.regexp_replace(text, f"{outside}+", "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base rules and both histograms."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    classes = [_length_of(F.col("text"), f"[^{c}]") for c in CLASSES.values()]
    lowered = F.transform(F.col("words"), lambda w: F.lower(w))
    common = F.filter(lowered, lambda w: w.isin(sorted(set(COMMON))))
    counted = rows.select(
        "doc_id",
        "lang",
        F.length("text").cast("long").alias("chars"),
        F.size("words").cast("long").alias("n_words"),
        _length_of(F.col("text"), r"[\x20\x09-\x0D]").alias("word_chars"),
        _length_of(F.col("text"), r"[^#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*classes).alias("classes"),
        let(
            F.array_sort(common),
            lambda c: F.array(*[F.size(F.filter(c, _equal_to(w))).cast("long") for w in sorted(set(COMMON))]),
        ).alias("common"),
    )
    rest = F.col("chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, n: a + n)
    return counted.withColumn("classes", F.concat("classes", F.array(F.greatest(rest, F.lit(0).cast("long"))))).drop("chars")


def references(rows: DataFrame) -> DataFrame:
    """Pooled histograms by language (lang, class_sums, common_sums, other_sum), and of all documents under null."""
    sizes = {"classes": len(CLASSES) + 1, "common": len(set(COMMON))}
    total = F.aggregate("common", F.lit(0).cast("long"), lambda a, n: a + n)
    sums = [F.sum(F.col("classes")[k]) for k in range(sizes["classes"])], [F.sum(F.col("common")[k]) for k in range(sizes["common"])]
    pooled = [F.array(*sums[0]).alias("class_sums"), F.array(*sums[1]).alias("common_sums"), F.sum(F.col("n_words") - total).alias("other_sum")]
    some = rows.where("n_words > 0")
    whole = some.agg(*pooled).select(F.lit(None).cast("string").alias("lang"), "class_sums", "common_sums", "other_sum")
    return some.where("lang is not null").groupBy("lang").agg(*pooled).unionByName(whole)


def _by_language(rows: DataFrame, table: DataFrame, few: bool, *more: str) -> DataFrame:
    """``rows`` with the columns of ``table`` for its lang (null is one) and the columns ``more``."""
    table = table.withColumnsRenamed({c: f"_{c}" for c in ("lang", *more)})
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    for c in more:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return rows.join(F.broadcast(table) if few else table, same, "left").drop("_lang", *[f"_{c}" for c in more])


def limits(rows: DataFrame) -> DataFrame:
    """(lang, band, most_scaled): the largest vocabulary distance times root of n_words that is not far, by language and length."""
    judged_rows = rows.where("scaled is not null")
    steps = durable(judged_rows.groupBy("lang", "band", F.round(F.col("scaled") / STEP).alias("step")).agg(F.count("*").alias("n")))

    def limit(counts, name: str) -> DataFrame:
        # exact, from counts: the same in every run
        q = counts.agg(F.percentile("step", [0.25, 0.5], F.col("n")).alias("q"), F.sum("n").alias("n_texts"))
        spread = (F.col("q")[1] - F.col("q")[0]) / 0.6745
        most = F.when(F.col("n_texts") >= LEAST_TEXTS, STEP * (F.col("q")[1] + MOST_SPREAD * spread))
        return q.withColumn(name, most).drop("q", "n_texts")

    everywhere = limit(steps.groupBy(), "_all")
    by_lang = limit(steps.groupBy("lang"), "_own").withColumnRenamed("lang", "_of")
    by_band = limit(steps.groupBy("lang", "band"), "_like")
    named = by_band.join(by_lang, F.col("lang").eqNullSafe(F.col("_of"))).crossJoin(F.broadcast(everywhere))
    return named.select("lang", "band", F.coalesce("_like", "_own", "_all").alias("most_scaled"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms, from their counts."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def shares(h: Column) -> Column:
        return let(F.aggregate(h, F.lit(0.0), lambda a, n: a + n), lambda t: F.transform(h, lambda n: n / t))

    terms = F.zip_with(shares(counts), shares(reference), lambda p, q: 0.5 * part(p, (p + q) / 2) + 0.5 * part(q, (p + q) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.sqrt(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def judged(
    docs: DataFrame, most_char_distance: float = MOST_CHAR_DISTANCE, most_word_distance: float = MOST_WORD_DISTANCE
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance, word_distance and vocabulary_distance (null where not judged) of every document."""
    rows = durable(measured(docs))
    known = durable(references(rows))
    few = known.count() <= FEW_LANGUAGES

    def total(column: str) -> Column:
        return F.aggregate(column, F.lit(0).cast("long"), lambda a, n: a + n)

    rows = _by_language(rows, known, few)
    chars = F.when(total("classes") >= LEAST_CHARS, distance(F.col("classes"), F.col("class_sums")))
    common = F.when(total("common") >= LEAST_COMMON, distance(F.col("common"), F.col("common_sums")))
    words = F.concat("common", F.array(F.col("n_words") - total("common")))
    vocabulary = F.when(
        F.col("n_words") >= LEAST_WORDS, distance(words, F.concat("common_sums", F.array("other_sum")))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = durable(
        rows.select(
            *[c for c in rows.columns if c not in ("classes", "common", "class_sums", "common_sums", "other_sum")],
            failed.alias("base_failed"),
            chars.alias("char_distance"),
            common.alias("word_distance"),
            vocabulary.alias("vocabulary_distance"),
        )
        .withColumn("scaled", F.col("vocabulary_distance") * F.sqrt("n_words"))
        .withColumn("band", F.when(F.col("n_words") > 0, F.length(F.bin("n_words"))).otherwise(0))
    )
    rows = _by_language(rows, limits(rows), few, "band")
    far = (
        F.coalesce(F.col("char_distance") > most_char_distance, F.lit(False))
        | F.coalesce(F.col("word_distance") > most_word_distance, F.lit(False))
        | F.coalesce(F.col("scaled") > F.col("most_scaled"), F.lit(False))
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance", "vocabulary_distance",
    )
