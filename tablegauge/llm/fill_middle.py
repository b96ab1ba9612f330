"""Fill-in-middle: a text is cut into prefix, middle and suffix, and put together again with the middle last.

A unit is a word with the white space before it, or the white space that ends a text. One ``fullmatch`` of
``(unit)*`` reads the whole text; the ``regex`` library keeps every repetition of the group, so ``ends(1)`` holds
the number of units and the offset after each of them, and both cuts are two look-ups. All loops of the pattern
are possessive: a text is read once, without a stack.

The draws come from a hash of seed and id, so a task that runs again draws the same. ``restored`` takes a text back
from its output and form; that is exact because a text that holds a sentinel stays plain.

Defined results: a null text is an empty one, an empty one stays plain and has no unit; a row without an id draws as
the id of no characters; rows that repeat an id draw alike, each from its own text; further columns are not read and
not returned, so their names cannot clash; an empty table gives none. A long text is one match in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNITS = r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+"
RATE = 50  # texts that are cut, of 100
SPM_RATE = 80  # cut texts that put the suffix first, of 100


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers: two cuts, whether to cut, and the order of the parts."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def arranged(
    text: str, numbers: Sequence[int], units: regex.Pattern, sentinels: Sequence[str], rate: int, spm_rate: int
) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output of one text."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    if not n or numbers[2] % 100 >= rate or any(s in text for s in sentinels):
        return n, PLAIN, None, None, text
    first, second = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    low, high = (ends[cut - 1] if cut else 0 for cut in (first, second))
    before, after, between = sentinels
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if numbers[3] % 100 < spm_rate:
        return n, SPM, low, high - low, f"{after}{suffix}{before}{prefix}{between}{middle}"
    return n, PSM, low, high - low, f"{before}{prefix}{after}{suffix}{between}{middle}"


def transformed(
    docs: DataFrame, seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: Sequence[str] = SENTINELS
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(UNITS)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            made = [
                arranged(text.as_py() or "", draws(seed, doc_id.as_py()), units, sentinels, rate, spm_rate)
                for doc_id, text in zip(ids, texts)
            ]
            n, form, prefix, middle, output = zip(*made) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, texts.type),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return rows.mapInArrow(
        arrange, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that was put into ``form`` as ``output``; a plain output is the text."""
    before, after, between = sentinels

    def part(opens: str, closes: str | None) -> Column:
        rest = F.substring_index(output, opens, -1)
        return F.substring_index(rest, closes, 1) if closes else rest

    middle = part(between, None)
    psm = F.concat(part(before, after), middle, part(after, between))
    spm = F.concat(part(before, between), middle, part(after, before))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """The transformed documents, with digests of the outputs and of the texts restored from them."""
    rows = transformed(docs)
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), drawn AS (
    SELECT doc_id, t, u, len(u) AS n,
           CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM units
), parts AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS p,
           array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:n], '') AS s
    FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
