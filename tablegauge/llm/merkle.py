"""Merkle manifest of a dataset: a tree of digests per group, and one over the groups' roots.

Every row is a leaf, the digest of its columns. Per group the leaves stand by id; runs of ``FANOUT`` consecutive nodes
become the digest of their digests, level by level, until one remains, the group's root; the groups' roots, in their
order, make the dataset's root in the same way.

Leaves get their position by range partitions and running counts. A block is ``FANOUT ** DEPTH`` aligned positions and
keeps each of its levels as one string of hex digests, so a node is a substring of fixed width: parents hash the
substrings of a run, and the siblings of a node are the substrings that flank it in its run. The tops of blocks, again
with positions, are the leaves of the next round, until each group has one block. Proofs go the other way: a
block hands to each of its nodes that node's own flanks, followed by what the block has been handed itself.
A block has a bounded number of leaves and no task sees more than a block of a group, however large the group.

Strings of digests are kept as bytes, where a substring is taken in constant time.

Defined results: a null column is written ``-``, a null group is a group of its own and comes first, rows without an id
come first in their group, ties of id stand by leaf, so rows that repeat each other are interchangeable. A group of one
row has its leaf for a root, a dataset of one group that group's. An empty table gives none. Columns that are not hashed
are not read and not returned, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.order_stats import running_totals
from tablegauge.session import durable

FANOUT = 8
DEPTH = 3  # levels of a block
BLOCK = FANOUT**DEPTH
WIDTH = 64  # hex digits of a digest
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    # plain ASCII has a fast lower(); elsewhere lower() would change more
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def _nodes(level: Column, start: Column, count: Column) -> Column:
    """``count`` digests of ``level`` from the node ``start`` on; fewer at its end."""
    return F.substring(level, start * WIDTH + 1, count * WIDTH)


def _parents(level: Column) -> Column:
    runs = F.ceil(F.octet_length(level) / (FANOUT * WIDTH)).cast("int")
    each = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(_nodes(level, i * FANOUT, F.lit(FANOUT))))
    return F.array_join(each, "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(group, block, n, items, level_0.., top) from nodes (group, pos, n, digest, item) with ``n`` nodes a group."""
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", "item")))
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    found = nodes.groupBy("group", block.alias("block")).agg(F.max("n").alias("n"), items.alias("items"))
    found = found.withColumn("level_0", F.array_join("items.digest", "").cast("binary"))
    for k in range(1, DEPTH + 1):
        # a level exists while more than one node of the group remains
        found = found.withColumn(f"level_{k}", F.when(F.col("n") > FANOUT ** (k - 1), _parents(F.col(f"level_{k - 1}"))))
    top = F.coalesce(*[F.col(f"level_{k}") for k in range(DEPTH, -1, -1)]).cast("string")
    return found.withColumn("top", top).drop(f"level_{DEPTH}")


def _flanks(pos: Column) -> Column:
    """The siblings of a block's node, level by level: array of (left, right)."""
    within, levels = F.pmod(pos, F.lit(BLOCK)).cast("int"), []
    for k in range(DEPTH):
        at = F.floor(within / FANOUT**k).cast("int")
        left = F.pmod(at, F.lit(FANOUT))
        level = F.col(f"level_{k}")
        segment = F.struct(
            _nodes(level, at - left, left).alias("left"), _nodes(level, at + 1, F.lit(FANOUT - 1) - left).alias("right")
        )
        levels.append(F.when(F.col("n") > FANOUT**k, segment))
    return F.array_compact(F.array(*levels))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes (group, at, digest, item), of the blocks' tops, and so on up to one block a group."""
    # finding the ranges reads the nodes twice
    counted = running_totals(durable(nodes).withColumn("one", F.lit(1)), ["group"], "at", ["one"])
    placed = counted.select("group", F.col("before_one").alias("pos"), F.col("total_one").alias("n"), "digest", "item")
    rounds = [durable(_blocks(placed))]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        up = rounds[-1].select(
            "group",
            F.col("block").alias("pos"),
            F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
            F.col("top").alias("digest"),
            F.lit(None).cast("string").alias("item"),
        )
        rounds.append(durable(_blocks(up)))
        most = -(-most // BLOCK)
    return rounds


def _handed_down(rounds: list[DataFrame], above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(group, pos, digest, item, proof, carried..) of the first round's nodes; ``above`` has a row a group."""
    held = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        node = F.transform(
            "items",
            lambda x: F.struct(x["pos"], x["digest"], x["item"], F.concat(_flanks(x["pos"]), F.col("proof")).alias("proof")),
        )
        held = blocks.join(held, ["group", "block"]).select("group", *carried, F.inline(node))
        nodes, held = held, held.select("group", *carried, F.col("pos").alias("block"), "proof")
    return nodes


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    altered: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per row: the ``order`` column, leaf, altered (leaf), subroot, root, proof.

    ``proof`` is an array of (left, right), the siblings of each level as hex text from the leaf's own to the root's.
    ``altered`` gives other values for some of the columns; the leaf they would have is returned too, null where it is the same.
    """
    values = {c: F.col(c) for c in columns}
    leaf = digest(*map(written, values.values()))
    other, changed = F.lit(None).cast("string"), F.lit(False)
    if altered:
        changed = reduce(lambda a, b: a | b, [~c.eqNullSafe(F.col(n)) for n, c in altered.items()])
        other = F.when(changed, digest(*map(written, (values | dict(altered)).values())))
    # null first, then bytewise
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = docs.select(key.alias("group"), leaf.alias("digest"), F.struct(F.col(order).alias("id"), other.alias("altered")).alias("item"))
    rounds = _rounds(leaves.withColumn("at", F.struct("item.id", "digest")))
    tops = rounds[-1].select(F.lit("").alias("group"), F.col("group").alias("at"), F.col("top").alias("digest"), F.col("group").alias("item"))
    upper = _rounds(tops)
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    roots = upper[-1].select("group", F.col("top").alias("root"), none.alias("proof"))
    subroots = _handed_down(upper, roots, ["root"])
    above = durable(subroots.select(F.col("item").alias("group"), F.col("digest").alias("subroot"), "root", "proof"))
    rows = _handed_down(rounds, above, ["subroot", "root"])
    return rows.select(F.col("item.id").alias(order), F.col("digest").alias("leaf"), "item.altered", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node.cast("binary"), s["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings as one text, level by level."""
    nothing = F.lit("").cast("binary")
    return F.aggregate(proof, nothing, lambda text, s: F.concat(text, s["left"], s["right"]))


def report(docs: DataFrame) -> DataFrame:
    """The manifest with digests of the proofs, and the check of rows of which a third has been tampered with."""
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    text = F.col("text").cast("string")
    rows = manifest(docs, altered={"text": F.when(third, ascii_lower(text)).otherwise(text)})
    checked = rows.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return checked.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295)"""


def _enc(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _tree(name: str, levels: int) -> str:
    """Nodes ``name_0`` (g, pos, n, h) and what climbs from them, ``name_climb_0`` (id, g, pos, fold, sibs), as CTEs."""
    steps = []
    for k in range(levels):
        steps.append(
            f"""{name}_{k + 1} AS MATERIALIZED (
    SELECT g, pos // 8 AS pos, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
    FROM {name}_{k} GROUP BY g, pos // 8)"""
        )
        steps.append(
            f"""{name}_climb_{k + 1} AS MATERIALIZED (
    SELECT id, c.g, c.pos // 8 AS pos,
           CASE WHEN max(s.n) = 1 THEN max(fold) ELSE sha256(coalesce(string_agg(h, '' ORDER BY s.pos) FILTER (s.pos < c.pos), '') || max(fold)
             || coalesce(string_agg(h, '' ORDER BY s.pos) FILTER (s.pos > c.pos), '')) END AS fold,
           max(sibs) || coalesce(string_agg(h, '' ORDER BY s.pos) FILTER (s.pos <> c.pos), '') AS sibs
    FROM {name}_climb_{k} c JOIN {name}_{k} s ON c.g = s.g AND c.pos // 8 = s.pos // 8
    GROUP BY id, c.g, c.pos)"""
        )
    return ",\n".join(steps)


_LANG_LEVELS, _ROOT_LEVELS = 8, 3  # enough for 16 million documents a language, and 512 languages
ORACLE = f"""
WITH told AS (
    SELECT *, CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0
                   THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS told
    FROM documents
), leaves AS MATERIALIZED (
    SELECT doc_id AS id, coalesce('1' || lang, '0') AS g,
           sha256({" || ".join(_enc(c) for c in COLUMNS)}) AS h, sha256({" || ".join(_enc(c) for c in (*COLUMNS[:-1], "told"))}) AS t
    FROM told
), placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), node_0 AS (SELECT g, pos, n, h FROM placed
), node_climb_0 AS (SELECT id, g, pos, t AS fold, '' AS sibs FROM placed
), {_tree("node", _LANG_LEVELS)}, tops AS MATERIALIZED (
    SELECT g AS lang, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, h FROM node_{_LANG_LEVELS}
), top_0 AS (SELECT g, pos, n, h FROM tops
), top_climb_0 AS (SELECT id, '' AS g, tops.pos, fold, sibs FROM node_climb_{_LANG_LEVELS} c JOIN tops ON c.g = tops.lang
), {_tree("top", _ROOT_LEVELS)}
SELECT p.id AS doc_id, p.h AS leaf, tops.h AS subroot, r.h AS root, sha256(c.sibs) AS proof_sha256, c.fold AS folded_root,
       c.fold = r.h AS verified
FROM placed p JOIN tops ON p.g = tops.lang JOIN top_climb_{_ROOT_LEVELS} c ON c.id = p.id, top_{_ROOT_LEVELS} r
"""
