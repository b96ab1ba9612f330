"""Near-duplicate documents: b-bit MinHash signatures joined by Hamming distance.

A document's set holds its distinct word shingles. Its signature is ``SYMBOLS``
MinHash symbols of 16 bits. Two documents are candidates if their signatures
differ in at most so many symbols as ``cut`` gives for the likeness asked for; it also gives the
chunks, of which such a pair has at most 1 error in some chunk (pigeonhole), so enumerating one
wildcard per chunk finds every one of them by equality. At likeness 0.85 the distance
has mean 14.4 of 96 and 16 chunks allow 31; a pair at the limit is beyond that less than once in ``1 / MISSED``
pairs, and less often if it is closer. Candidates are confirmed on the full sets of 64-bit shingle hashes.

Equal sets are one class, so exact copies never meet in a bucket. A bucket is first tested
as a star around the member that shares most keys with others: the text that near copies were made
from has the symbols most of them kept. Near pairs of the stars make clusters. A cluster that the
confirmed stars leave in several components is tested whole, its full sets block by block, and
only a forest of its links leaves a task. Near pairs of a bucket in different clusters are few;
they leave the join, which compares signatures, as pairs.

Defined results: null or wordless text has an empty set and is linked with nothing;
a text with fewer words than a shingle is one shingle; a document without an id is never
linked and is kept; rows that repeat an id are one document if their sets agree, else each is compared by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm import words as W
from tablegauge.session import durable

SYMBOLS = 96
# At most this share of the pairs at the limit of likeness is no candidate.
MISSED = 1e-5
SHINGLE, PERCENT = 3, 85
# Symbols are packed three to a long, in lanes of 16 bits.
LANES = 3
LONGS = SYMBOLS // LANES
_TOPS, _BELOW = 0x800080008000, 0x7FFF7FFF7FFF
# A cluster's sets are compared in blocks of about so many sets and bytes.
BLOCK_SETS, BLOCK_BYTES = 256, 8_000_000
# Documents in no candidate pair are left out by a bitmap of this many bits before their texts are shuffled.
BITS = 1 << 22
_ROWS = np.random.default_rng(11).integers(0, 2**64, size=SYMBOLS, dtype=np.uint64) | np.uint64(1)


def cut(percent: int) -> tuple[int, int, int]:
    """The chunks, their width and the signature distance they allow, for pairs of ``percent`` likeness or more.

    The chunks are the fewest whose distance, one error in each and one more in all but one, is exceeded by
    a share of ``MISSED`` at most. Below about 55 percent chunks hold one fixed symbol and buckets grow large.
    """
    differ = 1 - percent / 100
    chances = [math.comb(SYMBOLS, k) * differ**k * (1 - differ) ** (SYMBOLS - k) for k in range(SYMBOLS + 1)]
    chunks = next((c for c in range(1, SYMBOLS // 2 + 1) if sum(chances[2 * c :]) <= MISSED), None)
    if chunks is None:
        raise ValueError(f"{SYMBOLS} symbols cannot find pairs of {percent} percent likeness")
    return chunks, SYMBOLS // chunks, 2 * chunks - 1


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    data, at = W.buffers(texts)
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, at)
    h = W.hashes(data, starts, ends)
    row = W.factors(2 * size)[size:]
    sets = []
    sums = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size if len(sums) else 0):
        sums += h[k : len(sums) + k] * row[k]
    sums = W.mixed(sums)
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= size:
            sets.append(np.unique(sums[low : high - size + 1]))
        elif high > low:
            n = high - low
            sets.append(W.mixed(np.array([(h[low:high] * row[:n]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value under each of the hash functions."""
    low = np.full(len(_ROWS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 1024):
        low = np.minimum(low, (_ROWS[:, None] * shingles[None, k : k + 1024]).min(axis=1))
    return (low >> np.uint64(40)).astype(np.uint16)


def packed(symbols: np.ndarray) -> np.ndarray:
    """The symbols as longs, and back by ``unpacked``."""
    lanes = symbols.astype(np.int64).reshape(LONGS, LANES)
    return lanes[:, 0] | lanes[:, 1] << 16 | lanes[:, 2] << 32


def unpacked(longs: np.ndarray) -> np.ndarray:
    lanes = np.stack([longs >> 16 * k for k in range(LANES)], axis=-1) & 0xFFFF
    return lanes.reshape(-1, SYMBOLS).astype(np.uint64)


def distance(a: Column, b: Column) -> Column:
    """In how many symbols two packed signatures differ: a lane's top bit is set where any bit differs."""
    total = F.lit(0)
    for k in range(LONGS):
        x = a[k].bitwiseXOR(b[k])
        lanes = (x.bitwiseAND(F.lit(_BELOW)) + F.lit(_BELOW)).bitwiseOR(x).bitwiseAND(F.lit(_TOPS))
        total = total + F.bit_count(lanes)
    return total


def _digest(shingles: np.ndarray) -> bytes | None:
    """The identity of a set: 128 bits, null for the empty one."""
    if not len(shingles):
        return None
    return np.array([shingles.sum(), W.mixed(shingles ^ np.uint64(len(shingles))).sum()], np.uint64).tobytes()


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high in W.slices(texts):
            sets = shingle_sets(texts[low:high], size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[low:high],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([packed(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_id", "signature"],
            )


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document: set size, set identity, signature (both null for an empty set)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _signed(batches, size), "doc_id long, n_shingles long, set_id binary, signature array<long>"
    )


def _keyed(batches: Iterator[pa.RecordBatch], chunks: int, width: int) -> Iterator[pa.RecordBatch]:
    """One key per chunk and wildcard, of the chunk's other symbols."""
    weights = W.factors(4096)[2048 : 2048 + width]
    marks = W.mixed(np.arange(chunks * width, dtype=np.uint64)).reshape(chunks, width)
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            ids = part.column("node").to_numpy()
            symbols = unpacked(part.column("signature").flatten().to_numpy().reshape(-1, LONGS))[:, : chunks * width]
            terms = (symbols.reshape(-1, chunks, width) + np.uint64(1)) * weights
            keys = W.mixed(terms.sum(axis=2)[:, :, None] - terms + marks[None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, chunks * width))], ["key", "node"]
            )


def buckets(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, node, size): the keys that two or more nodes share, with how many do."""
    chunks, width, _ = cut(percent)
    keys = nodes.select("node", "signature").mapInArrow(lambda batches: _keyed(batches, chunks, width), "key long, node long")
    return keys.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")


def stars(shared: DataFrame) -> DataFrame:
    """The pairs (a, b) of each bucket's centre with its other members; a centre shares most keys with others."""
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    ordered = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    centred = shared.select("key", "node").join(weight, "node").select("node", F.first("node").over(ordered).alias("centre"))
    pairs = centred.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return pairs.distinct()


def near_pairs(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs whose signatures differ in at most ``most`` symbols."""
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").where(distance(F.col("sig_a"), F.col("sig_b")) <= most).select("a", "b")


def _possible(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(bits[batch.column("bit").to_numpy()]))


def possible(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Leave out most of the rows whose id is not wanted, by a bitmap of fixed size; none that is."""
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS)).cast("int")
    set_bits = wanted.select(bit.alias("bit")).distinct().toPandas()["bit"].to_numpy()  # BITS numbers at most
    bits = np.zeros(BITS, bool)
    bits[set_bits] = True
    kept = texts.where("id is not null").withColumn("bit", bit)
    return kept.mapInArrow(lambda batches: _possible(batches, bits), "id long, text string, bit int").drop("bit")


def _set_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high in W.slices(texts):
            sets = shingle_sets(texts[low:high], size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[low:high], pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["id", "set_id", "shingles"],
            )


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                keep.append(False)
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the classes in ``pairs``, from the rows that have their id and their set."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = durable(classes.select("node", "id", "set_id").join(nodes, "node", "left_semi"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    sets = (
        possible(texts, wanted)
        .join(wanted.select("id").distinct(), "id", "left_semi")
        .mapInArrow(lambda batches: _set_rows(batches, size), "id long, set_id binary, shingles binary")
        .join(wanted, ["id", "set_id"])
        .dropDuplicates(["node"])
        .select("node", "shingles")
    )
    return durable(sets)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(lambda batches: _linked(batches, percent), "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the links that join what earlier ones left apart."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            kept.append(k)
    return kept


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """A forest of the links between two blocks of one cluster, or inside one block."""
    nodes, blocks = table["node"].to_numpy(), table["block"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
    left = np.flatnonzero(blocks == table["low"][0].as_py())
    right = np.flatnonzero(blocks == table["high"][0].as_py())
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for low in range(0, len(vocabulary), 4096):
        some = slice(np.searchsorted(at, low), np.searchsorted(at, low + 4096))
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[some], at[some] - low] = 1
        both += has[left] @ has[right].T
    both = both.astype(np.int64)  # counts of up to 2^24 are exact in float32, a hundred times them are not
    union = sizes[left][:, None] + sizes[right][None] - both
    i, j = np.nonzero((100 * both >= percent * union) & (nodes[left][:, None] != nodes[right][None]))
    a, b = nodes[left[i]], nodes[right[j]]
    kept = _forest(a, b)
    return pa.table({"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def cluster_links(clusters: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside the clusters (node, cluster) whose nodes ``labels`` leave in several components."""
    placed = clusters.join(labels, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))
    sized = sets.select("node", "shingles", F.octet_length("shingles").alias("bytes"))
    totals = (
        placed.join(sized.drop("shingles"), "node")
        .groupBy("cluster")
        .agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        .where("first <> last")
        .select("cluster", F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    )
    open_nodes = placed.join(totals, "cluster").select(
        "node", "cluster", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (
        open_nodes.join(sized, "node")
        .select("node", "shingles", "cluster", "block", other)
        .select("node", "shingles", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    return dealt.groupBy("cluster", "low", "high").applyInArrow(lambda table: _block_links(table, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every linked node.

    Each round points every node at the smallest label near it and then at that label's own label, so a
    chain halves per round; the labels are stored after each.
    """
    both = durable(links.union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = durable(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other")
            .groupBy("node")
            .agg(F.min("c").alias("c"))
        )
        hooks = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "c").alias("component")
        )
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = durable(
            hooks.join(roots, "component", "left").select("node", "old", F.least("component", "root").alias("component"))
        )
        changed = not jumped.where(F.col("old") != F.col("component")).isEmpty()
        labels = jumped.select("node", "component")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest reachable doc_id), kept (doc_id is the component's)."""
    most = cut(percent)[2]
    rows = durable(signed(docs, size))
    classes = (
        rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    )
    # an id may stand for several sets: a class has a number of its own, stored once
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()))
    shared = durable(buckets(classes, percent))
    star = durable(stars(shared))
    tested = durable(near_pairs(star, classes, most))
    sets = sets_of(tested, classes, docs, size)
    links = durable(confirmed(tested, sets, percent))
    clusters = components(tested).withColumnRenamed("component", "cluster")
    links = durable(links.union(cluster_links(clusters, components(links), sets, percent)))
    placed = shared.join(clusters, "node", "left").select("key", "node", F.coalesce("cluster", "node").alias("cluster"))
    mixed_keys = (
        placed.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("key")
    )
    open_rows = durable(placed.join(mixed_keys, "key", "left_semi").join(classes.select("node", "signature", "n"), "node"))
    left = open_rows.select("key", F.col("node").alias("a"), F.col("cluster").alias("ca"), F.col("signature").alias("sig_a"), F.col("n").alias("na"))
    right = open_rows.select("key", F.col("node").alias("b"), F.col("cluster").alias("cb"), F.col("signature").alias("sig_b"), F.col("n").alias("nb"))
    apart = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    sizes = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    across = left.join(right, apart & sizes & (distance(F.col("sig_a"), F.col("sig_b")) <= most)).select("a", "b").distinct()
    more = durable(across.join(star, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links = durable(links.union(confirmed(more, sets_of(more, classes, docs, size), percent)))
    labels = components(links)
    placed = durable(classes.select("set_id", "id", "node").join(labels, "node", "left").select("set_id", "id", F.coalesce("component", "node").alias("label")))
    least = placed.groupBy("label").agg(F.min("id").alias("component"))
    named = placed.join(least, "label").select("set_id", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(named, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
