"""Digests, roots, proofs and checks against a plain tree, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablegauge.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root of ``nodes``, and per node its sibling segments as (left, right)."""
    segments, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place - place % 8
            segments[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], segments


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = climb([x[2] for x in groups[g]])
    root, above = climb([trees[g][0] for g in order])
    found = []
    for place, g in enumerate(order):
        for (_, _, leaf, row), below in zip(groups[g], trees[g][1]):
            segments = below + above[place]
            told = row[4]
            if told is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                told = told.translate(UPPER)
            node = leaf_of((*row[:4], told))
            for left, right in segments:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in segments))
            found.append((row[0], leaf, trees[g][0], root, proof, node, node == root))
    return sorted(found, key=repr)


def rows(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def made(sizes, seed=1):
    draw, found = random.Random(seed), []
    ids = list(range(sum(sizes.values())))
    draw.shuffle(ids)
    for lang, n in sizes.items():
        for _ in range(n):
            text = draw.choice(["All Upper Start", "all lower", "Émile Ü und A", None, "", "Zz" * 40])
            found.append((ids.pop(), draw.choice([None, "web", "bücher"]), lang, draw.choice([None, 0, 17]), text))
    return found


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 3}, {"en": 513, "de": 1, None: 64, "": 65, "é": 2, "zz": 512, "fr": 7, "es": 8, "pt": 5, "nl": 9}])
def test_equals_a_plain_tree(spark, sizes):
    data = made(sizes)
    docs = spark.createDataFrame(data, SCHEMA).withColumns({n: F.lit("x") for n in ("group", "pos", "item", "digest", "n", "block", "root", "proof", "altered")})
    got = rows(merkle.report(docs.repartition(6)))
    assert got == brute(data)
    if len(data) > 100:
        assert {r[6] for r in got} == {True, False}


def test_three_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    data = made({"en": 600, "de": 65, "fr": 1})
    assert rows(merkle.report(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_null_and_repeated_ids_and_rows(spark):
    data = [(None, None, None, None, None)] * 3 + [(5, "a", "en", 1, "Same")] * 20 + [(5, "a", "en", 1, "Other")] * 2
    data += [(None, "a", "en", 2, "No id")] * 2 + [(i, None, "en", None, "X" * 50_000) for i in range(9)]
    assert rows(merkle.report(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_empty_table(spark):
    assert merkle.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_proof_holds_for_its_leaf_alone(spark):
    data = made({"en": 30, "de": 20})
    kept = merkle.manifest(spark.createDataFrame(data, SCHEMA), columns=["doc_id", "text"], group="source").collect()
    assert len({r.root for r in kept}) == 1 and len({r.subroot for r in kept}) == 3
    for r in kept:
        for leaf, holds in ((r.leaf, True), (sha("other"), False)):
            for left, right in r.proof:
                leaf = sha(bytes(left).decode() + leaf + bytes(right).decode())
            assert (leaf == r.root) is holds
        assert r.altered is None
