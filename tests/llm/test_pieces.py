"""Segmentation against the public library on the same pieces and scores, and exact round trips."""

import math

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from tablegauge.llm import pieces

TEXTS = [
    "The reannd of anhe ntwh ingble", "  two  blanks   and\ttab\nline ", "Ção ñandú für größe", "emoji 😀😀 and 漢字かな",
    "x" * 3000, "a", "", "of%%% be### <s> </s> 12345", "Ciónmenteasque osbo raos bociónll ññ. " * 40,
]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public vocabulary as a unigram model with the scores we derive."""
    proto = pb.ModelProto()
    proto.ParseFromString(open(pieces.default_vocabulary(), "rb").read())
    for p, score in zip(proto.pieces, pieces.load().scores):
        p.score = float(score)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    path = tmp_path_factory.mktemp("v") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_equals_the_public_library(unigram):
    library = SentencePieceProcessor(model_file=unigram)
    v = pieces.load(unigram)
    ids, first = pieces.encode(v, TEXTS)
    for k, text in enumerate(TEXTS):
        assert ids[first[k] : first[k + 1]].tolist() == library.encode(text), text[:40]
    assert [b.decode() for b in pieces.decode(v, ids, first)] == TEXTS


def test_best_path_equals_brute_force():
    v = pieces.load()
    table = {p: float(s) for p, s, b in zip(v.pieces, v.scores, v.is_byte) if p and not b}
    for text in ("thereof", "la ciónque", "ñandú\n"):
        raw = (" " + text).encode()
        best = [0.0] + [-math.inf] * len(raw)
        for end in range(1, len(raw) + 1):
            for start in range(end):
                piece = raw[start:end]
                score = table.get(piece)
                if score is None and len(piece.decode("utf-8", "ignore")) == 1 and piece.decode("utf-8", "ignore").encode() == piece:
                    score = float(v.unknown)
                if score is not None:
                    best[end] = max(best[end], best[start] + score)
        ids, _ = pieces.encode(v, [text])
        got, i = 0.0, 0
        while i < len(ids):
            if v.is_byte[ids[i]]:
                width = len(next(c for c in text if c.encode()[0] == v.pieces[ids[i]][0]).encode())
                got, i = got + float(v.unknown), i + width
            else:
                got, i = got + float(v.scores[ids[i]]), i + 1
        assert got == pytest.approx(best[-1], abs=1e-3)


def test_trie_holds_exactly_its_keys():
    keys = {b"a": 1, b"ab": 2, b"b": 3, b"\xff\x00": 4, b"abc": 5}
    base, check, value = pieces.trie(keys)
    for key in [*keys, b"c", b"ac", b"\xff", b"abcd"]:
        node = 0
        for c in key:
            target = base[node] + c + 1
            if base[node] == 0 or check[target] != node:
                node = None
                break
            node = target
        assert (int(value[node]) if node is not None and value[node] < np.iinfo(np.int32).max else None) == keys.get(key)


def test_frames_nulls_and_markers(spark):
    rows = [(1, None), (2, ""), (3, "a▁b"), (None, "x"), (4, TEXTS[8] * 50), (4, "twice")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, ids int")
    got = pieces.encoded(docs).collect()
    by = {(r.doc_id, r.n_pieces > 0): r for r in got}
    assert by[1, False].ids is None and by[1, False].round_trip and by[2, False].ids == []
    assert by[3, True].round_trip and len(got) == 6 and all(r.round_trip for r in got)
    back = {r.text for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert back == {None, "", "a b", "x", TEXTS[8] * 50, "twice"}
    assert pieces.encoded(docs.limit(0)).count() == 0
