"""Unigram encoding and decoding with a SentencePiece vocabulary.

The best segmentation of a text is the path of highest total log score through all pieces that
match it (Viterbi). Pieces are found by walking a double-array trie from every character at
once; a character no piece covers costs the lowest score less ``PENALTY`` and falls back to byte
pieces. A blank is the whitespace marker, and one is put before the text.

No piece has a marker after another character, so a text falls apart before each run of markers
and the best path is the join of its chunks' best paths. Each distinct chunk of a slice of texts
is segmented once, all chunks side by side. Decoding joins the pieces' bytes, turns markers into blanks
and drops the first; it gives back every text but for literal markers (U+2581), which become blanks.

The vocabulary is a file given by path. A unigram model's stored scores are log scores; a merge model
stores minus the rank of a piece, which becomes the log probability of Zipf's law at that rank.

Defined results: null text gives null ids, an empty text none.
"""

from __future__ import annotations

import importlib.util
import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm import words as W

PENALTY = 10.0
MARKER = "▁"
_NONE = np.iinfo(np.int32).max


def default_vocabulary() -> str:
    """The public vocabulary with byte fallback among the installed tokenizer files."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec else Path("/opt/tokenizers")
    return str(folder / "piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with markers as blanks, log scores, byte pieces, and the trie over ordinary pieces."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray
    byte_ids: np.ndarray
    is_byte: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @property
    def unknown(self) -> np.float32:
        return np.float32(self.scores[self.value[self.value < _NONE]].min() - np.float32(PENALTY))


def trie(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array over ``keys``: the child of node ``s`` by byte ``c`` is ``t = base[s] + c + 1`` if ``check[t] == s``."""
    root: dict = {}
    for key, n in keys.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = n
    base, check, value = [0], [0], [_NONE]
    tried: dict[int, int] = {}  # by number of children: where the last free place was found
    queue = [(0, root)]
    for at, node in queue:
        codes = sorted(c + 1 for c in node if c >= 0)
        if -1 in node:
            value[at] = node[-1]
        if not codes:
            continue
        start = tried.get(len(codes), 1)
        while True:
            short = start + codes[-1] + 1 - len(check)
            if short > 0:
                base += [0] * short
                check += [-1] * short
                value += [_NONE] * short
            if all(check[start + c] < 0 for c in codes):
                break
            start += 1
        tried[len(codes)] = start
        base[at] = start
        for c in codes:
            check[start + c] = at
            queue.append((start + c, node[c - 1]))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def load(path: str | None = None) -> Vocabulary:
    """Read a vocabulary file."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = path or default_vocabulary()
    proto = pb.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    del sentencepiece
    kinds = proto.SentencePiece
    ranked = proto.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM
    harmonic = math.log(sum(1 / (k + 1) for k in range(len(proto.pieces))))
    pieces, scores, keys = [], [], {}
    byte_ids = np.full(256, -1, np.int32)
    for n, p in enumerate(proto.pieces):
        score = -math.log(1 - min(p.score, 0.0)) - harmonic if ranked else p.score
        scores.append(score)
        if p.type == kinds.BYTE:
            byte = int(p.piece[3:5], 16)
            byte_ids[byte] = n
            pieces.append(bytes([byte]))
        elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
            pieces.append(p.piece.replace(MARKER, " ").encode())
            keys[pieces[-1]] = n
        else:
            pieces.append(b"")
    for key in keys:
        if b" " in key.lstrip(b" "):
            raise ValueError("a piece has a marker after another character")
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces")
    is_byte = np.zeros(len(pieces), bool)
    is_byte[byte_ids] = True
    return Vocabulary(tuple(pieces), np.array(scores, np.float32), byte_ids, is_byte, *trie(keys))


def _matches(v: Vocabulary, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every piece at every character; ``stop`` is the end of each byte's chunk."""
    starts = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
    width = np.ones(len(starts), np.int32)
    lead = data[starts]
    width += (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
    single = np.zeros(len(starts), bool)
    found = []
    live = np.arange(len(starts), dtype=np.int32)
    node = np.zeros(len(starts), np.int32)
    depth = 0
    while len(live):
        at = starts[live] + depth
        inside = at < stop[starts[live]]
        live, node, at = live[inside], node[inside], at[inside]
        target = v.base[node] + data[at] + 1
        ok = (v.base[node] > 0) & (v.check[np.minimum(target, len(v.check) - 1)] == node)
        live, node = live[ok], target[ok]
        depth += 1
        ends = v.value[node] < _NONE
        hit = live[ends]
        found.append((starts[hit], starts[hit] + depth, v.value[node[ends]]))
        single[hit[width[hit] == depth]] = True
    alone = ~single
    found.append((starts[alone], np.minimum(starts[alone] + width[alone], stop[starts[alone]]), np.full(alone.sum(), -1, np.int32)))
    return tuple(np.concatenate(c).astype(np.int32) for c in zip(*found))


def _segmented(v: Vocabulary, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks (``at`` parts them) one after the other, and where each chunk's ids begin."""
    n = len(at) - 1
    lengths = np.diff(at)
    chunk = np.repeat(np.arange(n, dtype=np.int32), lengths)
    start, end, piece = _matches(v, data, np.repeat(at[1:], lengths))
    own = chunk[start]
    offset = start - at[own]
    order = np.argsort(offset, kind="stable")
    start, end, piece, own, offset = start[order], end[order], piece[order], own[order], offset[order]
    # a chunk of L bytes has L + 1 boundaries, so boundaries of chunk k are shifted by k
    low, high = start + own, end + own
    score = np.where(piece >= 0, v.scores[piece], v.unknown).astype(np.float32)
    best = np.full(len(data) + n, -np.inf, np.float32)
    best[at[:-1] + np.arange(n)] = 0
    back = np.zeros(len(best), np.int32)
    steps = np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1]))) if len(offset) else np.zeros(0, np.int64)
    for a, b in zip(steps, [*steps[1:], len(offset)]):
        to = high[a:b]
        value = best[low[a:b]] + score[a:b]
        better = value > best[to]
        to = to[better]
        best[to] = value[better]
        back[to] = np.flatnonzero(better) + a
    taken = np.zeros(len(best), bool)
    place = at[1:] + np.arange(n)
    begin = at[:-1] + np.arange(n)
    while True:
        more = place > begin
        if not more.any():
            break
        place, begin = place[more], begin[more]
        taken[place] = True
        place = low[back[place]]
    bounds = np.flatnonzero(taken)
    match = back[bounds]
    ids, count = piece[match], np.ones(len(match), np.int64)
    unknown = ids < 0
    count[unknown] = (end[match] - start[match])[unknown]
    where = np.repeat(np.arange(len(ids)), count)
    step = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
    out = np.where(unknown[where], v.byte_ids[data[start[match][where] + step]], ids[where]).astype(np.int32)
    per_chunk = np.bincount(own[match], count, minlength=n).astype(np.int64)
    return out, np.concatenate(([0], np.cumsum(per_chunk)))


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs given by start and size, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def encode(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's ids begin."""
    raw = [b" " + t.encode().replace(MARKER.encode(), b" ") if t else b"" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    blank = data == 32
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    opens[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(data))
    never = np.zeros(256, bool)
    _, sample, which = np.unique(W.hashes(data, starts, ends, never), return_index=True, return_inverse=True)
    sizes = (ends - starts)[sample]
    chunks = data[_runs(starts[sample], sizes)]
    ids, first = _segmented(v, chunks, np.concatenate(([0], np.cumsum(sizes))))
    counts = np.diff(first)[which]
    out = ids[_runs(first[:-1][which], counts)]
    total = np.concatenate(([0], np.cumsum(counts)))
    return out, total[np.searchsorted(starts, at)]


def decode(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The bytes of each text, without the leading blank."""
    table = np.frombuffer(b"".join(v.pieces), np.uint8)
    sizes = np.array([len(p) for p in v.pieces], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = table[_runs(begin[ids], sizes[ids])].tobytes()
    ends = np.concatenate(([0], np.cumsum(sizes[ids])))[first]
    return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:])]


def _encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in W.slices(batch.column("text")):
            part = batch.slice(low, high - low)
            texts = part.column("text").to_pylist()
            ids, first = encode(v, texts)
            byte_count = np.concatenate(([0], np.cumsum(v.is_byte[ids])))[first]
            back = decode(v, ids, first)
            same = [t is None or (t.replace(MARKER, " ") if MARKER in t else t).encode() == b for t, b in zip(texts, back)]
            missing = np.array([t is None for t in texts], dtype=bool)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.append(missing, False)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(byte_count)), pa.array(same), lists],
                ["doc_id", "n_pieces", "n_bytes", "round_trip", "ids"],
            )


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), round_trip (decoding gives the text back), ids of every text."""
    v = load() if vocabulary is None else vocabulary
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        lambda batches: _encoded(batches, v), f"doc_id {kind}, n_pieces long, n_bytes long, round_trip boolean, ids array<int>"
    )


def _decoded(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        filled = lists.fill_null([]) if lists.null_count else lists
        first = np.concatenate(([0], np.cumsum(filled.value_lengths().to_numpy()))).astype(np.int64)
        texts = decode(v, filled.flatten().to_numpy(zero_copy_only=False), first)
        out = [None if null else t.decode("utf-8", "replace") for t, null in zip(texts, lists.is_null().to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def decoded(encodings: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id and the text of the ``ids``."""
    v = load() if vocabulary is None else vocabulary
    kind = encodings.schema["doc_id"].dataType.simpleString()
    return encodings.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, v), f"doc_id {kind}, text string")
