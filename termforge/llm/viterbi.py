"""SentencePiece encoding and decoding: the best piece sequence by batched numpy Viterbi.

Pieces and scores come from a SentencePiece model file; the best segmentation is the one of largest summed score, in
double precision (on ties the one whose last pieces are longest, as a scan of starts from left to right would find).
Text becomes pieces as the model file says: a dummy space in front, spaces as U+2581, no other normalisation; a
character without a piece scores 10 below the lowest piece and becomes its UTF-8 byte pieces.

No piece holds U+2581 after another character, so a word - a run of U+2581 with what follows up to the next such run -
is segmented on its own. Each distinct word is solved once: words of equal length advance together, the polynomial
hashes of their substrings probe the sorted piece hashes, and vectorised maxima store the backpointers.

Defined cases: null text counts as empty and gives no ids; repeated rows are all kept; an empty table gives no rows;
other columns pass by. Decoding gives the text back, but for U+2581 itself, which reads as a space.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.common import bounded_batches

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE, NORMAL, USER = 6, 1, 4
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000
CELLS = 1 << 19


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with identity normalisation, a dummy prefix and byte fallback are handled")
        self.pieces = [p.piece for p in proto.pieces]
        plain = [(p.piece, p.score, i) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)]
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in plain):
            raise ValueError("a piece crosses a word boundary")
        self.bytes_id = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes_id[int(p.piece[1:-1], 16)] = i
        self.unknown = min(s for _, s, _ in plain) - UNKNOWN_PENALTY
        self.by_length = {}
        for n in sorted({len(p) for p, _, _ in plain}):
            own = [(p, s, i) for p, s, i in plain if len(p) == n]
            h = _hash(np.array([[ord(c) for c in p] for p, _, _ in own], np.uint64))[:, -1]
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces share a hash")
            self.by_length[n] = (h[order], np.array([own[k][1] for k in order], float), np.array([own[k][2] for k in order], np.int64))
        kinds = {i: p.type for i, p in enumerate(proto.pieces)}
        self.decoded = [bytes([int(p[1:-1], 16)]) if kinds[i] == BYTE else b"" if kinds[i] in (2, 3) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def solve(self, words: list[str]) -> list[np.ndarray]:
        """The piece ids of each word (any strings; each is segmented as a whole)."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for n, group in groupby(order, key=lambda i: len(words[i])):
            group = list(group)
            if not n:
                for i in group:
                    out[i] = np.zeros(0, np.int32)
                continue
            step = max(1, CELLS // n)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                for i, ids in zip(part, self._solve_equal([words[i] for i in part], n)):
                    out[i] = ids
        return out

    def _solve_equal(self, words: list[str], n: int) -> list[np.ndarray]:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        h = _hash(chars.astype(np.uint64))
        rows = len(words)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((rows, n + 1), np.int32)
        piece = np.full((rows, n + 1), -1, np.int64)
        for end in range(1, n + 1):
            top = best[:, end - 1] + self.unknown
            chosen, length = np.full(rows, -1, np.int64), np.ones(rows, np.int32)
            single = np.zeros(rows, bool)
            for size in sorted((s for s in self.by_length if s <= end), reverse=True):
                keys, scores, ids = self.by_length[size]
                sub = h[:, end] - h[:, end - size] * _power(size)
                at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
                hit = keys[at] == sub
                value = best[:, end - size] + scores[at]
                if size == 1:
                    single = hit
                better = hit & ((value > top) | (chosen < 0))
                top = np.where(better, value, top)
                chosen = np.where(better, ids[at], chosen)
                length = np.where(better, size, length)
            # a character without a piece of its own may be unknown; one with a piece never is
            lone = best[:, end - 1] + self.unknown
            take = ~single & (lone > top)
            best[:, end], back[:, end], piece[:, end] = np.where(take, lone, top), np.where(take, 1, length), np.where(take, -1, chosen)
        out, at = [], np.full(rows, n)
        path, live = [], np.ones(rows, bool)
        r = np.arange(rows)
        while live.any():
            path.append((np.where(live, piece[r, at], -2), at.copy()))
            at = np.where(live, at - back[r, at], at)
            live = at > 0
        for i in range(rows):
            ids = []
            for p, end in reversed(path):
                if p[i] >= 0:
                    ids.append(p[i])
                elif p[i] == -1:
                    ids.extend(self.bytes_id[list(chr(chars[i, end[i] - 1]).encode("utf-8", "surrogatepass"))])
            out.append(np.array(ids, np.int32))
        return out

    word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.code) > CACHE_WORDS:
            self._reset()
        words = [self._words(t) if t else [] for t in texts]
        new = list({w for x in words for w in x}.difference(self.code))
        solved = self.solve(new)
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        self.flat = np.concatenate([self.flat, *solved])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum([len(s) for s in solved], dtype=np.int64)])
        get, out = self.code.__getitem__, []
        for x in words:
            c = np.fromiter(map(get, x), np.int64, len(x))
            n = self.off[c + 1] - self.off[c]
            out.append(self.flat[np.repeat(self.off[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out

    def _words(self, text: str) -> list[str]:
        """Runs of U+2581 with what follows."""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return self.word.findall(SPACE + text.replace(" ", SPACE))
        return [SPACE + w for w in text.split(" ")]

    def decode(self, ids) -> str:
        text = b"".join([self.decoded[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_powers = [np.uint64(1)]


def _power(n: int) -> np.uint64:
    with np.errstate(over="ignore"):
        while len(_powers) <= n:
            _powers.append(_powers[-1] * BASE)
    return _powers[n]


def _hash(chars: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row; column k is the hash of its first k characters."""
    h = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(chars.shape[1]):
            h[:, k + 1] = h[:, k] * BASE + chars[:, k] + np.uint64(1)
    return h


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with ``piece_ids``; with ``check`` also ``round_trip``, whether decoding gives the text back.

    The input's own columns of these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("piece_ids", "round_trip")]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index(text)

    def run(batches):
        m = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = m.encode(texts)
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                more = [pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))]
                if check:
                    more.append(pa.array([m.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*own, "piece_ids", *["round_trip"] * check])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, "piece_ids array<int>", *["round_trip boolean"] * check]))


def decode(encoded: DataFrame, path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (null ids: null) in column ``out``, replaced if there."""
    bounded_batches(encoded.sparkSession)
    encoded = encoded.drop(out)
    at, own = encoded.columns.index(ids), encoded.columns

    def run(batches):
        m = model(path)
        for batch in batches:
            texts = pa.array([None if x is None else m.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*own, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(run, ", ".join([*fields, f"`{out}` string"]))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_pieces, the CRC-32 of the ids as little-endian 32-bit integers, round_trip."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        m = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                texts = [t or "" for t in batch.column(1).slice(lo, 500).to_pylist()]
                ids = m.encode(texts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(lo, 500), "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "round_trip": pa.array([m.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, texts)], pa.bool_()),
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
