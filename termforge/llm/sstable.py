"""Sorted-string-table shards of token ids.

A shard file holds documents in ascending key order:

    blocks   each: entries, then the offsets of its restarts and their number (4 bytes each); compressed with zstd
    index    one entry per block: last key, offset, stored size
    bloom    bit array over the keys
    footer   fixed 64 bytes: magic, offsets and sizes of index and bloom, counts, id width

An entry is (shared prefix length, rest length, value length) as varints, the rest of the key, then the ids
as little-endian unsigned integers of the shard's id width (2 bytes where every id of the vocabulary fits, else 4).
A key is the big-endian doc_id with its sign bit flipped, so that bytes order as numbers do; a null doc_id has
the empty key and stands first. Every 16th entry is a restart: it shares no prefix. A lookup asks the Bloom filter, bisects
the sparse block index, reads one block and bisects its restarts.

Defined cases: null text counts as empty and still gets its end id; rows with the same doc_id are all kept, ordered by
the hash of their text, then by it; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gc
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.common import bounded_batches, pieces, shared_dir

MAGIC = b"TFSST\x00\x01\n"
FOOTER = struct.Struct("<8sQQQQQIIQ")
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
CACHE_WORDS = 1_200_000


# ---------------------------------------------------------------- keys and entries


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, n_bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [((a + i * b) & ((1 << 64) - 1)) % n_bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.prev, self.in_block, self.restarts = bytearray(), b"", 0, []
        self.index, self.keys, self.n_ids, self.n_docs = [], [], 0, 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.in_block % RESTART:
            while shared < min(len(key), len(self.prev)) and key[shared] == self.prev[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.prev, self.in_block = key, self.in_block + 1
        self.keys.append(key)
        self.n_ids += len(ids)
        self.n_docs += 1
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        at, self.at = self.at, self.at + len(data)
        return at

    def _flush(self) -> None:
        if self.in_block:
            n = len(self.restarts)
            data = self.zip.compress(bytes(self.block) + struct.pack(f"<{n + 1}I", *self.restarts, n))
            self.index.append((self.prev, self._put(data), len(data)))
            self.block, self.in_block, self.restarts = bytearray(), 0, []

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        n_bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys)) + 7 & ~7
        bits = np.zeros(n_bits, np.uint8)
        for k in self.keys:
            bits[_bloom_bits(k, n_bits)] = 1
        bloom = np.packbits(bits, bitorder="little").tobytes()
        at_index, at_bloom = self._put(index), self._put(bloom)
        self._put(FOOTER.pack(MAGIC, at_index, len(index), at_bloom, len(bloom), self.n_docs, len(self.index), self.width, self.n_ids))


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        magic, at_index, n_index, at_bloom, n_bloom, self.n_docs, self.n_blocks, self.width, self.n_ids = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(at_bloom)
        self.bloom = file.read(n_bloom)
        file.seek(at_index)
        raw, at, self.index = file.read(n_index), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QI", raw, at + n)))
            at += n + 12
        self.unzip = zstandard.ZstdDecompressor()

    def block(self, i: int, least: bytes = b"") -> Iterator[tuple[bytes, np.ndarray]]:
        """The entries of a block, from the last restart whose key is under ``least``."""
        _, at, n = self.index[i]
        self.file.seek(at)
        buf = self.unzip.decompress(self.file.read(n))
        (n,) = struct.unpack_from("<I", buf, len(buf) - 4)
        end = len(buf) - 4 * (n + 1)
        restarts = struct.unpack_from(f"<{n}I", buf, end)
        at, key = restarts[max(0, bisect.bisect_left(range(n), least, key=lambda k: self._restart_key(buf, restarts[k])) - 1)], b""
        while at < end:
            shared, at = _read_varint(buf, at)
            rest, at = _read_varint(buf, at)
            size, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            at += rest
            yield key, np.frombuffer(buf, "<u2" if self.width == 2 else "<u4", size // self.width, at)
            at += size

    @staticmethod
    def _restart_key(buf: bytes, at: int) -> bytes:
        _, at = _read_varint(buf, at)
        rest, at = _read_varint(buf, at)
        _, at = _read_varint(buf, at)
        return buf[at : at + rest]

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this doc_id; an empty list if there is none."""
        key, n_bits, out = key_of(doc_id), 8 * len(self.bloom), []
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, n_bits)):
            return out
        i = bisect.bisect_left(self.index, key, key=lambda e: e[0])
        while i < len(self.index):
            for k, ids in self.block(i, key):
                if k > key:
                    return out
                if k == key:
                    out.append(ids)
            i += 1
        return out


# ---------------------------------------------------------------- encoding


class Codes(dict):
    """A dense code for every distinct key, given at its first lookup; ``new`` gathers the keys."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


# How byte-level BPE cuts text into pieces, and the characters that stand for bytes in its vocabulary.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CLOSING = {".", ","}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Pieces(dict):
    """The ids of every distinct piece, found by the library's model at its first lookup."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: str) -> list[int]:
        ids = self[piece] = self.fresh(piece)
        return ids

    def fresh(self, piece: str) -> list[int]:
        """The ids of a piece that is not kept here."""
        plain = piece.isascii() and piece.isprintable()
        shown = piece.replace(" ", BYTE_CHARS[32]) if plain else piece.encode().decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in self.model.tokenize(shown)]


class WordwiseEncoder:
    """Byte-level BPE of the tokenizers library, with each distinct run between spaces encoded once.

    The pre-tokenizer of such a vocabulary never puts a non-space before a space into one piece, so a text may be
    cut before every single space that stands between two non-white characters; what the library makes of the
    runs one by one is what it makes of the text, and so for the pieces inside a run. Where white space meets white space nothing is cut. A tokenizer
    with any other pre-tokenizer, or with an added token that holds white space, gets whole texts.

    A batch is cut by Arrow, which also numbers its distinct runs, so Python meets each distinct run of a batch once.

    Runs are cached without the space in front of them; a text's first run, which has none, is encoded by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.n_vocab = self.lib.get_vocab_size(with_added_tokens=True)
        spec = self.lib.to_str()
        self.wordwise = '"pre_tokenizer":{"type":"ByteLevel","add_prefix_space":false' in spec and '"use_regex":true' in spec and '"normalizer":null' in spec and not any(c.isspace() for t in self.special for c in t)
        self._reset()

    def _reset(self) -> None:
        self.codes, self.pieces = Codes(), Pieces(self.lib.model)
        self.flat, self.off, self.odd = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _lib(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 20_000) for e in self.lib.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]

    def _run(self, run: str) -> list[int]:
        """The ids of one run: its pieces by the library's BPE model, each distinct piece once."""
        if any(t in run for t in self.special):
            return self.lib.encode(run, add_special_tokens=False).ids
        get, parts = self.pieces.__getitem__, PIECE.findall(run)
        return get(parts[0]) if len(parts) == 1 else [i for p in parts for i in get(p)]

    def _learn(self) -> None:
        """Encode the runs seen since the last call.

        Nothing made here is garbage, so Python's collector, which would walk over it again and again, is held meanwhile.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            self._encode_new()
        finally:
            if collects:
                gc.enable()

    def _encode_new(self) -> None:
        new, self.codes.new = self.codes.new, []
        get, fresh, ids, odd = self.pieces.__getitem__, self.pieces.fresh, [], []
        tokenize, space = self.lib.model.tokenize, BYTE_CHARS[32]
        for k, r in enumerate(new):
            if r.isalpha():  # one piece
                ids.append([t.id for t in tokenize(space + r)] if r.isascii() else fresh(" " + r))
            elif r[-1:] in CLOSING and r[:-1].isalpha():  # two
                ids.append(get(" " + r[:-1]) + get(r[-1]))
            else:
                ids.append(self._run(" " + r))
                if r == "" or r[0].isspace() or r[-1].isspace():
                    odd.append(k)  # next to such a run white space meets white space
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(sizes)])
        marks = np.zeros(len(new), bool)
        marks[odd] = True
        self.odd = np.concatenate([self.odd, marks])

    @staticmethod
    def _merged(parts: list[str]) -> list[str]:
        """``parts``, as cut at single spaces, joined again wherever white space meets white space."""
        out = [parts[0]]
        for p in parts[1:]:
            last = out[-1]
            if last == "" or last[-1].isspace() or p == "" or p[0].isspace():
                out[-1] = f"{last} {p}"
            else:
                out.append(p)
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string array without nulls."""
        if not self.wordwise:
            yield from (np.array(x, np.uint32) for x in self._lib(texts.to_pylist()))
            return
        if len(self.codes) > CACHE_WORDS:
            self._reset()
        get = self.codes.__getitem__
        parts = pc.split_pattern(texts, " ")
        bounds, flat = parts.offsets.to_numpy().astype(np.int64), parts.values
        runs = flat.dictionary_encode()
        words = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(get, words), np.int64, len(words))
        self._learn()
        codes = known[runs.indices.to_numpy()]
        heads = flat.take(pa.array(bounds[:-1])).to_pylist()
        odd = np.concatenate([[0], np.cumsum(self.odd[codes])])
        # a text's first run is encoded by itself, so it alone does not make white space meet white space
        again = [k for k, h in enumerate(heads) if h == "" or h[-1].isspace() or odd[bounds[k + 1]] > odd[bounds[k] + 1]]
        merged = {k: self._merged(flat.slice(bounds[k], bounds[k + 1] - bounds[k]).to_pylist()) for k in again}
        own = {k: np.fromiter(map(get, p[1:]), np.int64, len(p) - 1) for k, p in merged.items()}
        self._learn()
        first = self._lib([merged[k][0] if k in merged else h for k, h in enumerate(heads)])
        table = pa.ListArray.from_arrays(pa.array(self.off.astype(np.int32)), pa.array(self.flat))
        found = table.take(pa.array(codes))
        ids, at = found.values.to_numpy(), found.offsets.to_numpy()
        for k, head in enumerate(first):
            rest = table.take(pa.array(own[k])).values.to_numpy() if k in own else ids[at[bounds[k] + 1] : at[bounds[k + 1]]]
            yield np.concatenate([np.array(head, np.uint32), rest])


_encoders: dict[str, WordwiseEncoder] = {}


def encoder(path: str) -> WordwiseEncoder:
    if path not in _encoders:
        _encoders[path] = WordwiseEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- Spark


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one sorted shard per range of doc_id; one manifest row per shard.

    A task writes under a name of its own and then renames, so a repeated or speculative task leaves a whole shard.
    Ranges are taken over (doc_id, hash of the text): a doc_id with very many rows is dealt over several shards.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = shards or pieces(spark)

    def write(batches):
        from pyspark import TaskContext

        part, enc, w, fs, tmp, prev = TaskContext.get().partitionId(), encoder(tokenizer), None, None, None, b""
        first = None
        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                if w is None:
                    fs, root = pafs.FileSystem.from_uri(out_dir)
                    fs.create_dir(root, recursive=True)
                    tmp, final = f"{root}/.{part:06d}-{uuid.uuid4().hex}", f"{root}/{part:06d}.sst"
                    out = fs.open_output_stream(tmp)
                    w, first = Writer(out, 2 if max(enc.n_vocab - 1, end_id) < 1 << 16 else 4), d
                w.add(key_of(d), np.append(ids, np.uint32(end_id)))
                prev = d
        if w is not None:
            w.close()
            out.close()
            fs.move(tmp, final)
            yield pa.RecordBatch.from_pydict({"shard": [part], "path": [f"{out_dir}/{part:06d}.sst"], "first_id": [first], "last_id": [prev], "n_docs": [w.n_docs], "n_ids": [w.n_ids]}, manifest_schema)

    manifest_schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(write, "shard long, path string, first_id long, last_id long, n_docs long, n_ids long")


def read_shards(spark: SparkSession, manifest: list) -> DataFrame:
    """Every document of the shards, read from the files: doc_id, start, n_tokens, ids_crc32.

    ``manifest`` has one row per shard (never per document), in order; their id counts give each shard's start.
    """
    manifest = sorted(manifest, key=lambda r: r["shard"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    starts = [0, *accumulate(r["n_ids"] for r in manifest)]
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(r["path"], s) for r, s in zip(manifest, starts)], "path string, start long").repartitionByRange(len(manifest), "start")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, p = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(p) as f:
                    rows = []
                    for key, ids in Reader(f).scan():
                        rows.append((doc_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, schema)


def lookup(manifest: list, doc_id: int | None) -> list[np.ndarray]:
    """The token ids of every row of a document: only shards whose key range holds it are opened."""
    out = []
    for r in sorted(manifest, key=lambda r: r["shard"]):
        if key_of(r["first_id"]) <= key_of(doc_id) <= key_of(r["last_id"]):
            fs, p = pafs.FileSystem.from_uri(r["path"])
            with fs.open_input_file(p) as f:
                out += Reader(f).get(doc_id)
    return out


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode, write the shards and read them back."""
    spark = docs.sparkSession
    manifest = write_shards(docs, shared_dir(spark, "sstable"), tokenizer, end_id).collect()
    return read_shards(spark, manifest)
