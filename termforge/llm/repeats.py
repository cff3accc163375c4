"""Repeated passages: maximal repeat groups of 200 bytes and more, by a common-prefix interval tree over a suffix array.

Every 200-byte stretch holds a core: a position chosen by its content (see ``winnow``) from which 116 bytes stay inside
the stretch. Equal stretches hold equal cores at equal places, so stretches can only repeat inside groups of equal cores.

1. Cores are counted by hash. A bitmap of bounded size of the hashes that occur again goes to the executors.
2. Texts are read again; cores that the bitmap knows are kept with a hash of their context, the 84 bytes before and the
   84 after the core, which hold every stretch around it. Equal contexts of different places repeat as a whole and
   meet as counts; of each distinct context one place is picked.
3. The distinct contexts are suffixes that start at a core: sorted by (core, right side), with longest common prefixes, they
   are an enhanced suffix array, sparse in that it has one suffix for each context. A stack scan gives the intervals of its
   common-prefix tree: the contexts that share ``behind`` bytes behind the core and then differ.
4. The members of an interval that also share the 84 - ``behind`` bytes before the core have a stretch in common. They are
   sorted by their left extensions and scanned in the same way, where the interval was found: each interval of left extensions is diverse on its left and
   shares ``before`` bytes; one that is diverse on its right too is a maximal repeat of before + 116 + behind bytes, put
   out with all its occurrences.
5. How far the groups of a context reach is joined back to all places, merged per document, and cut.

No task holds more of a core or interval than an even share, nor more than one interval or ``PART`` members of intervals at once. What has more contexts is dealt out by sampled cut points of
the sort order, so that a chunk is a stretch of the suffix array. Chunks tell their ends and the depths of the intervals
that touch them - two strings and at most 168 numbers each; from these the intervals that go over chunk borders are found,
and then every chunk knows which of them its members belong to. Groups are named by their content, so members from different chunks meet.

Contexts end 84 bytes from the core, so a longer repeat is a chain of overlapping groups, one around each of its cores.

Defined cases: null text counts as empty; a text shorter than the length has no repeats; rows with equal doc_id or equal
text are separate places; an empty table gives no rows; other columns pass by. Cutting may part a multi-byte character;
``kept`` is bytes. Stretches are judged on the input, overlaps count, and matches never cross documents.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.common import Scratch, bitmap_of, bounded_batches, in_bitmap, pieces
from termforge.llm.winnow import anchors

LENGTH = 200
GRAM = 32
REACH = (LENGTH - GRAM) // 2  # 84: a stretch starts at most so far before its core
CORE = LENGTH - REACH  # 116
SHARE = 1024  # a core or interval of fewer members is never dealt out
PART = 100_000  # memberships in memory: a member may be in an interval for each of REACH depths
SAMPLES = 8  # sampled members for each chunk of a dealt one
_POWERS = np.random.default_rng(20240302).integers(0, 1 << 64, REACH, np.uint64) | np.uint64(1)


# ---------------------------------------------------------------- the interval tree


def prefix_intervals(lcp: list[int]):
    """The intervals (value, first, last) of the common-prefix tree, by a stack scan.

    lcp[k] is what row k has in common with row k - 1, or -1 where a new tree begins; lcp[0] is unused.
    """
    stack: list[tuple[int, int]] = []
    for k in range(1, len(lcp) + 1):
        value, first = (lcp[k] if k < len(lcp) else -1), k - 1
        while stack and stack[-1][0] > value:
            v, first = stack.pop()
            yield v, first, k - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """A column of binaries as rows of bytes, filled up with zeros, and their lengths."""
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    size = np.diff(off)
    out = np.zeros((n, max(1, int(size.max()))), np.uint8)
    if off[-1] > off[0]:
        data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
        out[np.repeat(np.arange(n), size), np.arange(len(data)) - np.repeat(off[:-1] - off[0], size)] = data
    return out, size


def common(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of ``x`` with the row before; -1 for the first."""
    same = x[1:] == x[:-1]
    n = np.where(same.all(1), x.shape[1], same.argmin(1))
    return np.concatenate([[-1], np.minimum(n, np.minimum(size[1:], size[:-1]))])


def shared_length(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def borders(chunks) -> dict:
    """(group, chunk) to (left, right, left depths, right depths) for the chunks of dealt groups.

    ``chunks``: rows g, chunk, first, last, lefts, rights - the end strings and the depths of the intervals inside a chunk
    that touch its ends. left and right are the common prefixes with the chunks beside it (-1 at the ends of a group); the depths
    are those of all intervals that go over that border.
    """
    out = {}
    for g, rows in groupby(sorted(chunks, key=lambda r: (bytes(r["g"]), r["chunk"])), key=lambda r: bytes(r["g"])):
        rows = list(rows)
        ends = [(bytes(r["first"]), bytes(r["last"])) for r in rows]
        gap = [-1, *(shared_length(a[1], b[0]) for a, b in zip(ends, ends[1:])), -1]
        nodes = set()
        for i, r in enumerate(rows):
            nodes.update(ends[i][0][:v] for v in (*r["lefts"], gap[i]) if 0 <= v <= gap[i])
            nodes.update(ends[i][1][:v] for v in (*r["rights"], gap[i + 1]) if 0 <= v <= gap[i + 1])
        for i, r in enumerate(rows):
            over = [[d for d in range(gap[i + k] + 1) if ends[i][k][:d] in nodes] for k in (0, 1)]
            out[g, r["chunk"]] = (gap[i], gap[i + 1], *over)
    return out


def _parts(t: pa.Table) -> np.ndarray:
    """Where the (g, chunk) groups of sorted rows begin."""
    g, _ = matrix(t.column("g").chunk(0))
    chunk = t.column("chunk").to_numpy()
    return np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]).any(1) | (chunk[1:] != chunk[:-1])]))


def whole_groups(batches, least: int = 8192):
    """Tables of whole (g, chunk) groups and where these begin, from batches of sorted rows."""
    held, n, enough = [], 0, least
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= enough:
            t = pa.Table.from_batches(held).combine_chunks()
            at = _parts(t)
            if at[-1]:
                yield t.slice(0, at[-1]).combine_chunks(), at[:-1]
                held, n = t.slice(at[-1]).to_batches(), n - int(at[-1])
            enough = max(least, 2 * n)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _parts(t)


def tree_parts(lcp: np.ndarray, at: np.ndarray, over: list | None = None):
    """(row, depth, interval) for each row and each interval of its group's prefix tree that it is in, some whole intervals at a time.

    ``at``: where groups begin, and lcp is -1. Intervals that lie inside are numbered, from 0 in each part. ``over`` has the borders of each group (see
    ``borders``) if groups are chunks of dealt ones; intervals that go over them have no number (-1), and their other members are elsewhere.
    """
    found = np.array(list(prefix_intervals(lcp.tolist())), np.int64).reshape(-1, 3)
    if over:
        ends = np.append(at[1:], len(lcp))
        part = np.searchsorted(at, found[:, 1], "right") - 1
        held, n = [], 0
        for lo, hi, (_, _, lefts, rights) in zip(at.tolist(), ends.tolist(), over):
            head = np.minimum.accumulate(np.concatenate([[REACH], lcp[lo + 1 : hi]]))
            tail = np.minimum.accumulate(np.concatenate([[REACH], lcp[lo + 1 : hi][::-1]]))[::-1]
            for d in sorted({*lefts, *rights}):
                own = lo + np.flatnonzero(((head >= d) if d in lefts else False) | ((tail >= d) if d in rights else False) | (head[-1] >= d))
                held.append((own, np.full(len(own), d), np.full(len(own), -1)))
                n += len(own)
                if n >= PART:
                    yield tuple(np.concatenate(c).astype(np.int64) for c in zip(*held))
                    held, n = [], 0
        if held:
            yield tuple(np.concatenate(c).astype(np.int64) for c in zip(*held))
        left, right = np.array([o[0] for o in over]), np.array([o[1] for o in over])
        out = ((found[:, 1] == at[part]) & (found[:, 0] <= left[part])) | ((found[:, 2] == ends[part] - 1) & (found[:, 0] <= right[part]))
        found = found[~out]
    size = found[:, 2] - found[:, 1] + 1
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // PART)) + 1
    for first, n in zip(np.split(found, cuts), np.split(size, cuts)):
        rows = np.repeat(first[:, 1] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield rows.astype(np.int64), np.repeat(first[:, 0], n), np.repeat(np.arange(len(n)), n)


def _strings(t: pa.Table, at: np.ndarray, edges: dict | None) -> tuple:
    """What ``tree_parts`` takes for the strings ``s`` of sorted rows, whose groups begin at ``at``; ``edges``: the borders of dealt groups."""
    lcp = common(*matrix(t.column("s").chunk(0)))
    lcp[at] = -1
    g, chunk = t.column("g"), t.column("chunk")
    return lcp, at, edges and [edges[g[i].as_py(), chunk[i].as_py()] for i in at.tolist()]


def memberships(t: pa.Table, at: np.ndarray, edges: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``tree_parts`` of ``_strings`` in one, numbered through."""
    parts, base = [], 0
    for row, depth, number in tree_parts(*_strings(t, at, edges)):
        parts.append((row, depth, np.where(number < 0, -1, number + base)))
        base += number.max(initial=-1) + 1
    return tuple(np.concatenate(c) for c in zip(*parts))


def both_sides_diverse(number: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Which rows are in intervals that go on with different bytes ``nxt`` (-1: with none), or in intervals without a number."""
    inside = np.flatnonzero(number >= 0)
    low, high = np.full(number.max(initial=-1) + 1, 256), np.full(number.max(initial=-1) + 1, -2)
    np.minimum.at(low, number[inside], nxt[inside])
    np.maximum.at(high, number[inside], nxt[inside])
    keep = np.ones(len(number), bool)
    keep[inside] = ((low != high) | (low < 0))[number[inside]]
    return keep


# ---------------------------------------------------------------- Spark


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def cores(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the text's cores."""
    b = np.frombuffer(text, np.uint8)
    at, _ = anchors(b, LENGTH, GRAM)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    at = np.unique(np.concatenate([at, at - REACH]))
    at = at[(at >= 0) & (at + CORE <= len(b))]
    digest = xxhash.xxh3_64_intdigest
    return at, np.fromiter((digest(text[s : s + CORE]) for s in at.tolist()), np.uint64, len(at))


def _core_counts(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            found = [cores(_bytes(t))[1] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["h"])


def _context(text: bytes, s: int) -> tuple[bytes, int]:
    lo = max(0, s - REACH)
    return text[lo : s + LENGTH], s - lo


_PLACES = "uid long, doc_id long, n_bytes long, sha string, text binary, cores array<struct<at:int,key:bigint,ctx:bigint>>"


def _places(shared):
    kind = pa.list_(pa.struct([("at", pa.int32()), ("key", pa.int64()), ("ctx", pa.int64())]))

    def run(batches):
        bitmap, digest = shared.value, xxhash.xxh3_64_intdigest
        with np.errstate(over="ignore"):
            for batch in batches:
                n, sha, texts, found = [], [], [], []
                for t in batch.column(2).to_pylist():
                    t = _bytes(t)
                    at, h = cores(t)
                    use = in_bitmap(bitmap, h)
                    rows = []
                    for s, k in zip(at[use].tolist(), h[use].view(np.int64).tolist()):
                        c, left = _context(t, s)
                        rows.append({"at": s, "key": k, "ctx": digest(c, left) - (1 << 63)})
                    n.append(len(t))
                    sha.append(None if rows else hashlib.sha256(t).hexdigest())
                    texts.append(t if rows else None)
                    found.append(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.binary()), pa.array(found, kind)], names=["uid", "doc_id", "n_bytes", "sha", "text", "cores"])

    return run


_SUFFIX = "g binary, id long, s binary, back binary"
_NODE = "g binary, id long, s binary, key long, before int, behind int, next int, repeat binary"
_MEMBER = "key long, ctx long, before int, behind int, next int, repeat binary"


def _emitted(shared):
    """The picked contexts as suffixes: g (the core's hash), id (the context), s (what is behind the core), back (what is before it, backwards)."""

    def run(batches):
        picked = shared.value
        for batch in batches:
            rows: list = []
            at, k, c, ids = (batch.column(i).to_pylist() for i in range(1, 5))
            for i, t in enumerate(batch.column(0)):
                if not ids[i]:
                    continue
                use = np.flatnonzero(in_bitmap(picked, np.array(ids[i], np.int64).view(np.uint64))).tolist()
                text = t.as_py() if use else None
                for u in use:
                    raw, left = _context(text, at[i][u])
                    rows.append((struct.pack(">q", k[i][u]), c[i][u], raw[left + CORE :], raw[:left][::-1]))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["g", "id", "s", "back"])

    return run


def _classes(t: pa.Table, at: np.ndarray, edges: dict | None, back: np.ndarray, size: np.ndarray):
    """(row, behind, next, number, start), part by part: members of intervals of right extensions that share the rest of a stretch on the left.

    Members are sorted by interval (-1: goes over a border) and by that left side, ``back`` (of lengths ``size``); ``start``: where a class begins. A class inside a chunk
    that goes on with one byte on the right, so that what it shares is a part of a longer repeat, is left out, and so are single members.
    """
    x, length = matrix(t.column("s").chunk(0))
    rank = np.empty(len(back), np.int64)
    rank[np.argsort(np.ascontiguousarray(back).view(np.dtype((np.void, back.shape[1]))).ravel(), kind="stable")] = np.arange(len(back))
    for row, behind, number in tree_parts(*_strings(t, at, edges)):
        keep = size[row] >= REACH - behind
        row, behind, number = row[keep], behind[keep], number[keep]
        if not len(row):
            continue
        h = np.zeros(len(row), np.uint64)
        for d in np.unique(behind).tolist():
            for lo in range(0, len(of := np.flatnonzero(behind == d)), 20_000):
                own = of[lo : lo + 20_000]
                h[own] = (back[row[own], : REACH - d].astype(np.uint64) + np.uint64(1)) @ _POWERS[: REACH - d]
        nxt, inside = np.full(len(row), -1), behind < length[row]
        nxt[inside] = x[row[inside], behind[inside]]
        order = np.lexsort((rank[row], h, number))
        row, behind, nxt, number, h = (v[order] for v in (row, behind, nxt, number, h))
        new = np.concatenate([[True], (number[1:] != number[:-1]) | (h[1:] != h[:-1])])
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(row)))
        low, high = np.minimum.reduceat(nxt, start), np.maximum.reduceat(nxt, start)
        keep = np.repeat((n > 1) & ((low != high) | (low < 0)), n) | (number < 0)
        row, behind, nxt, number, new = (v[keep] for v in (row, behind, nxt, number, new))
        yield row, behind, nxt, number, np.flatnonzero(new)


def _maximal(back: np.ndarray, size: np.ndarray, row: np.ndarray, behind: np.ndarray, nxt: np.ndarray, start: np.ndarray):
    """(row, before, behind, next), part by part, of each member of each maximal repeat of classes that lie in one chunk, by a stack scan of their left extensions."""
    lcp = np.full(len(row), -1, np.int64)
    for lo in range(1, len(row), 20_000):
        hi = min(len(row), lo + 20_000)
        lcp[lo:hi] = common(back[row[lo - 1 : hi]], size[row[lo - 1 : hi]])[1:]
    lcp[start] = -1
    for at, before, number in tree_parts(lcp, start):
        keep = (before + behind[at] >= REACH) & both_sides_diverse(number, nxt[at])
        at, before = at[keep], before[keep]
        yield row[at], before, behind[at], nxt[at]


_BINARY, _LONG, _INT = pa.binary(), pa.int64(), pa.int32()
_NODE_FIELDS = (("g", _BINARY), ("id", _LONG), ("s", _BINARY), ("key", _LONG), ("before", _INT), ("behind", _INT), ("next", _INT), ("repeat", _BINARY))


def _nodes(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_NODE_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(cols, _NODE_FIELDS)], names=[n for n, _ in _NODE_FIELDS])


def _slices(n: int, size: int = 20_000) -> list[slice]:
    return [slice(lo, min(n, lo + size)) for lo in range(0, n, size)]


def _right_scan(named: bool):
    """Members of maximal repeats, and of classes that go over a border of chunks (before is null).

    The former are one row for each repeat with its name or, unless ``named``, one row for each context with how far its repeats
    reach. The latter have in g the name of the stretch of 200 bytes that reaches ``behind`` bytes behind the core, and in s what stands before it, backwards.
    """

    def scan(edges):
        def run(batches):
            for t, at in whole_groups(batches):
                g, ctx, s, back = (t.column(c).to_pylist() for c in ("g", "id", "s", "back"))
                stretch = lambda r, d: xxhash.xxh3_128_digest(g[r] + bytes([d]) + s[r][:d] + back[r][: REACH - d])
                key = lambda r: struct.unpack(">q", g[r])[0]
                sides, far = matrix(t.column("back").chunk(0)), np.full((2, t.num_rows), -1)
                for row, behind, nxt, number, start in _classes(t, at, edges and edges.value, *sides):
                    open_ = int((number < 0).sum())  # they come first
                    for own in _slices(open_):
                        yield _nodes([(stretch(r, d), ctx[r], back[r][REACH - d :], key(r), None, d, e, None) for r, d, e in zip(row[own].tolist(), behind[own].tolist(), nxt[own].tolist())])
                    for row, before, behind, nxt in _maximal(*sides, row[open_:], behind[open_:], nxt[open_:], start[start >= open_] - open_):
                        if named:
                            for own in _slices(len(row)):
                                all_ = zip(row[own].tolist(), before[own].tolist(), behind[own].tolist(), nxt[own].tolist())
                                yield _nodes([(None, ctx[r], None, key(r), b, d, e, xxhash.xxh3_128_digest(stretch(r, d) + back[r][REACH - d : b])) for r, b, d, e in all_])
                        else:
                            np.maximum.at(far[0], row, before)
                            np.maximum.at(far[1], row, behind)
                own = np.flatnonzero(far[0] >= 0)
                yield _nodes([(None, ctx[r], None, key(r), b, d, None, None) for r, b, d in zip(own.tolist(), far[0][own].tolist(), far[1][own].tolist())])

        return run

    return scan


def _left_scan(edges):
    """A row for each member of each maximal repeat of classes that go over borders; if they do so on the left too, ``repeat_groups`` tests the right."""

    def run(batches):
        for t, at in whole_groups(batches):
            g, s, deep = t.column("g").to_pylist(), t.column("s").to_pylist(), t.column("behind").to_numpy()
            for row, more, number in tree_parts(*_strings(t, at, edges and edges.value)):
                nxt = t.column("next").to_numpy()[row]
                keep = both_sides_diverse(number, nxt)
                row, more, nxt = row[keep], more[keep], nxt[keep]
                behind, take = deep[row], pa.array(row)
                names = [xxhash.xxh3_128_digest(g[r] + s[r][:d]) for r, d in zip(row.tolist(), more.tolist())]
                cols = [t.column("key").chunk(0).take(take), t.column("id").chunk(0).take(take), pa.array((REACH - behind + more).astype(np.int32)), pa.array(behind.astype(np.int32)), pa.array(nxt.astype(np.int32)), pa.array(names, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "ctx", "before", "behind", "next", "repeat"])

    return run


def _summary(batches):
    """First and last string of each chunk and the depths of the intervals that touch them."""
    kind = pa.list_(pa.int32())
    for t, at in whole_groups(batches):
        x, size = matrix(t.column("s").chunk(0))
        lcp, s, ends = common(x, size), t.column("s"), [*at[1:].tolist(), t.num_rows]
        inside = [lcp[lo + 1 : hi] for lo, hi in zip(at.tolist(), ends)]
        lefts = [np.unique(np.minimum.accumulate(v)).tolist() for v in inside]
        rights = [np.unique(np.minimum.accumulate(v[::-1])).tolist() for v in inside]
        cols = [t.column("g").chunk(0).take(pa.array(at)), t.column("chunk").chunk(0).take(pa.array(at)), pa.array([s[lo].as_py() for lo in at.tolist()], pa.binary()), pa.array([s[hi - 1].as_py() for hi in ends], pa.binary())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(lefts, kind), pa.array(rights, kind)], names=["g", "chunk", "first", "last", "lefts", "rights"])


def _cut_points(rows: DataFrame, hot: dict, share: int) -> dict:
    """Group to its sorted cut points (s, id), from a sample by hash of about SAMPLES members for each chunk."""
    spark = rows.sparkSession
    names = F.broadcast(spark.createDataFrame([(g,) for g in hot], "g binary"))
    few = rows.select("g", "s", "id").join(names, "g", "left_semi").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, share // SAMPLES))) == 0).collect()
    out = {g: [] for g in hot}
    for g, some in groupby(sorted((bytes(r["g"]), bytes(r["s"]), r["id"]) for r in few), key=lambda r: r[0]):
        some, n = list(some), -(-hot[g] // share)
        out[g] = sorted({some[len(some) * k // n][1:] for k in range(1, n)})
    return out


def _dealt(shared, columns):
    def run(batches):
        for batch in batches:
            cuts = shared.value
            chunk = [bisect_right(cuts[g], (s, i)) for g, s, i in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("g", "s", "id")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int32())], names=columns)

    return run


def scanned(rows: DataFrame, scan, schema: str) -> DataFrame:
    """``scan`` over the groups ``g`` of ``rows`` (g, id, s, ...; a written table), each sorted by (s, id), large ones in chunks."""
    spark = rows.sparkSession
    share = max(SHARE, -(-rows.count() // pieces(spark)))
    # groups of more than an even share: fewer than partitions
    hot = {bytes(r["g"]): r["count"] for r in rows.groupBy("g").count().where(F.col("count") > share).collect()}
    order = ("g", "chunk", "s", "id")
    if not hot:
        return rows.withColumn("chunk", F.lit(0)).repartition("g").sortWithinPartitions(*order).mapInArrow(scan(None), schema)
    names = F.broadcast(spark.createDataFrame([(g,) for g in hot], "g binary"))
    small = rows.join(names, "g", "left_anti").withColumn("chunk", F.lit(0)).repartition("g").sortWithinPartitions(*order)
    cuts = spark.sparkContext.broadcast(_cut_points(rows, hot, share))
    large = rows.join(names, "g", "left_semi").select(*rows.columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    large = large.mapInArrow(_dealt(cuts, [*rows.columns, "chunk"]), f"{kinds}, chunk int").repartition("g", "chunk").sortWithinPartitions(*order)
    ends = large.select("g", "chunk", "s").mapInArrow(_summary, "g binary, chunk int, first binary, last binary, lefts array<int>, rights array<int>").collect()  # a row per chunk
    edges = spark.sparkContext.broadcast(borders(ends))
    return small.mapInArrow(scan(None), schema).unionAll(large.mapInArrow(scan(edges), schema))


def _located(docs: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Places (uid, doc_id, n_bytes, sha, text, cores) of all rows, and the contexts (key, ctx, low, high) that they hold."""
    spark = docs.sparkSession
    bounded_batches(spark, rows=500, size=8 << 20)
    counts = docs.select("text").mapInArrow(_core_counts, "h long").groupBy("h").count().where("count > 1").select("h")
    again = spark.sparkContext.broadcast(bitmap_of(counts))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = work.write(rows.mapInArrow(_places(again), _PLACES), "places")
    each = _each(places).withColumn("id", F.xxhash64("uid", "at"))
    return places, work.write(each.groupBy("key", "ctx").agg(F.min("id").alias("low"), F.max("id").alias("high")), "contexts")


def _each(places: DataFrame) -> DataFrame:
    return places.where("text is not null").select("uid", "doc_id", F.explode("cores").alias("c")).select("uid", "doc_id", "c.at", "c.key", "c.ctx")


def _members(places: DataFrame, contexts: DataFrame, work: Scratch, every: bool) -> DataFrame:
    """(key, ctx, before, behind, next, repeat): the contexts of each maximal repeat group.

    Unless ``every``, a context that is in groups of one chunk only has one row that tells how far they reach, and cores all
    of whose contexts occur again are left out: they repeat as a whole, whatever else they share.
    """
    spark = places.sparkSession
    open_ = contexts.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("low") == F.col("high")).alias("lone")).where("n > 1" if every else "n > 1 and lone > 0")
    picked = spark.sparkContext.broadcast(bitmap_of(contexts.join(open_, "key", "left_semi").select(F.col("low").alias("h"))))
    flat = places.where("text is not null").select(
        "text", F.expr("cores.at").alias("at"), F.expr("cores.key").alias("key"), F.expr("cores.ctx").alias("ctx"), F.expr("transform(cores, c -> xxhash64(uid, c.at))").alias("ids")
    )
    suffixes = work.write(flat.mapInArrow(_emitted(picked), _SUFFIX), "suffixes")
    nodes = work.write(scanned(suffixes, _right_scan(every), _NODE), "nodes")
    work.drop("suffixes")
    inside = nodes.where("before is not null").select("key", F.col("id").alias("ctx"), "before", "behind", "next", "repeat")
    over = work.write(nodes.where("before is null").select("g", "id", "s", "key", "behind", "next"), "over")
    return inside.unionByName(scanned(over, _left_scan, _MEMBER))


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(repeat, n_bytes, doc_id, uid, start): every maximal repeat around a core with all its occurrences.

    ``repeat`` names the repeated bytes, ``uid`` tells rows of one doc_id apart, ``start`` is in bytes. Written.
    """
    work = Scratch(docs.sparkSession)
    places, contexts = _located(docs, work)
    members = work.write(_members(places, contexts, work, True), "members")
    right = members.groupBy("repeat").agg(F.min("next").alias("lo"), F.max("next").alias("hi")).where("lo <> hi or lo < 0").select("repeat")
    inner = members.join(right, "repeat", "left_semi").select("key", "ctx", "repeat", "before", "behind")
    # contexts that occur again as a whole are groups of their own
    name = F.unhex(F.concat(F.lpad(F.hex("key"), 16, "0"), F.lpad(F.hex("ctx"), 16, "0")))
    whole = contexts.where("low <> high").select("key", "ctx", name.alias("repeat"), F.lit(REACH).alias("before"), F.lit(REACH).alias("behind"))
    both = _each(places).join(inner.unionByName(whole), ["key", "ctx"]).join(places.select("uid", "n_bytes"), "uid")
    start, end = F.greatest(F.col("at") - F.col("before"), F.lit(0)), F.least(F.col("at") + CORE + F.col("behind"), F.col("n_bytes"))
    found = both.select("repeat", (end - start).cast("long").alias("n_bytes"), "doc_id", "uid", start.cast("long").alias("start")).where(f"n_bytes >= {LENGTH}")
    out = Scratch(docs.sparkSession).write(found, "groups")
    work.clear()
    return out


def marked(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: uid, doc_id, n_bytes, sha, text (bytes; null if nothing can repeat), spans (start, end)."""
    work, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    places, contexts = _located(docs, kept)
    members = _members(places, contexts, work, False).select("key", "ctx", "before", "behind")
    whole = contexts.where("low <> high").select("key", "ctx", F.lit(REACH).alias("before"), F.lit(REACH).alias("behind"))
    reach = members.unionByName(whole).groupBy("key", "ctx").agg(F.max("before").alias("before"), F.max("behind").alias("behind"))  # all hold the core: one stretch
    reach = work.write(reach, "reach")
    work.drop("nodes", "over")
    kept.drop("contexts")
    met = _each(places).join(reach, ["key", "ctx"]).select("uid", F.expr("at - before").alias("lo"), F.expr("at + %d + behind" % CORE).alias("hi"))
    spans = kept.write(met.distinct().groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "spans")
    work.clear()
    return places.drop("cores").join(spans, "uid", "left")


def _cut(batches):
    for batch in batches:
        doc, n, sha, removed, runs, kept = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), [], [], []
        for i, (text, spans) in enumerate(zip(batch.column(3), batch.column(4).to_pylist())):
            text, merged = text.as_py(), []
            for x in spans or ():
                lo, hi = max(0, x["lo"]), min(n[i], x["hi"])
                if hi - lo < LENGTH:
                    continue
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            left, at = [], 0
            for lo, hi in merged:
                left.append(text[at:lo])
                at = hi
            kept.append(b"".join([*left, text[at:]]) if text is not None else None)
            if text is not None:
                sha[i] = hashlib.sha256(kept[-1]).hexdigest()
            removed.append(sum(hi - lo for lo, hi in merged))
            runs.append(len(merged))
        yield pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``: the remaining bytes (null where the text is whole)."""
    rows = marked(docs)
    return rows.select("doc_id", "n_bytes", "sha", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return cut(docs).drop("kept")
