"""Near-duplicate documents by min-max hashing, banded, with every link confirmed on full shingle sets.

A document's set is its distinct five-word shingles after lower-casing A-Z (fewer words: the whole sequence as one;
none: the empty set, linked with nothing). Each of ``perms`` hash permutations gives two signature values, the
smallest and the largest hash of the set, so half the evaluations give as many values. Bands of ``rows`` values are
the buckets.

Documents with equal sets are one node from the start, however many they are. Nodes that share a band are candidates:

1. In every bucket each node is compared with the bucket's smallest node. What that connects needs no more comparing.
2. Buckets that still hold nodes apart are finished: small ones as pairs. The nodes of large ones, similar as they are but
   not similar enough, meet again in buckets of their rarest shingles, of which linked sets share at least one (an exact
   bound, no estimate): first with the smallest node there, then small buckets as pairs and large ones in bounded cells.

Links are exact: sets are built from whole texts and 100 * intersection >= percent * union is tested. Components
come from large-star / small-star rounds over written tables. A node or component of very many rows is dealt out in joins.

With 24 bands of 4, a pair at similarity 0.85 goes unseen with probability 2e-8 (at 0.8: 3e-6).

Defined cases: null text is the empty set; rows with equal doc_id are all returned; a null doc_id counts as larger
than any other; an empty table gives no rows; other columns pass by. ``near_duplicates`` tells rows by doc_id alone: a
component all of whose ids are null has a null component_id, and all its rows are kept. ``distinct_documents`` tells rows
apart whatever their ids: it keeps one row of each component (the smallest doc_id, then the smallest hash of the row), and
every row without words; rows equal in all columns count as one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.common import Scratch, bitmap_of, bounded_batches, in_bitmap, spread_join, written
from termforge.llm.rolling import Rolling

WIDTH = 5
BANDS, ROWS = 24, 4
SKETCH_BITS = 18
ROW, ALSO = "_row_8d1f", "_also_8d1f"  # hashes of a row; names that no table has
PAIRED = 32  # buckets up to this size become pairs of rows; larger ones are compared in cells
CELL = 256
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 64, BANDS * ROWS // 2, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, BANDS * ROWS // 2, np.uint64)
_ROLL = Rolling(20240229)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words)) - 1
    s, e = starts[: len(words) - k], ends[k:]
    g, q = _ROLL.sums(b)
    return np.unique(_mix((g[e] - g[s]) * q[s]))


def signature(x: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation."""
    low, high = np.full(len(_A), ~np.uint64(0)), np.zeros(len(_A), np.uint64)
    for lo in range(0, len(x), 2048):
        h = x[None, lo : lo + 2048] * _A[:, None] + _B[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> list[int]:
    v = sig.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(v[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketched(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """doc_id, ``keys``, n (set size), node (128-bit hash of the set; null if empty), bands."""
    bounded_batches(docs.sparkSession)
    k = len(keys)

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                n, node, bands = [], [], []
                for t in batch.column(k + 1).to_pylist():
                    x = shingle_set(t)
                    n.append(len(x))
                    node.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    bands.append(band_keys(signature(x)) if len(x) else None)
                own = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], *own], names=["doc_id", *keys, "n", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, "text")
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keys)]
    return rows.mapInArrow(run, ", ".join([*kinds, "n long, node binary, bands array<long>"]))


def buckets_of(sketch: DataFrame) -> DataFrame:
    """(key, node, n): the bands that two nodes or more have in common, as entries of buckets."""
    nodes = sketch.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    return _shared(keys)


def _shared(keys: DataFrame) -> DataFrame:
    """The entries (key, node, n) of keys that two nodes or more have."""
    met = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    return keys.join(met, "key", "left_semi").select("key", "node", "n")


def full_sets(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(node, n, shingles) of the nodes ``met`` (node, rep): the full sorted set as 8-byte integers, built from the text of row ``rep``.

    Texts are not shuffled: a bitmap of the ``rep`` picks the rows where they are read, and sets that it lets through by chance go by their node.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(met.select(F.col("rep").alias("h"))))

    def run(batches):
        bitmap = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                picked = pa.array(in_bitmap(bitmap, batch.column(0).to_numpy().view(np.uint64)))
                sets = [shingle_set(t) for t in batch.column(1).filter(picked).to_pylist()]
                sets = [x for x in sets if len(x)]
                out = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["node", "n", "shingles"])

    rows = docs.select(ROW, "text").mapInArrow(run, "node binary, n long, shingles binary").dropDuplicates(["node"])
    return rows.join(met.select("node"), "node", "left_semi")


def _cell(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """How often shingles fall in each of 2**SKETCH_BITS hash cells: a total order, rare first, of bounded size."""

    def run(batches):
        n = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(n, _cell(np.frombuffer(x.as_py(), np.uint64)), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    summed = sets.select("shingles").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return out


def prefixes(sets: DataFrame, percent: int, frequency: np.ndarray) -> DataFrame:
    """(key, node, n): each node's rarest shingles, of which a linked node has at least one among its own.

    Linked sets differ in so few shingles that, in any one order of all shingles, their first
    n - ceil(percent * n / 100) + 1 meet. The order is by ``frequency``, a sketch over these sets or more; shingles that occur
    once in it meet nothing and are left out.
    """
    order = sets.sparkSession.sparkContext.broadcast(frequency)

    def run(batches):
        freq = order.value
        for batch in batches:
            own, size = [np.zeros(0, np.int64)], []
            for n, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(raw.as_py(), np.uint64)
                f = freq[_cell(x)]
                k = n - -(-percent * n // 100) + 1
                first = np.lexsort((x, f))[:k]
                own.append(x[first[f[first] > 1]].astype(np.int64))
                size.append(len(own[-1]))
            at = np.repeat(np.arange(batch.num_rows), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["key", "node", "n"])

    return sets.select("node", "n", "shingles").mapInArrow(run, "key long, node binary, n long")


def _near(percent: int, x: str, y: str):
    """Whether two set sizes allow a link."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) of nodes, a written table, whose full sets are linked; an ``a`` in very many pairs is dealt out."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = spread_join(pairs, side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _hubs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node of a bucket with the smallest node of the bucket."""
    low = entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"))
    met = spread_join(entries, low, "key").where(_near(percent, "n", "low.n"))
    return met.select(F.col("low.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def _apart(entries: DataFrame, label: DataFrame) -> DataFrame:
    """The entries of buckets that hold nodes of different ``label`` (node, label), with m, the nodes of the bucket."""
    named = entries.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key", "m")
    return named.join(open_, "key")


def _pairs(small: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different labels of small buckets."""
    x, y = (small.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "label")]) for k in "ab")
    pairs = x.join(y, "key").where("node_a < node_b and label_a <> label_b").where(_near(percent, "n_a", "n_b"))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def confirm_cells(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside large buckets, in bounded cells.

    ``rows``: key, m (bucket size), node, label, shingles. A bucket is dealt by hash into blocks of about CELL
    nodes, and each pair of blocks is a cell of its own: no task holds more than two blocks and no pair becomes a row.
    A cell compares nodes of different labels and gives at most one link for each pair of labels it joins.
    """
    blocks = F.ceil(F.col("m") / CELL).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def run(table: pa.Table) -> pa.Table:
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        out: list = []
        if len(set(label)) > 1:
            words, at = np.unique(np.concatenate(sets), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            n = np.array([len(x) for x in sets])
            both = np.zeros((len(sets), len(sets)), np.float32)
            for lo in range(0, len(words), 4096):  # exact: counts stay far below 2**24
                x = np.zeros((len(sets), min(4096, len(words) - lo)), np.float32)
                inside = (at >= lo) & (at < lo + 4096)
                x[row[inside], at[inside] - lo] = 1
                both += x @ x.T
            hit = 100 * both.astype(np.int64) >= percent * (n[:, None] + n[None, :] - both.astype(np.int64))
            if i != j:
                hit &= (own[:, None] == i) & (own[None, :] == j)
            up = {x: x for x in label}

            def top(x):
                while up[x] != x:
                    x = up[x] = up[up[x]]
                return x

            for a, b in np.argwhere(hit):
                if a != b and top(label[a]) != top(label[b]):
                    up[top(label[a])] = top(label[b])
                    out.append((node[a], node[b]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def links(docs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(a, b), written: confirmed links that connect all nodes that any links connect."""
    work = Scratch(docs.sparkSession)
    entries = work.write(buckets_of(sketch), "entries")
    reps = sketch.where("node is not null").groupBy("node").agg(F.min(ROW).alias("rep"))
    met = work.write(reps.join(entries.select("node").distinct(), "node", "left_semi"), "met")
    work.release()
    sets = work.write(full_sets(docs, met), "sets")
    work.drop("met")
    hubs = work.write(_hubs(entries, percent), "hubs")
    work.release()  # the files of the last job may still be held when a release comes right after it
    first = work.write(confirm(hubs, sets, percent), "first")
    work.release()
    # nodes with one confirmed hub are connected; what else a bucket holds is compared across such labels
    label = first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    again = label.select(F.col("node").alias("label"), F.col("label").alias("root"))
    label = label.join(again, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    apart = work.write(_apart(entries, label), "apart")
    work.drop("entries")
    pairs = work.write(_pairs(apart.where(F.col("m") <= PAIRED), percent).join(hubs, ["a", "b"], "left_anti"), "pairs")
    found = [first, confirm(pairs, sets, percent)]
    wide = work.write(apart.where(F.col("m") > PAIRED).select("node").distinct(), "wide")
    work.drop("hubs", "apart")
    if not wide.isEmpty():
        few = work.write(sets.join(wide, "node", "left_semi"), "few")
        tokens = work.write(_shared(prefixes(few, percent, frequency_sketch(sets))), "tokens")
        hubs = work.write(_hubs(tokens, percent), "token_hubs")
        second = work.write(found[0].unionAll(found[1]).unionAll(confirm(hubs, few, percent)), "second")
        ends = second.select(F.col("a").alias("node")).unionAll(second.select(F.col("b").alias("node"))).distinct()
        label = components(ends, second).withColumnRenamed("comp", "label")
        rest = work.write(_apart(tokens, label), "rest")
        work.drop("tokens", "token_hubs")
        pairs = work.write(_pairs(rest.where(F.col("m") <= PAIRED), percent), "token_pairs")
        large = rest.where(F.col("m") > PAIRED).select("key", "m", "node", "label").join(few.select("node", "shingles"), "node")
        found = [second, confirm(pairs, few, percent), confirm_cells(large, percent)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    out = written(out, "confirmed")
    work.clear()
    return out


def components(nodes: DataFrame, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, comp): the smallest node that each node reaches over the undirected ``links`` (a, b).

    Large-star / small-star rounds over written tables until nothing changes: each round is two aggregations.
    """
    spark, work = nodes.sparkSession, Scratch(nodes.sparkSession)
    edges = work.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges-0")
    last, n = None, 0
    while True:
        # large star: every node hooks its larger neighbours to the smallest of its neighbourhood
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours hook to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        n += 1
        fresh = work.write(small, f"edges-{n}")
        state = fresh.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last, edges = state, fresh
    found = nodes.select("node").join(fresh.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    out = written(found, name)
    work.clear()
    return out


def grouped(docs: DataFrame, percent: int, keys: tuple[str, ...] = (ROW,)) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row (doc_id, ``keys``, n, node) and the components (node, comp) of the nodes that have links.

    ``docs`` has a hash of each row in column ROW, one of ``keys``.
    """
    sketch = written(sketched(docs, keys), "sketch")
    found = links(docs, sketch, percent)
    ends = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node"))).distinct()
    return sketch.drop("bands"), components(ends, found)


def _lowest(sketch: DataFrame, comp: DataFrame, what) -> DataFrame:
    """(node, comp, low): the least of ``what`` over the rows of each node's component; rows meet by node with partial sums."""
    own = sketch.where("node is not null").groupBy("node").agg(F.min(what).alias("own"))
    named = written(own.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named")
    return spread_join(named, named.groupBy("comp").agg(F.min("own").alias("low")), "comp").select("node", "comp", "low")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sketch, comp = grouped(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias(ROW)), percent)
    low = _lowest(sketch, comp, "doc_id").select("node", "low")
    out = spread_join(sketch.where("node is not null"), low, "node")
    out = out.select("doc_id", "n", F.col("low").alias("component_id")).unionByName(sketch.where("node is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each component, and all without words.

    Survivors are decided on hashes of whole rows; the texts are shuffled once, to meet the survivors.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*own, F.xxhash64(*own).alias(ROW), F.xxhash64(F.lit(1), *own).alias(ALSO))
    sketch, comp = grouped(keyed, percent, (ROW, ALSO))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", ROW, ALSO)
    first = _lowest(sketch, comp, order).select("comp", "low").distinct().select(f"low.{ROW}", f"low.{ALSO}")
    rows = sketch.groupBy(ROW, ALSO).agg(F.count("*").alias("copies"), F.first("node").isNull().alias("bare"))
    kept = rows.join(first.withColumn("_first", F.lit(True)), [ROW, ALSO], "left").where("bare or _first")
    kept = written(kept.select(ROW, ALSO, (F.col("bare") | (F.col("copies") == 1)).alias("once")), "kept")
    out = keyed.join(kept.where("once").select(ROW, ALSO), [ROW, ALSO], "left_semi")
    again = kept.where("not once").select(ROW, ALSO)
    if not again.isEmpty():  # rows equal in all columns
        out = out.unionAll(keyed.join(again, [ROW, ALSO], "left_semi").dropDuplicates([ROW, ALSO]))
    return out.select(*own)
