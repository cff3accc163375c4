"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

DataFrame operations only. Words are lower-cased and split at ASCII white space; a shingle is five words (an item of
fewer words is one shingle). An item with m shingles is compared with windows of m consecutive shingles of a document.
A window without any of a benchmark's shingles has similarity 0 to all of it, so only windows around a shared shingle
are fingerprinted - nothing else is left out. Fingerprints have 128 bits (two longs), each the majority of that bit over the
window's shingle hashes, shingles weighted by their number. With 14 blocks and radius 41, two fingerprints within the
radius differ by at most 2 bits in some block; item blocks are stored with all their variants of up to 2 flipped
bits, so equality of one block finds every pair within the radius. What is found is verified exactly:
sum of least weights over sum of greatest weights, weights being counts, is at least ``percent`` / 100.

At similarity 0.8 fingerprints differ by 18 bits on average; of 264,740 simulated pairs of exactly that similarity (9 to 90 shingles)
none differed by more than 38. Unlike windows differ by 64 bits, so few of them are verified.

The benchmark's tables are broadcast only where their own counted rows are at most ``BROADCAST_ROWS``; else they are joined
by a shuffle.

Defined cases: null or empty text and items without words match nothing; rows with equal doc_id are all judged, and
give the best window of any; a null doc_id is kept as null; empty tables give no rows; other columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.common import written

WIDTH = 5
RADIUS = 41
HALVES = ("lo", "hi")
BLOCKS = tuple((half, at, n) for half in HALVES for at, n in ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10)))
FLIPS = RADIUS // len(BLOCKS)
LANES = 3  # bits counted side by side in one long, 21 binary digits each
BROADCAST_ROWS = 1_000_000


def shingles(text: str = "text"):
    """The hash of each word shingle of a text, in order; an empty array if it has no word."""
    words = f"filter(split(lower(coalesce({text}, '')), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    return F.expr(
        f"transform(array({words}), w -> if(size(w) = 0, array(), transform(sequence(0, greatest(size(w) - {WIDTH}, 0)), i -> xxhash64(slice(w, i + 1, {WIDTH})))))[0]"
    ).cast("array<bigint>")


def simhash(array: str):
    """The 64-bit fingerprint of an array of hashes: bit b is set if more than half of them have it."""
    mask = sum(1 << (21 * k) for k in range(LANES))
    counts = [f"aggregate({array}, 0L, (a, h) -> a + (shiftrightunsigned(h, {b}) & {mask}L))" for b in range(21)]
    last = f"aggregate({array}, 0L, (a, h) -> a + shiftrightunsigned(h, 63))"
    bits = [f"if(2 * ({{c}}[{b}] >> {21 * k} & 2097151) > {{n}}, shiftleft(1L, {b + 21 * k}), 0L)" for b in range(21) for k in range(LANES)]
    bits.append("if(2 * {c}[21] > {n}, shiftleft(1L, 63), 0L)")
    return f"array({', '.join([*counts, last])})", lambda c, n: " | ".join(x.format(c=c, n=n) for x in bits)


def fingerprinted(df: DataFrame, array: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of its hash array in column ``out``: a struct of two longs, the second of hashed hashes."""
    df = df.withColumn("_again", F.expr(f"transform({array}, h -> xxhash64(h))"))
    for half, own in zip(HALVES, (array, "_again")):
        counts, bits = simhash(own)
        df = df.withColumn("_c", F.expr(counts)).withColumn(f"_{half}", F.expr(bits("_c", f"size({array})")))
    return df.withColumn(out, F.struct(*[F.col(f"_{half}").alias(half) for half in HALVES])).drop("_c", "_again", *[f"_{half}" for half in HALVES])


def distance(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}.{half} ^ {b}.{half})" for half in HALVES)


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, m, hashes, finger."""
    items = benchmark.select("item_id", shingles().alias("hashes")).where(F.size("hashes") > 0).withColumn("m", F.size("hashes"))
    return fingerprinted(items, "hashes", "finger")


def blocks_of(finger: str) -> str:
    """An array of (block, value)."""
    return "array(" + ", ".join(f"struct({k} as block, cast(shiftrightunsigned({finger}.{half}, {at}) & {(1 << n) - 1} as int) as value)" for k, (half, at, n) in enumerate(BLOCKS)) + ")"


def variants_of(items: DataFrame) -> DataFrame:
    """item_id, m, item_finger, block, value: every block of every item with up to ``FLIPS`` bits flipped."""
    rows = items.select("item_id", "m", F.col("finger").alias("item_finger"), F.explode(F.expr(blocks_of("finger"))).alias("b"))
    flips = " when ".join(f"b.block = {k} then filter(sequence(0, {(1 << n) - 1}), x -> bit_count(x) <= {FLIPS})" for k, (_, _, n) in enumerate(BLOCKS))
    return rows.withColumn("x", F.explode(F.expr(f"case when {flips} end"))).select("item_id", "m", "item_finger", "b.block", (F.col("b.value").bitwiseXOR(F.col("x"))).alias("value"))


#: How many rows ``variants_of`` makes of an item.
VARIANTS = sum(math.comb(n, k) for _, _, n in BLOCKS for k in range(FLIPS + 1))


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, version, item_id, first_word, similarity of every window that matches; version is the hash of the text."""
    items = written(item_table(benchmark), "items")
    n, total = items.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    fit = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    keys = items.select("m", F.explode(F.array_distinct("hashes")).alias("h")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    spread = texts.select("doc_id", "version", F.posexplode(shingles()).alias("p", "h"))
    # documents are read again below by the few rows that met the benchmark
    hits = written(spread.join(fit(keys, total), "h").groupBy("doc_id", "version", "m").agg(F.collect_set("p").alias("at")), "hits")
    met = hits.select("doc_id", "version").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])
    there = texts.join(met, same(texts, met), "left_semi").dropDuplicates(["doc_id", "version"])
    there = there.select("doc_id", "version", shingles().alias("all"))
    near = hits.join(there, same(hits, there)).select(hits["doc_id"], hits["version"], "m", "all", "at")
    starts = F.expr("array_distinct(flatten(transform(at, p -> if(size(all) >= m, sequence(greatest(p - m + 1, 0), least(p, size(all) - m)), array(0)))))")
    windows = near.select("doc_id", "version", "m", "all", F.explode(starts).alias("first_word"))
    # a document shorter than the item is one window
    windows = windows.select("doc_id", "version", "m", "first_word", F.expr("slice(all, first_word + 1, m)").alias("hashes"))
    windows = fingerprinted(windows, "hashes", "finger")
    probes = windows.withColumn("b", F.explode(F.expr(blocks_of("finger")))).select("doc_id", "version", "m", "first_word", "hashes", "finger", "b.block", "b.value")
    found = probes.join(fit(variants_of(items), VARIANTS * n), ["m", "block", "value"]).where(F.expr(f"{distance('finger', 'item_finger')} <= {RADIUS}"))
    # a pair is found through several blocks: keep it at the first block that finds it
    first = " when ".join(
        f"bit_count((shiftrightunsigned(finger.{half}, {at}) ^ shiftrightunsigned(item_finger.{half}, {at})) & {(1 << w) - 1}) <= {FLIPS} then {k}" for k, (half, at, w) in enumerate(BLOCKS)
    )
    found = found.where(F.col("block") == F.expr(f"case when {first} end"))
    weights = items.select(F.col("item_id").alias("own_id"), "hashes").withColumn(
        "weights", F.expr("transform(array_distinct(hashes), g -> struct(g as h, size(filter(hashes, x -> x = g)) as n))")
    ).select("own_id", "weights", F.size("hashes").alias("own_m"))
    both = found.join(fit(weights, total), F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("m") == F.col("own_m"))).withColumn(
        "least", F.expr("aggregate(weights, 0, (a, g) -> a + least(g.n, size(filter(hashes, x -> x = g.h))))")
    ).withColumn("union", F.expr("m + size(hashes) - least"))
    good = both.where(100 * F.col("least") >= percent * F.col("union"))
    return good.select("doc_id", "version", "item_id", "first_word", (F.col("least") / F.col("union")).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, first_word, similarity: the best window (then the first) of each document and item."""
    best = matches(docs, benchmark, percent).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("similarity").alias("s"), (-F.col("first_word")).alias("f"))).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.f")).cast("long").alias("first_word"), F.col("x.s").alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark; rows are told apart by id and text."""
    bad = matches(docs, benchmark, percent).select(F.col("doc_id").alias("_bad_id"), F.col("version").alias("_bad_text")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")
