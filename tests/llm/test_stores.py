import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.llm import ann, compaction, warc
from termforge.llm.common import shared_dir


def test_small_shards_merge_and_every_version_reads_whole(spark):
    store = compaction.Store(spark, shared_dir(spark, "store"), target=400_000, floor=2_000, fanout=3)
    for k in range(7):
        store.append(spark.range(k * 500, k * 500 + 500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1))
    before = store.manifest()
    assert len(before["shards"]) == 7 and before["version"] == 7
    store.compact()
    after = store.manifest()
    assert len(after["shards"]) < 7 and sum(s.rows for s in after["shards"]) == 3500
    for version in (7, after["version"]):
        assert store.read(version).agg(F.countDistinct("id"), F.count("*")).first() == (3500, 3500)
    assert store.read(3).count() == 1500
    assert store.vacuum(keep=1) > 0 and store.read().count() == 3500 and store.versions() == [after["version"]]
    assert not store.runs(store.manifest()["shards"])


def test_only_one_of_two_writers_commits_a_version(spark):
    store = compaction.Store(spark, shared_dir(spark, "store"))
    store.append(spark.range(5))
    base = store.manifest()
    store.commit(base, base["schema"], base["shards"])
    with pytest.raises(compaction.ConflictError):
        store.commit(base, base["schema"], [])
    assert store.read().count() == 5
    with pytest.raises(ValueError):
        store.append(spark.range(5).selectExpr("id as other"))


def test_arrivals_of_unlike_size_merge_by_tier(spark):
    store = compaction.Store(spark, shared_dir(spark, "store"), target=200_000, floor=3_000, fanout=3)
    sizes = [40, 40, 3000, 40, 700, 40, 700, 40, 700, 40, 8000]
    for k, n in enumerate(sizes):
        store.append(spark.range(n).select((F.col("id") + 100_000 * k).alias("id"), F.sha2(F.concat(F.lit(str(k)), "id"), 256).alias("x")).coalesce(1))
        store.compact()
        shards = store.manifest()["shards"]
        assert sum(s.rows for s in shards) == sum(sizes[: k + 1]) and not store.runs(shards)
    levels = {s.rows: s.level for s in store.manifest()["shards"]}
    assert levels[8000] == 0 and max(levels.values()) >= 1 and len(levels) < len(sizes)
    rows = store.read()
    assert rows.count() == sum(sizes) == rows.select("id").distinct().count()
    versions = store.versions()
    assert versions == list(range(1, len(versions) + 1)) and len(versions) > len(sizes)
    assert [store.read(v).count() for v in versions if v <= 2] == [40, 80]


def test_vacuum_spares_what_a_writer_has_not_committed_yet(spark):
    store = compaction.Store(spark, shared_dir(spark, "store"))
    store.append(spark.range(5))
    other = compaction.Store(spark, store.path)
    run = other._begin()
    new = other._write(spark.range(5, 9), 0, run)
    assert store.vacuum(keep=1) == 0
    base = other.manifest()
    other.commit(base, base["schema"], base["shards"] + new)
    other._end(run)
    assert store.vacuum(keep=1) == 0 and store.read().count() == 9
    dead = other._begin()
    other._write(spark.range(3), 0, dead)
    assert store.vacuum(keep=1, grace=-10) > 0 and store.read().count() == 9


def test_empty_arrivals_and_nulls(spark):
    store = compaction.Store(spark, shared_dir(spark, "store"))
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert store.read().count() == 0
    store.append(spark.createDataFrame([(None, None), (1, "x"), (1, "x")], "doc_id long, text string"))
    store.compact()
    assert store.read().count() == 3


def pages(spark):
    rows = [
        (1, "http://a/", "<html><head><title>T &amp; x</title><style>p{}</style></head><body><p>Hi<br>there</p><script>var a='</p>';</script><a href='/x'>l</a></body></html>"),
        (2, None, None),
        (3, "http://c/\r\nx: y", ""),
        (3, "http://c/\r\nx: y", ""),
        (None, "http://d/", "plain é text < 3"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1))


def test_derivatives_link_to_their_source(spark):
    source = {r["record_id"]: r for r in warc.responses(pages(spark)).collect()}
    got = warc.derive(warc.responses(pages(spark))).collect()
    assert len(got) == 10
    for r in got:
        s = source[r["refers_to"]]
        assert (r["target_uri"], r["date"], r["source_payload_digest"]) == (s["target_uri"], s["date"], s["payload_digest"])
        assert r["content_length"] == len(r["block"].encode())
    one = {r["record_type"]: r for r in got if r["page_id"] == 1}
    assert one["conversion"]["block"] == "Hi\nthere\nl" and "X-Source-Status: HTTP/1.1 200 OK" in one["conversion"]["source_headers"]
    assert "title: T & x\r\nlinks: 1\r\n" in one["metadata"]["block"]


def test_files_round_trip(spark):
    records = warc.derive(warc.responses(pages(spark))).coalesce(2)
    files = warc.write_files(records, shared_dir(spark, "warc")).collect()
    back = [(dict(h), b) for f in files for h, b in warc.read_file(f["path"])]
    assert sum(f["records"] for f in files) == len(back) == 10
    expected = sorted((r["record_id"], r["block"].encode()) for r in records.collect())
    assert sorted((h["WARC-Record-ID"], b) for h, b in back) == expected
    assert {h["WARC-Target-URI"] for h, _ in back if "WARC-Target-URI" in h} == {"http://a/", "http://c/%0D%0Ax: y", "http://d/"}
    assert warc.digest(pages(spark).limit(0)).count() == 0


def vectors(spark, n=600, d=12):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, d))
    x[: n // 3] = x[0] + 0.01 * rng.standard_normal((n // 3, d))
    x[1] = x[2]
    x *= rng.uniform(0.5, 2, (n, 1))
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(n, None), (n + 20, [0.0] * d), (n + 40, [float("nan")] + [1.0] * (d - 1)), (n + 60, [None] + [1.0] * (d - 1)), (None, [1.0] * d)]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("c"))


def test_neighbours_reach_the_stated_recall(spark):
    x, df = vectors(spark)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, len(x), 20))
    recall = []
    for q, own in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        assert sorted(own) == list(range(1, 21)) and all(abs(s[v] - score) < 1e-9 for v, score in own.values())
        recall.append(len({v for v, _ in own.values()} & set(best.tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_few_and_no_vectors(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(three).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(three.limit(0)).count() == 0
