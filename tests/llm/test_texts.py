import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from termforge.llm import decontam, langid, minhash, repeats, secret_scan

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---------------------------------------------------------------- near duplicates


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_rows():
    rng, rows = random.Random(4), []
    for g in range(12):
        base = prose(rng, 120).split()
        for k in range(rng.choice([1, 2, 6, 40])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append(" ".join(own))
    rows += [None, "", "  ", "one two", "One TWO", "one  two\t", "five words are in this", prose(rng, 30000)]
    rows += rows[:9]
    rng.shuffle(rows)
    return [(i, t, 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("percent", "paired"), [(85, minhash.PAIRED), (80, 2)])
def test_components_equal_brute_force(spark, monkeypatch, percent, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "CELL", 8 if paired == 2 else 256)
    rows = near_rows()
    sets = {i: shingles(t) for i, t, _ in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node int"), percent).collect()}
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), top(i), top(i) == i)


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = (prose(random.Random(k), 60) for k in range(3))
    near = a + " end"
    rows = [(1, a, "en"), (5, a, "en"), (5, b, "en"), (None, a, "en"), (None, c, None), (None, c, None), (7, near, "x"), (8, None, "x"), (8, None, "x"), (9, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as node", "1 as key")
    kept = minhash.distinct_documents(df, 80)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, c), (8, None), (8, None), (9, "")], key=str)
    assert minhash.distinct_documents(df.limit(0), 80).count() == 0


def test_sets_are_built_where_texts_are_read(spark):
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(6)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate([*texts, None, ""])] + [(0, texts[0], 0)], f"doc_id long, text string, {minhash.ROW} long")
    with np.errstate(over="ignore"):
        sets = {k: minhash.shingle_set(texts[k]) for k in (0, 2, 4)}  # hashes so small share one cell of the bitmap, which lets all rows through
    nodes = {k: minhash.xxhash.xxh3_128_digest(x.tobytes()) for k, x in sets.items()}
    found = minhash.full_sets(docs, spark.createDataFrame([(bytearray(nodes[k]), k) for k in nodes], "node binary, rep long"))
    assert sorted((bytes(r["node"]), r["n"], bytes(r["shingles"])) for r in found.collect()) == sorted((nodes[k], len(x), x.tobytes()) for k, x in sets.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    at = next(k for k, x in enumerate(plan) if "MapInArrow" in x)
    end = next((k for k in range(at + 1, len(plan)) if depth[k] <= depth[at]), len(plan))
    assert not any("Join" in x for x in plan[at:end])  # a join there would shuffle whole texts


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 85).count() == 0


def test_min_max_signatures_estimate_similarity():
    rng, got = random.Random(1), []
    for _ in range(40):
        a, b = prose(rng, 300).split(), None
        b = a[:270] + prose(rng, 30).split()
        with np.errstate(over="ignore"):
            x, y = minhash.shingle_set(" ".join(a)), minhash.shingle_set(" ".join(b))
            got.append((minhash.signature(x) == minhash.signature(y)).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(got)) < 0.03


# ---------------------------------------------------------------- repeats


def repeat_rows():
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (45, 60, 90, 300)]
    rows = [prose(rng, 40) + " " + rng.choice(shared) + " " + prose(rng, 30) for _ in range(25)]
    rows += ["Anst " * 120, "ab" * 300, None, "", "short", shared[3], "é" * 150 + prose(rng, 5), "x" * 199, "x" * 200, "y" * 201]
    rows += [rows[0], rows[0], shared[2][3:] + rows[1][50:]]
    return [(i % 33, t, "z") for i, t in enumerate(rows)]


@pytest.mark.parametrize("share", [repeats.SHARE, 2])
def test_cuts_equal_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(repeats, "SHARE", share)
    rows = repeat_rows()
    raw = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    expected = []
    for (d, _, _), t in zip(rows, raw):
        hit = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, h in zip(t, hit) if not h)
        runs = sum(1 for i in range(len(t)) if hit[i] and (not i or not hit[i - 1]))
        expected.append((d, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = [tuple(r) for r in repeats.cut(df).drop("kept").collect()]
    assert sorted(got) == sorted(expected)
    assert any(n for _, _, n, _, _ in got)


@pytest.mark.parametrize("share", [repeats.SHARE, 2])
def test_groups_are_maximal_and_hold_all_occurrences(spark, monkeypatch, share):
    """Against all pairs: what two places share around a core is a group, and a group is all places that have its bytes there."""
    monkeypatch.setattr(repeats, "SHARE", share)
    rows = repeat_rows()[:33]
    raw = [(t or "").encode() for _, t, _ in rows]
    found: dict = {}
    for r in repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string, uid string")).collect():
        found.setdefault(bytes(r["repeat"]), set()).add((r["doc_id"], r["start"], r["n_bytes"]))
    own = {d: t for (d, _, _), t in zip(rows, raw)}
    assert len(own) == len(rows) and found
    covered: dict = {}
    for members in found.values():
        assert len(members) > 1
        texts = {own[d][s : s + n] for d, s, n in members}
        assert len(texts) == 1 and len(next(iter(texts))) >= 200
        for d, s, n in members:
            covered.setdefault(d, set()).update(range(s, s + n - 199))
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for d, t in own.items():
        assert covered.get(d, set()) == {i for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1}


def test_memberships_of_chunks_equal_those_of_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(2, 14)
        rows = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(6))), i) for i in range(n))
        cuts = sorted({rng.choice(rows) for _ in range(rng.randrange(1, 4))})
        chunk = [sum(c <= r for c in cuts) for r in rows]
        make = lambda ch: pa.table({"g": pa.array([b"g"] * n, pa.binary()), "chunk": pa.array(ch, pa.int32()), "s": pa.array([s for s, _ in rows], pa.binary())})
        pairs = {(i, repeats.shared_length(rows[i][0], rows[j][0])) for i in range(n) for j in range(n) if i != j}
        row, depth, _ = repeats.memberships(make([0] * n), np.array([0]), None)
        assert set(zip(row.tolist(), depth.tolist())) == pairs
        t = make(chunk)
        at = repeats._parts(t)
        ends = [r for b in repeats._summary(t.to_batches()) for r in b.to_pylist()]
        row, depth, number = repeats.memberships(t, at, repeats.borders(ends))
        assert set(zip(row.tolist(), depth.tolist())) == pairs and len(row) == len(set(zip(row.tolist(), depth.tolist())))


def _near_contexts(n):
    """Sorted suffixes of one core that each follow a common text up to a place of their own, on both sides."""
    rng = np.random.default_rng(12)
    text, ends, other = rng.integers(97, 123, 84, "u1"), rng.integers(0, 85, (2, n)), rng.integers(97, 123, (2, n, 84), "u1")
    right, left = (np.where(np.arange(84) < e[:, None], text, o) for e, o in zip(ends, other))
    return sorted((right[i].tobytes(), i, left[i].tobytes()) for i in range(n))


def _batches(rows):
    cols = [pa.array([b"00000007"] * len(rows)), pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), pa.array([0] * len(rows), pa.int32())]
    t = pa.RecordBatch.from_arrays(cols, names=["g", "id", "s", "back", "chunk"])
    return [t.slice(k, 500) for k in range(0, len(rows), 500)]


def test_scan_of_a_large_group_is_bounded_in_memory():
    batches = _batches(_near_contexts(20_000))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in repeats._right_scan(False)(None)(batches))
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()


def test_parts_of_intervals_give_what_the_whole_gives(monkeypatch):
    class Edges:
        value = {(b"00000007", 0): (84, 84, [0, 9, 40], [3, 70])}

    got = []
    for part in (repeats.PART, 60):
        monkeypatch.setattr(repeats, "PART", part)
        for named in (True, False):
            for edges in (None, Edges):
                got.append(Counter(tuple(r.values()) for b in repeats._right_scan(named)(edges)(_batches(_near_contexts(400))) for r in b.to_pylist()))
    assert got[:4] == got[4:] and all(got)


def test_repeats_of_nothing(spark):
    assert repeats.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- decontamination


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 5, 12, 30, 30, 60))] + [(6, None), (7, "")]
    docs = []
    for i in range(60):
        t = prose(rng, rng.randrange(5, 80)).split()
        if i % 2:
            own = items[rng.randrange(6)][1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            at = rng.randrange(len(t))
            t[at:at] = own
        docs.append((i, " ".join(t).upper() if i % 5 == 0 else " ".join(t), "v"))
    docs += [(60, None, "v"), (61, "", "v"), (61, items[3][1], "v"), (62, items[4][1][:90], "v")]
    cut = lambda t: (lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])((t or "").lower().split())
    expected = {}
    for d, t, _ in docs:
        s = cut(t)
        for k, it in items:
            g = cut(it)
            for f in range(max(1, len(s) - len(g) + 1)) if g and s else ():
                w, c = Counter(s[f : f + len(g)]), Counter(g)
                low = sum((w & c).values())
                union = len(g) + sum(w.values()) - low
                if 100 * low >= 80 * union and low / union > expected.get((d, k), (0, 0))[0]:
                    expected[d, k] = (low / union, f)
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string, version string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in got} == expected and len(got) == len(expected) > 8
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string, version string"), none).count() == 0


# ---------------------------------------------------------------- secrets

KINDS = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), ("access", re.compile("(AKIA[A-Z0-9]+)"), 1, 16), ("hex", re.compile("([0-9a-f]+)"), 1, 32))


def model_spans(t):
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(KINDS) for m in p.finditer(t or "") if len(m[g]) >= least)
    return [f"{name}:{a}:{b}" for a, _, b, name in found]


def secret_rows():
    rng = random.Random(9)
    parts = ["password", "token", "api_key", "APIKEY", ": ", "=", "'", '"', "abcdefgh12", "short", " ", "AKIAABCDEFGHIJKL", "AKIA12", "0123456789abcdef" * 2, "é😀", "deadbeef", "\n", "secret=", "ſecret"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(300)] + [None, "", "x" * 50000 + " token=abcdefghij"]
    return [(i, t) for i, t in enumerate(rows + rows[:20])]


def test_secrets_equal_brute_force_and_are_masked(spark):
    rows = secret_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = secret_scan.Ledger(spark)
    ledger.scan(df)
    got = {r["doc_id"]: r for r in secret_scan.digest(ledger.matched(df)).collect()}
    for i, t in rows:
        spans = model_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert got[i]["n_hex"] == sum(s.startswith("hex") for s in spans) and got[i]["n_assign"] == sum(s.startswith("assign") for s in spans)
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(ledger.matched(df)).collect()}
    for i, t in rows:
        cover = bytearray(len(t or ""))
        for s in model_spans(t):
            a, b = map(int, s.split(":")[1:])
            cover[a:b] = b"\1" * (b - a)
        if not any(cover):
            assert masked[i] == t
        else:
            assert re.sub(r"\[secret\]", "", masked[i]) == "".join(c for c, k in zip(t, cover) if not k)


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "none")], "doc_id long, text string")
    later = spark.createDataFrame([(1, "token=abcdefgh1"), (3, "none"), (1, "now AKIAABCDEFGHIJKL"), (4, "token=abcdefgh1")], "doc_id long, text string")
    ledger = secret_scan.Ledger(spark)
    ledger.scan(first)
    assert ledger.unseen(first).count() == 0 and ledger.unseen(later).count() == 1
    ledger.scan(later)
    assert ledger.scanned().count() == ledger.scanned().distinct().count() == 3 * len(secret_scan.RULES)
    assert sorted((r["doc_id"], len(r["found"])) for r in ledger.matched(later).collect()) == [(1, 1), (1, 1), (3, 0), (4, 1)]
    newer = tuple(secret_scan.Rule(r.kind, r.pattern, r.group, r.least, r.base, 2 if r.kind == "hex" else 1) for r in secret_scan.RULES)
    assert {tuple(r["kinds"]) for r in ledger.unseen(later, newer).collect()} == {("hex",)}


def test_secrets_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    ledger = secret_scan.Ledger(spark)
    ledger.scan(none)
    assert secret_scan.digest(ledger.matched(none)).count() == 0


# ---------------------------------------------------------------- languages


def test_languages_are_told_apart_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("the and of", "en"), ("der die das", "de")] * 20)] + [(100, None, "en"), (101, "12 !? ½ ²①", "en"), (102, "", None), (None, "the", "en"), (103, "das der", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    got = {r["doc_id"]: r for r in langid.digest(df).collect()}
    assert len(got) == 45 and {got[i]["lang_pred"] for i in (100, 101, 102)} == {"und"} and got[103]["lang_pred"] == "de" and got[None]["lang_pred"] == "en"
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.digest(unlabelled).collect()} == {"und"}
    assert langid.digest(df.limit(0)).count() == 0


def test_weights_are_nystrom_ridge_regression():
    """Without the operator's own weights: features, ridge solution and predictions from explicit kernels."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("the", "and", "of", "it") if k % 2 else ("der", "und", "das", "ist")) for _ in range(rng.randrange(2, 9))) for k in range(40)]
    langs = ["en" if k % 2 else "de" for k in range(40)]
    m = langid.fit(texts, langs, landmarks_per_lang=6, ridge=1e-3)
    grams = lambda t: {t.encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    marks = [t for y in ("de", "en") for t in [t for t, z in zip(texts, langs) if z == y][:6]]
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    good = values > values.max() * 1e-8
    root = vectors[:, good] @ np.diag(values[good] ** -0.5)
    phi = np.array([[kernel(t, z) for z in marks] for t in texts]) @ root
    y = np.array([[z == "de", z == "en"] for z in langs], float)
    w = np.linalg.inv(phi.T @ phi + 1e-3 * len(texts) * np.eye(phi.shape[1])) @ phi.T @ y
    unseen = ["the ist", "und der und", "of of it", "xyz das"]
    scores = np.array([[kernel(t, z) for z in marks] for t in unseen]) @ root @ w
    got, best = langid.Classifier(m).predict(unseen)
    assert got == [("de", "en")[k] for k in scores.argmax(1)]
    assert np.allclose(best, scores.max(1).clip(0, 1), atol=1e-4)


def test_scores_equal_the_kernel_written_out():
    m = langid.fit(["the and of", "der die das", "the of it", "und das der"], ["en", "de", "en", "de"], landmarks_per_lang=2)
    grams = lambda t: {t.encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    z = [grams(t) for t in ("der die das", "und das der", "the and of", "the of it")]
    for t in ("the die", "of", "das der die", "zzz"):
        k = np.array([len(grams(t) & g) / np.sqrt(len(grams(t)) * len(g)) for g in z]) @ m.weights
        langs, scores = langid.Classifier(m).predict([t])
        assert langs[0] == m.langs[k.argmax()] and abs(scores[0] - min(1, max(0, k.max()))) < 1e-5
