"""Sharding, hard negatives and periodic runs against plain versions."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import WORD

from evalspark.llm import hard_negatives, periodic_runs, queries, sharding

DOCS = "doc_id bigint, text string"


# ---------------------------------------------------------------- sharding
def plain_home(key, weights):
    text = "" if key is None else str(key)
    draw = {s: int(hashlib.md5(f"{text}:{s}".encode()).hexdigest()[:12], 16) for s in weights}
    return min(weights, key=lambda s: (-math.log((draw[s] + 0.5) / 2**48) / weights[s], s))


@pytest.mark.parametrize("weights", [sharding.equal_weights(16), {3: 1.0, 7: 2.5, 9: 0.25}, {0: 1.0}])
def test_placement(spark, weights):
    keys = [None, *range(400)]
    got = sharding.place(spark.createDataFrame([(k,) for k in keys], "doc_id bigint"), "doc_id", weights).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == {k: plain_home(k, weights) for k in keys}


def test_a_shard_more_only_takes_and_weights_are_kept(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    before = sharding.equal_weights(16)
    moved = sharding.moves(keys, "doc_id", before, sharding.equal_weights(17)).collect()
    assert {r["to_shard"] for r in moved} == {16}
    assert abs(sum(r["n_rows"] for r in moved) - 40_000 / 17) < 200
    assert {r["from_shard"] for r in sharding.moves(keys, "doc_id", before, {s: w for s, w in before.items() if s != 5}).collect()} == {5}
    heavier = sharding.moves(keys, "doc_id", before, before | {4: 2.0}).collect()
    assert {r["to_shard"] for r in heavier} == {4}
    sizes = {r["shard"]: r["n"] for r in sharding.place(keys, "doc_id", {0: 1.0, 1: 3.0}).groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    assert abs(sizes[1] - 30_000) < 500
    with pytest.raises(ValueError):
        sharding.home(keys["doc_id"], {0: 0.0})


def test_slots_have_no_gap_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_PER_ROW", 7)
    rows = [(i % 50 if i % 3 else 5, i % 4) for i in range(900)] + [(None, 1)] * 20
    df = spark.createDataFrame(rows, "k int, shard int")
    got = sharding.slots(df, "shard", ["k"], rows_per_bin=8).collect()
    assert sorted((r["k"] is None, r["k"] or 0, r["shard"]) for r in got) == sorted((k is None, k or 0, s) for k, s in rows)
    for shard in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(s == shard for _, s in rows)))
    assert sharding.slots(df.where("false"), "shard", ["k"]).count() == 0


def test_the_sharding_query_on_odd_documents(spark, tmp_path):
    long = "ü" * 200_000
    rows = [(1, None), (2, ""), (3, long), (4, "a"), (4, "a"), (4, "b"), (None, "a"), (None, None)]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "7 AS slot", "'x' AS law", "1 AS shard").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_sharding"](spark, str(tmp_path)).collect()
    want = []
    for key, text in rows:
        data = (text or "").encode()
        want.append((str(key), len(data) + 1, zlib.crc32(data), plain_home(key, sharding.equal_weights(16)), plain_home(key, sharding.equal_weights(17))))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == sorted(want)
    for shard in {w[3] for w in want}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(w[3] == shard for w in want)))


def test_shards_hold_whole_records(spark, tmp_path):
    rows = [(i, f"text {i}", "extra") for i in range(300)]
    weights = {0: 1.0, 1: 2.0}
    sharding.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string, shard string"), "doc_id", weights, f"{tmp_path}/out", rows_per_file=50)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r["doc_id"], r["text"], r["shard"]) for r in back} == {(i, t, plain_home(i, weights)) for i, t, _ in rows} and len(back) == 300
    with pytest.raises(Exception, match="already exists"):
        sharding.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string, shard string"), "doc_id", weights, f"{tmp_path}/out")


# ---------------------------------------------------------------- periodic runs
def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        j = q
        while j < n:
            if words[j] != words[j - q]:
                j += 1
                continue
            first = j
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - first + q >= max(least, 2 * q):
                found.setdefault((first - q, j - first + q), q)  # q grows: the first period of a stretch is its smallest
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(rng, letters, most):
    words = []
    while len(words) < most:
        if not words or rng.random() < 0.5:
            words.append(f"w{rng.randrange(letters)}")
        else:
            part = words[-rng.randrange(1, min(len(words), 25) + 1):]
            words += (part * rng.randrange(1, 8))[:rng.randrange(1, 80)]
    return words


@pytest.mark.parametrize("least", [2, 5, 12, 30])
def test_runs_match_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [periodic_words(rng, rng.choice([1, 2, 3, 20]), rng.randrange(1, 120)) for _ in range(rng.randrange(1, 4))]
        for words, (size, runs, collapsed) in zip(texts, periodic_runs._worked([" ".join(t).encode() for t in texts], least)):
            want = plain_runs(words, least)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want
            assert size == len(words) and collapsed == plain_collapse(words, want)


def test_lookups_stay_linear_in_repeated_texts(monkeypatch):
    """One word, and long stretches of one word that repeat with another: lookups by word would be quadratic."""
    seen = []
    inner = periodic_runs._stretches

    def counted(name, at, texts, width, lags):
        out = inner(name, at, texts, width, lags)
        seen.append(len(out[0]))
        return out
    monkeypatch.setattr(periodic_runs, "_stretches", counted)
    n = 40_000
    [(_, runs, collapsed)] = periodic_runs._worked([b"a " * n], 12)
    assert [(r["start"], r["length"], r["period"]) for r in runs] == [(0, n, 1)] and collapsed == "a"
    [(_, runs, _)] = periodic_runs._worked([b"a " * 9_999 + b"b " + b"a " * 9_999 + b"b " + b"a " * 9_999 + b"b "], 12)
    assert (0, 30_000, 10_000) in [(r["start"], r["length"], r["period"]) for r in runs]
    assert sum(seen) < 6 * (n + 30_000)


def test_odd_rows_of_the_runs(spark):
    again = "x y z " * 6
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, again), (4, again), (None, again), (5, "Á " * 12), (6, "x y " * 20), (7, "one two")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'k' AS source", "1 AS runs", "'c' AS collapsed", "2 AS n_words")
    got = periodic_runs.periodic_runs(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "source", "n_words", "runs", "collapsed"}
    for row, text in zip(got, [t for _, t in rows]):
        words = WORD.findall(text or "")
        want = plain_runs(words)
        assert [tuple(r) for r in row["runs"]] == want and row["n_words"] == len(words) and row["collapsed"] == plain_collapse(words, want)
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0


def test_the_runs_query_on_planted_texts(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "  ".join(periodic_words(rng, 30, rng.randrange(1, 300))) + rng.choice(["", "\n", " "])) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "a " * 20), (202, " ".join(f"v{i}" for i in range(30_000)))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words, planted = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)], planted + 1
        runs = plain_runs(words) if n < 1000 else []
        r = got[key]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert planted > 5


# ---------------------------------------------------------------- hard negatives
def plain_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    best = {}
    for key, label, v in rows:
        if key is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[key] = min(best.get(key, (label, v)), (label, v))
    whole = {k: (label, [math.floor(scale * x) for x in v]) for k, (label, v) in best.items()}
    out = []
    for a, (label, v) in whole.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, other) for k, (other, w) in whole.items() if k != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, rank, k, -s, -n) for rank, (n, k, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(df, every, **sizes):
    rows = hard_negatives.hard_negatives(df, df["vec_id"] % every == 0, **sizes)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows.collect())


VECTORS = "vec_id bigint, label int, embedding array<double>"


@pytest.mark.parametrize("seed,block,group", [(1, 16, 8), (2, 64, 3), (3, 4096, 1024)])
def test_negatives_match_brute_force(spark, seed, block, group, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCKS_PER_CHUNK", 5)
    monkeypatch.setattr(hard_negatives, "PARTS_PER_PAGE", 2)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(500):
        v = centres[rng.integers(6)] + rng.normal(size=12) * 0.4
        rows.append((int(i), int(rng.integers(4)), (np.round(v, 1) if i % 3 else v).tolist()))
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)]  # equal vectors: ties by id
    want = plain_negatives(rows, lambda a: a % 10 == 0)
    assert len(want) > 300
    assert mined(spark.createDataFrame(rows, VECTORS).repartition(3), 10, block=block, group=group) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.6, 0.1]), (3, 2, [0.7, None]), (4, 2, [0.7, nan]), (5, 2, [inf, 0.0]), (6, None, [0.7, 0.0]), (7, 2, None),
            (None, 2, [0.7, 0.0]), (8, 2, [0.6, 0.1, 0.0]), (9, 1, []), (10, 2, []), (20, 1, []), (11, 2, [0.6, 0.1]), (11, 2, [0.6, 0.1]), (12, 2, [0.8, 0.0]), (12, 2, [0.5, 0.0]),
            (30, 3, [0.0, 0.0]), (31, 3, [0.0, 0.0]), (40, 5, [-1.0, 0.0]), (41, 5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "'x' AS rank", "2 AS size", "3 AS h", "4 AS data")
    want = plain_negatives(rows, lambda a: a % 10 == 0)
    assert any(r[0] == 30 for r in want) and any(r[0] == 20 for r in want)
    assert mined(df, 10) == want
    assert mined(df.where("false"), 10) == []
    assert mined(df.where("vec_id = 1"), 10) == [] and mined(df.where("vec_id = 0"), 10) == []


def test_large_components(spark):
    """Scores beyond single precision stay whole; components near the largest double do not stop the job."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-30_000, 30_000, 6)]) for i in range(80)]
    assert mined(spark.createDataFrame(rows, VECTORS), 10, block=20) == plain_negatives(rows, lambda a: a % 10 == 0)
    huge = [(i, i % 2, [1e307 * (i % 5), -1e200]) for i in range(20)]
    mined(spark.createDataFrame(huge, VECTORS), 10)


def test_zones_leave_blocks_unread(spark):
    """Separate clusters: most blocks cannot hold a row for a group's windows, and the bounds say so."""
    rng = np.random.default_rng(5)
    far = np.eye(8)[np.arange(4000) % 8] * 1.0 + rng.normal(size=(4000, 8)) * 0.01
    rows = [(i, int(i // 8 % 3), v.tolist()) for i, v in enumerate(far)]
    read = []
    inner = hard_negatives._read
    total = []

    def counted(chosen, groups, blocks, same, k):
        read.append(chosen.count())
        total.append(groups.count() * blocks.count())
        return inner(chosen, groups, blocks, same, k)
    hard_negatives._read = counted
    try:
        assert mined(spark.createDataFrame(rows, VECTORS), 50, block=50, group=10) == plain_negatives(rows, lambda a: a % 50 == 0)
    finally:
        hard_negatives._read = inner
    assert sum(read) < 0.6 * sum(total) / 2


def test_the_curve_passes_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    h = hard_negatives.hilbert_index(cells, 3)
    assert sorted(h.tolist()) == list(range(512))
    path = cells[np.argsort(h)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
