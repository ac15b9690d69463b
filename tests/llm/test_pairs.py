"""Near-duplicate operators against brute force."""
import numpy as np
import pytest
from helpers import groups, jaccard_groups, near_copies

from evalspark.llm import jaccard, near_embeddings, textcodes
from evalspark.llm.shared import components

DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_groups_match_brute_force(spark, k, num, den):
    rows = near_copies(seed=k)
    want, sizes = jaccard_groups(rows, k, num, den)
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS), k=k, num=num, den=den).collect()
    assert {r["id"]: r["component"] for r in got} == want
    assert {r["id"]: r["n_shingles"] for r in got} == sizes


def test_a_large_group_of_near_copies(spark):
    """Longer than a run and than a block of sets, so that chains and tiles are used."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(700):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    want, _ = jaccard_groups(rows, 4, 85, 100)
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS), k=4).collect()
    assert {r["id"]: r["component"] for r in got} == want


@pytest.mark.parametrize("block", [512, 20])
def test_documents_that_share_a_passage_are_not_chained(spark, monkeypatch, block):
    """One passage in all documents makes their runs long; candidate groups stay as small as the true ones, and no link is lost.

    Small blocks make the long runs worth cutting by pairs of signatures.
    """
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    cuts, signature_pairs = [], jaccard.signature_pairs

    def cut(rows, bands):
        cuts.append(rows.count())
        return signature_pairs(rows, bands)
    monkeypatch.setattr(jaccard, "signature_pairs", cut)
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(70)]
    own = [[f"o{i}_{j}" for j in range(70)] for i in range(300)]
    rows = [(i, " ".join(passage + words)) for i, words in enumerate(own)]
    for i in range(40):  # copies of one document, and pairs of others
        words = passage + own[0 if i < 25 else i]
        words[int(rng.integers(0, 140))] = f"c{i}"
        rows.append((1_000 + i, " ".join(words)))
    want, _ = jaccard_groups(rows, 5, 80, 100)
    largest = max(sum(c == g for c in want.values()) for g in set(want.values()))
    sizes, tiles_of = [], jaccard.tiles_of

    def counted(members, *rest):
        sizes.append(max([r["count"] for r in members.groupBy("grp").count().collect()], default=0))
        return tiles_of(members, *rest)
    monkeypatch.setattr(jaccard, "tiles_of", counted)
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS), k=5, num=80, den=100).collect()
    assert {r["id"]: r["component"] for r in got} == want
    assert largest == 26 and len(sizes) == 1 and sizes[0] <= 2 * largest
    assert len(cuts) == 1 and (cuts[0] > 0) == (block == 20)


def test_rows_of_long_runs_that_no_pair_needs_are_not_compared(spark, monkeypatch):
    """Pairs share several long runs, so a node stays out of its longest ones; every pair still meets."""
    made, compared = [], []
    long_rows, run_tiles = jaccard.long_rows, jaccard.run_tiles

    def long(found, bands):
        made.append(long_rows(found, bands).count())
        return long_rows(found, bands)

    def tiles(rows, labels):
        compared.append(rows.count())
        return run_tiles(rows, labels)
    monkeypatch.setattr(jaccard, "long_rows", long)
    monkeypatch.setattr(jaccard, "run_tiles", tiles)
    rng = np.random.default_rng(17)
    passages = [[f"p{j}_{i}" for i in range(40)] for j in range(5)]
    rows = [(i, " ".join(sum((passages[j] for j in sorted(rng.choice(5, 3, replace=False))), []) + [f"o{i}_{j}" for j in range(60)])) for i in range(200)]
    for i in range(60):
        words = rows[int(rng.integers(0, 100))][1].split()
        words[int(rng.integers(0, len(words)))] = f"c{i}"
        rows.append((1_000 + i, " ".join(words)))
    want, _ = jaccard_groups(rows, 5, 80, 100)
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS), k=5, num=80, den=100).collect()
    assert {r["id"]: r["component"] for r in got} == want
    assert len(made) == len(compared) == 1 and 0 < compared[0] < 0.8 * made[0]


def test_rows_that_share_signatures_meet_in_first_ones(spark):
    """Rows of three runs at least in common have one where both are first, of the runs not to be cut if they share one of those."""
    rng = np.random.default_rng(23)
    bands = jaccard.Bands(80, 100, 4000)
    tag = int(np.flatnonzero(bands.common >= 3)[0])
    common = int(bands.common[tag])
    has = {n: {int(x) for x in rng.choice(30, int(rng.integers(1, 15)), replace=False)} for n in range(60)}
    rows = spark.createDataFrame([(s, n, tag, sum(s in x for x in has.values()), len(has[n])) for n in has for s in has[n]], "sig long, node long, tag int, run long, held long")
    cut = spark.createDataFrame([(s,) for s in range(0, 30, 3)], "sig long")
    left, direct = (x.collect() for x in jaccard.by_cost(rows, cut, bands))
    met = {n: {r["sig"] for r in direct if r["node"] == n} for n in has}
    for a in has:
        for b in range(a):
            shared = has[a] & has[b]
            if len(shared) >= common and any(s % 3 for s in shared):
                assert met[a] & met[b], (a, b)
    assert {(r["sig"], r["node"]) for r in left} == {(s, n) for n in has for s in has[n] if s % 3 == 0}
    assert sum(map(len, met.values())) < sum(sum(s % 3 > 0 for s in x) for x in has.values())


def test_near_copies_at_the_upper_end_of_the_top_band(spark):
    """More than a run of near copies that also sign for the band above the table's largest set."""
    low = jaccard.Bands(85, 100, 1000).low
    size = int(low[low > 80][0]) - 1
    base = [f"b{i}" for i in range(size + 3)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(30)] + [(40, "one two three four five")]
    want, sizes = jaccard_groups(rows, 4, 85, 100)
    assert max(sizes.values()) == size and set(want.values()) == {0, 40}
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS), k=4).collect()
    assert {r["id"]: r["component"] for r in got} == want


def test_odd_rows_of_the_join(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One two"), (5, "one  TWO"), (None, "one two"), (6, long), (7, long + " end"), (6, long), (8, "Á b c d"), (9, "á b c d")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS id", "2 AS node", "'x' AS bits")).collect()
    found = {r["id"]: (r["n_shingles"], r["component"]) for r in got}
    assert len(got) == len(rows)
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[4] == (1, 4) and found[5] == (1, 4) and found[None] == (1, None)
    assert found[6] == (29_997, 6) and found[7] == (29_998, 6)
    assert found[8][1] == 8 and found[9][1] == 9  # only A-Z are lower-cased
    assert jaccard.similar_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    bands = jaccard.Bands(85, 100, 4000)
    for size in [2, 5, 7, 13, 40, 150, 900, 2500]:
        for _ in range(30):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64)
            drop = int(rng.integers(0, max(1, int(size * 0.15)) + 1))
            add = int(rng.integers(0, max(1, int(size * 0.1)) + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
            common = size - drop
            if not common or 100 * common < 85 * (size + add) or (not drop and not add):
                continue
            a, b = np.sort(a), np.sort(b)
            sig, row = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
            assert set(sig[row == 0]) & set(sig[row == 1]), (size, drop, add)


def test_words_do_not_depend_on_segments(monkeypatch):
    import pyarrow as pa
    column = pa.array(["alpha beta", None, "", "gamma\tdelta " * 50, "x" * 500 + " y", "é ü"])
    whole = textcodes.words(*textcodes.utf8(column))
    monkeypatch.setattr(textcodes, "SEGMENT", 64)
    cut = textcodes.words(*textcodes.utf8(column))
    assert all((a == b).all() for a, b in zip(whole, cut))
    part = textcodes.words(*textcodes.utf8(column.slice(3, 2)))
    assert (part[0] == whole[0][whole[3][3]:whole[3][5]]).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(600, 500 + i) for i in range(30)]
    nodes = {x for e in links for x in e if e[0] != e[1]}
    want = groups(nodes, links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    vectors = np.concatenate([base, base[:15] + rng.normal(size=(15, 24)) * 0.3, base[:5] * 3, rng.normal(size=(60, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, rows[3][1]), (908, [1e300] * 24), (909, [1e-300] * 24)]
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    ids = [i for i, _ in rows]
    want = groups(ids, links)
    count = {i: sum(i in e for e in links) for i in ids}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "7 AS id", "'a' AS node")
    got = near_embeddings.embedding_links(df, block=16).collect()
    assert {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in got} == {i: (count[i], want[i], want[i] == i) for i in ids}
    empty = near_embeddings.embedding_links(df.limit(0))
    assert empty.count() == 0
    none = near_embeddings.embedding_links(spark.createDataFrame([(None, [1.0]), (5, None)], "vec_id bigint, embedding array<double>")).collect()
    assert sorted(((r["id"], r["n_links"], r["component"], r["kept"]) for r in none), key=str) == [(5, 0, 5, True), (None, 0, None, False)]


@pytest.mark.parametrize("full,held", [(1 << 20, 128 << 20), (30, 1)])
def test_blocks_of_vectors_are_not_shuffled_for_their_tiles(spark, monkeypatch, full, held):
    """Many blocks in many groups: every pair of blocks meets once, without a shuffle or broadcast of their vectors."""
    plans, kept = [], near_embeddings.kept

    def seen(df, name):
        if name == "found":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)
    monkeypatch.setattr(near_embeddings, "kept", seen)
    for name, value in (("GROUP", 1), ("FULL", full), ("HELD", held)):
        monkeypatch.setattr(near_embeddings, name, value, raising=False)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 5))
    vectors = np.concatenate([base[rng.integers(0, 30, 260)] + rng.normal(size=(260, 5)) * 0.2, base])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1_000 + i, vectors[i % 7].tolist()) for i in range(20)] + [(1_000, vectors[0].tolist())]
    unit = {i: np.array(v) / np.sqrt(np.dot(v, v)) for i, v in rows}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9]
    want, count = groups(unit, links), {i: 0 for i in unit}
    for e in links:
        for i in e:
            count[i] += 1
    got = near_embeddings.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block=16).collect()
    assert len(got) == len(rows) and {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in got} == {i: (count[i], want[i], want[i] == i) for i in unit}
    assert len(plans) == 1 and "Exchange" not in plans[0]
