"""Classifiers by held-out accuracy, queries against their SQL, the pipeline against brute force."""
import os

import pytest
from helpers import jaccard_groups
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import queries as Q
from evalspark.llm import quality, toxicity

FOLDER, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no dataset")


def labelled(n=600):
    rows, labels = [], []
    for i in range(n):
        clean = i % 3 > 0
        rows.append((i, " ".join((f"word{(i * 7 + j) % 90}" if clean else f"WORD{(i + j) % 90}!!!") for j in range(30)) + (" vile idiocy" if i % 5 == 0 else "")))
        labels.append((i, int(clean), int(i % 5 == 0)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (6, 7, 7)], "doc_id bigint, quality int, toxic int")
    w = quality.fit(docs, marks.where(~quality.held_out(F.col("doc_id"))))
    got = quality.score(docs.where(quality.held_out(F.col("doc_id"))), w).collect()
    assert len(got) > 100 and sum((r["score"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in got) >= 0.97 * len(got)
    odd = quality.score(spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id bigint, text string").withColumn("label", F.lit(1)), w).collect()
    assert len(odd) == 4 and len({r["score"] for r in odd if not r["text"]}) == 1 and all(0 <= r["score"] <= 1 for r in odd)
    none = quality.fit(docs, marks.limit(0))
    assert {r["score"] for r in quality.score(docs.limit(3), none).collect()} == {0.5}
    assert quality.score(docs.limit(0), w).count() == 0


def test_toxicity_chain(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    w = toxicity.fit(docs, spark.createDataFrame(labels[:400], "doc_id bigint, quality int, toxic int"))
    got = toxicity.score(docs.where("doc_id >= 400"), w).collect()
    assert sum((r["p_toxic"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in got) >= 0.97 * len(got)
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (None, "!")], "doc_id bigint, text string"), w).collect()
    assert len(odd) == 3 and all(r["p_toxic"] < 0.5 for r in odd)
    nothing = toxicity.score(docs.limit(2), toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"))).collect()
    assert {r["p_dense"] for r in nothing} == {0.5}


@needs_data
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, name):
    assert compare(Q.QUERIES[name](spark, SMALL), connect(SMALL), Q.ORACLES[name]) is None


@needs_data
def test_classifiers_on_the_given_labels(spark):
    marks = Q.table(spark, FOLDER, "labels")
    scored = Q.op10_quality(spark, FOLDER).join(marks, "doc_id").where("held_out")
    right, n = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.93
    tox = Q.op9_toxicity(spark, FOLDER).withColumnRenamed("toxic", "said").join(marks, "doc_id")
    assert tox.agg(F.avg((F.col("said") == F.col("toxic")).cast("int"))).first()[0] > 0.9


@needs_data
def test_join_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in Q.table(spark, SMALL, "documents").collect()]
    want, sizes = jaccard_groups(rows, 4, 85, 100)
    got = Q.op7_ngram_jaccard(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], want[i]) for i in want}


@needs_data
def test_pipeline_stages_take_effect(spark):
    docs = Q.table(spark, SMALL, "documents").withColumn("extra", F.lit(1))
    by_name = dict(corpus_pipeline.STAGES)
    good = by_name["quality"](spark, docs, SMALL)
    assert good.columns == corpus_pipeline.COLUMNS and 0 < good.count() < docs.count()
    lines = by_name["shared_lines"](spark, docs, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    places = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            places.setdefault(line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), set()).add(i)
    common = {k for k, v in places.items() if k and len(v) >= 10}
    for r in lines:
        want = "\n".join(x for x in texts[r["doc_id"]].split("\n") if x.strip(" \t\n\x0b\x0c\r").translate(
            str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) not in common)
        assert r["text"] == want and r["n_chars"] == len(want)
    groups, _ = jaccard_groups(list(texts.items()), 5, 80, 100)
    one = by_name["near_copies"](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in one} == {i for i, c in groups.items() if i == c}
    clean = {r["doc_id"] for r in by_name["decontamination"](spark, docs, SMALL).collect()}
    passages = [" ".join(r["text"].split()) for r in Q.table(spark, SMALL, "benchmark").collect()]
    dirty = {i for i, t in texts.items() if any(p in " ".join(t.split()) for p in passages)}
    assert not clean & dirty and len(clean) >= 0.9 * (len(texts) - len(dirty))
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_rows_without_an_id_or_with_a_shared_one_are_filtered_by_their_own_text(spark, tmp_path):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "pqrstu"]
    rows = [(1, texts[0]), (None, texts[0] + " end"), (None, texts[1]), (None, texts[1]), (2, texts[2]), (2, texts[2]), (2, texts[2] + " end"),
            (3, texts[0] + " more"), (3, texts[3]), (None, texts[4]), (4, texts[4] + " end"), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars")
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert left.columns == corpus_pipeline.COLUMNS
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    two = [x for x in got if x[0] == 2]
    assert len(two) == 1 and two[0] in rows
    want = [(1, texts[0]), (None, texts[1]), (3, texts[3]), (4, texts[4] + " end"), (4, ""), (4, ""), (5, None)]
    assert sorted((x for x in got if x[0] != 2), key=str) == sorted(want, key=str)
    spark.createDataFrame([(0, texts[0]), (1, texts[1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(clean, key=str) == sorted((x for x in rows if not x[1] or x[1][0] in "rstu"), key=str)
