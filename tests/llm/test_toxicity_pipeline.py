import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from wavehold.llm import mixing, toxicity
from wavehold.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
CLEAN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
CUES = ("vileone", "vileword", "nastything", "grimslur")


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = random.Random(8), [], []
    for i in range(1500):
        sentences = [" ".join(rng.choices(CLEAN, k=rng.randint(3, 12))) for _ in range(rng.randint(1, 40))]
        y = int(rng.random() < 0.2)
        if y:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(CUES) + rng.choice(["", "s", "ing"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, y))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_documents_and_their_sentences(labelled):
    docs, labels = labelled
    model = toxicity.fit_tables(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 400
    right = [(r.score >= 0.7) == bool(r.toxic) for r in rows]
    assert sum(right) / len(right) > 0.98
    for r in rows:
        for s in r.offending:  # what is located is the sentence with the cue
            assert any(c in r.text[s.start : s.end] for c in CUES)
    assert all(r.offending for r in rows if r.toxic and r.score >= 0.7)


def test_no_held_out_label_is_learned(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_tables(docs, flipped) == toxicity.fit_tables(docs, labels)
    got = {r.doc_id: r.h for r in spark.range(200).select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


def test_odd_rows_score(spark, odd, none, labelled):
    docs, labels = labelled
    model = toxicity.fit_tables(docs, labels)
    got = toxicity.score(odd, model)
    assert set(got.columns) == set(odd.columns) | {"offending"} and {r.score for r in got.collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0
    tricky = spark.createDataFrame([(1, "A İ VILEONE here. fine"), (2, "VileOne " * 20_000), (3, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in toxicity.score(tricky, model).collect()}
    assert rows[1].score > 0.7 and "VILEONE" in "A İ VILEONE here. fine"[rows[1].offending[0].start : rows[1].offending[0].end]
    assert rows[2].score > 0.99 and rows[3].score == 0


def test_degenerate_labels(spark, labelled):
    docs, labels = labelled
    assert toxicity.fit_tables(docs, labels.where("toxic = 0")).weights == {} and toxicity.fit_tables(docs, labels.where("false")).weights == {}
    assert toxicity.fit_tables(docs.where("false"), labels).weights == {}
    mess = labels.union(spark.createDataFrame([(None, 1), (3, None), (10_000, 1)], "doc_id bigint, toxic int")).union(labels)
    assert toxicity.fit_tables(docs, mess) == toxicity.fit_tables(docs, labels)
    bounded = toxicity.training_rows(labels, F.lit(True), 100)
    assert bounded.count() < 160


def test_long_clean_texts_stay_clean(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit_tables(docs, labels)
    rng = random.Random(5)
    text = ". ".join(" ".join(rng.choices(CLEAN, k=9)) for _ in range(20_000))
    assert toxicity.score(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first().score < 0.1


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(names, cur.fetchall())


def test_registered_once_each():
    mine = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in mine) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(mine) == set(QUERIES) and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_pipeline_stages(spark, near_groups, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(at)
        out = spark.read.parquet(at)
        after = out.toPandas()
        texts = dict(zip(before.doc_id, before.text, strict=True))
        if name != "bpe":
            assert out.columns == docs.columns
            assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique
        if name == "toxicity":
            model = toxicity.fit_tables(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
            assert set(after.doc_id) == {i for i, s in scores.items() if s < corpus_pipeline.REJECT}
        elif name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                key = "".join(c for c in t if c not in " \t\n\v\f\r")
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), i))
            assert set(after.doc_id) == {i for _, i in best.values()}
        elif name == "near_dedup":
            group, _ = near_groups(texts, 80)
            assert set(after.doc_id) == {i for i, g in group.items() if i == g}
        elif name == "mixing":
            taken = {r.doc_id for r in mixing.mix(docs, share=(1, 2), epochs=1).where("copies > 0").collect()}
            assert set(after.doc_id) == taken
            words = lambda f: sum(len(t.split()) for t in f.text)
            assert abs(words(after) / words(before) - 0.5) < 0.2
        else:
            assert list(after.doc_id.sort_values()) == list(before.doc_id.sort_values()) and after.round_trip.all()
            assert all(len(r.ids) == r.n_tokens for r in after.itertuples())
        docs, before = out, after
    assert k == 4


def test_whole_pipeline_of_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert os.path.isdir(tmp_path)
