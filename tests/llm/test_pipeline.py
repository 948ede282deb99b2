import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from geomotif.llm import queries

from .test_operators import DOCS, ODD, check_packing, clashing, near_texts, sets_of

DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(11)
    words = {"en": "the cat and dog were in this house", "de": "der hund und die katze sind im haus"}
    rows = []
    for i, t in enumerate(near_texts(3, 60) + ODD):
        lang = ("en", "de")[i % 2]
        if i < 60:
            t = " ".join(rng.choices(words[lang].split(), k=8)) + " " + t
        rows.append((i, t, lang if i < 60 else None, "s", len(t or "")))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_in_turn(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang_pred", F.lit("mine"))
    have = {r.doc_id: r for r in d.collect()}
    one = cp.language_id(spark, d, folder)
    kept = {r.doc_id: r for r in one.collect()}
    assert one.columns == d.columns and all(kept[i] == have[i] for i in kept)
    assert set(range(60)) <= set(kept) and not {60, 61, 62} & set(kept)  # null, empty and blank texts go
    two = cp.ngram_jaccard_join(spark, one, folder)
    left = {r.doc_id for r in two.collect()}
    sets = {i: sets_of(kept[i].text, 5) for i in kept}
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    for i in kept:  # what went has a chain of near copies to what stayed; no two near ones stayed
        if i in left:
            assert not any(near(i, j) for j in left if j < i)
        else:
            seen, todo = {i}, [i]
            while todo:
                x = todo.pop()
                new = {j for j in kept if j not in seen and near(x, j)}
                seen |= new
                todo += new
            assert len(seen & left) == 1 and min(seen) in left
    three = cp.mixing_to_targets(spark, two, folder)
    final = {r.doc_id: r for r in three.collect()}
    assert three.columns == d.columns and set(final) <= left
    rows = cp.best_fit_packing(spark, three, folder).collect()
    assert {r.doc_id for r in rows} == set(final)


def test_run_packs_what_the_stages_keep(spark, folder):
    rows = cp.run(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    names = {n: k for k, n in enumerate(sorted({r.doc_id for r in rows}))}
    moved = [type("R", (), {**r.asDict(), "doc_id": names[r.doc_id]}) for r in rows]
    check_packing(moved, [texts[n] for n in names], 1024)


def test_repeated_rows_and_missing_ids(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20")
    more = clashing(d.unionByName(d).unionByName(d.limit(2).withColumn("doc_id", F.lit(None).cast("long"))))
    two = cp.ngram_jaccard_join(spark, more, folder)
    assert two.where("doc_id is null").count() == 2 and two.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    for f in (cp.language_id, cp.mixing_to_targets):
        assert f(spark, more, folder).columns == more.columns


def test_different_texts_of_one_id_stay(spark, tmp_path):
    a, b, c = "a b c d e f g h", "q r s t u v w x y", "one two three four five six"
    rows = [(7, a), (7, b), (7, c), (3, b), (7, a), (8, c), (None, a)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = cp.ngram_jaccard_join(spark, d, str(tmp_path))
    assert out.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, b), (7, a), (7, c), (None, a)], key=str)


@pytest.mark.parametrize("shares", [(85, 3, 12), (5, 80, 15), (60, 39.5, 0.5)])
def test_mixing_keeps_clean_documents(spark, tmp_path, shares):
    rng = random.Random(12)
    vocabulary = {"high": "lorem ipsum dolor sit amet", "low": "zzz |||| %%% ### $$", "toxic": "vile bad nasty awful gross"}
    kinds = rng.choices(list(vocabulary), shares, k=1200)
    rows = [(i, " ".join(rng.choices(vocabulary[kind].split(), k=rng.randint(30, 60))), "en", "s", 0) for i, kind in enumerate(kinds)]
    labels = [(i, int(kind != "low"), int(kind == "toxic")) for i, kind in enumerate(kinds) if i % 2]
    rows.append((1200, "vile bad nasty awful gross " * 9, "en", "s", 0))  # labelled as clean, whatever it looks like
    labels.append((1200, 1, 0))
    kinds.append("high")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id: len(r.text.split()) for r in cp.mixing_to_targets(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()}
    assert all(i in kept for i, kind in enumerate(kinds) if kind != "toxic")
    toxic = sum(n for i, n in kept.items() if kinds[i] == "toxic") / sum(kept.values())
    assert toxic < 0.03 and (shares[2] > 2) == (toxic > 0.01)


def test_empty_tables(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, f in cp.STAGES[:-1]:
        out = f(spark, d, folder)
        assert out.columns == d.columns and out.count() == 0
    assert cp.best_fit_packing(spark, d, folder).count() == 0
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard_join", "mixing", "best_fit_packing"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cols = ", ".join(sorted(df.columns))
    want = con.sql(f"SELECT {cols} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols.split(", ")).collect())) == sorted(want)
