import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import articles as A
from corpuslens.operators import entities as E
from corpuslens.operators import frequency as Q
from corpuslens.operators import project as P
from corpuslens.operators import spans as S
from corpuslens.plans.pipeline import entities_of
from corpuslens.sources import readers, sinks
from corpuslens.streaming import progress

TERMS = {"Transformer": "MODEL", "BERT": "MODEL", "accuracy": "METRIC", "deep learning": "TECHNIQUE"}


def points(spark, rows):
    return spark.createDataFrame(rows, "id int, x double, y double, label string, entity string, sentence_id int, sentence_text string")


ROWS = [
    (0, 1.0, 2.0, "MODEL", "BERT", 0, "BERT and bert"),
    (1, 3.0, 4.0, "METRIC", " bert ", 0, "BERT and bert"),
    (2, None, 0.0, "METRIC", "Bert", 1, "TITLE: Bert"),
    (3, 0.0, 0.0, "MODEL", "bert", 2, "bert"),
    (4, 0.0, 0.0, "TASK", "  ", 2, "bert"),
]


def test_frequency_first_form_and_ties(spark):
    rows = Q.entity_frequency(points(spark, ROWS)).collect()
    assert [tuple(r) for r in rows] == [("bert", "BERT", 4, "MODEL", 1.0, 1.5)]
    assert Q.max_frequency(points(spark, ROWS)).first()[0] == 4
    assert Q.max_frequency(points(spark, ROWS).limit(0)).first()[0] == 1
    assert Q.paragraphs_with_entities(points(spark, ROWS)).first()[0] == 2
    assert Q.expanded(points(spark, ROWS), "bert").select("label").distinct().first()[0] == "MODEL"
    assert {r["label"]: r["colour"] for r in Q.with_colours(points(spark, ROWS)).collect()}["TASK"] == "#666"


@pytest.mark.parametrize(("f", "ref", "size"), [(1, 30, 9), (2, 30, 16), (3, 30, 28.8055), (5, 30, 37.7544), (10, 30, 47.3736), (30, 30, 60), (50, 30, 60), (2, 2, 16)])
def test_bubble_size(one, f, ref, size):
    assert one(P.bubble_size("f", "r"), f=f, r=ref) == pytest.approx(size, abs=1e-4)


@pytest.mark.parametrize(("done", "percent"), [(1, 22), (2, 40), (3, 57), (4, 75)])
def test_progress_percent(one, done, percent):
    assert one(P.progress_percent("d", "t"), d=done, t=4) == percent


def test_texts_to_entities(spark):
    rows, results = entities_of(readers.texts_frame(spark), TERMS)
    got = rows.orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(got)))
    assert all(r["sentence_text"][r["start"] : r["end"]] == r["entity"] for r in got)
    assert [r["entity"] for r in got][:2] == ["Transformer", "BERT"]
    assert results.count() == 4


def test_islands(spark):
    tags = ["B-MODEL", "I-MODEL", "O", "I-MODEL", "B-MODEL", "I-METRIC"]
    rows = spark.createDataFrame([(1, i, t, 0.5 + i, i, i + 1) for i, t in enumerate(tags)], "d int, k int, tag string, score double, start int, end int")
    got = sorted((r["start"], r["end"], r["entity_group"], r["score"]) for r in E.tag_islands(rows, ["d"]).collect())
    assert got == [(0, 2, "MODEL", 1.0), (3, 4, "MODEL", 3.5), (4, 5, "MODEL", 4.5), (5, 6, "METRIC", 5.5)]


def test_alignment_and_pooling(spark):
    ents = spark.createDataFrame([(1, 0, 5), (1, 6, 7)], "c int, start int, end int")
    toks = spark.createDataFrame([(1, 0, 2, [1.0, 0.0]), (1, 2, 5, [3.0, 2.0]), (1, 5, 5, [9.0, 9.0]), (1, 4, 6, [9.0, 9.0])], "c int, s int, e int, h array<double>")
    rows = E.mean_pooled(E.contained_tokens(ents, toks, ["c"]), ["c", "start"], "h").collect()
    assert [(r["start"], r["embedding"]) for r in rows] == [(0, [2.0, 1.0])]


def test_plan_has_an_equi_join(spark):
    ents = spark.createDataFrame([(1, 0, 5)], "c int, start int, end int")
    toks = spark.createDataFrame([(1, 0, 2)], "c int, s int, e int")
    assert "NestedLoop" not in E.contained_tokens(ents, toks, ["c"])._jdf.queryExecution().toString()


def test_spans(spark):
    row = (
        spark.createDataFrame([("The Transformer T", [(0, "MODEL", "T"), (1, "MODEL", "Transformer"), (2, "X", "T"), (3, "X", "T")])], "t string, e array<struct<id:int,label:string,entity:string>>")
        .select("t", S.assigned_spans("t", "e").alias("r"))
        .select("r", S.highlighted("t", "r").alias("h"))
        .first()
    )
    assert [(r["start"], r["end"], r["id"]) for r in row["r"]] == [(0, 1, 0), (4, 15, 1), (16, 17, 2)]
    assert row["h"].startswith('<span class="entity model" data-id="0">T</span>he <span')
    assert row["h"].replace("</span>", "").count("<span") == 3


def test_occurrences(one):
    assert one(S.occurrences_of("t", "u"), t="aXaXXa", u="X") == [1, 3, 4]
    assert one(S.occurrences_of("t", "u"), t="aaa", u="aa") == [0]
    assert one(S.occurrences_of("t", "u"), t="a\\Eb\\Ec", u="\\E") == [1, 4]
    assert one(S.occurrences_of("t", "u"), t="abc", u="") == []


def vectors(spark, n=30, d=6):
    x = np.random.default_rng(1).normal(size=(n, d)) * np.arange(1, d + 1)
    x[:, 0] = 3.0
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")


def test_pca_is_the_svd(spark):
    x, df = vectors(spark)
    z = x - x.mean(0)
    z = z / np.where(x.std(0) > 0, x.std(0), 1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    got = np.array([[r["x"], r["y"]] for r in P.pca_points(df, "embedding").orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2]), atol=1e-8)
    assert P.pca_points(df.limit(1), "embedding").select("x", "y").first() == (0.0, 0.0)
    assert P.pca_points(df.limit(0), "embedding").count() == 0


def test_tsne_keeps_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 5)), rng.normal(5, 0.1, (20, 5))])
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "a int, id int, v array<double>")
    y = np.array([[r["x"], r["y"]] for r in P.tsne_points(df, "v", "a", "id").orderBy("id").collect()])
    near = [np.argsort(((y - p) ** 2).sum(1))[1:6] for p in y]
    assert sum((n < 20).all() == (i < 20) for i, n in enumerate(near)) >= 36
    assert P.tsne_points(df.where("id = 0"), "v", "a", "id").select("x", "y").first() == (0.0, 0.0)


def test_tsne_of_a_large_article(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4, (12, 8))
    x = np.concatenate([rng.normal(c, 0.1, (50, 8)) for c in centres])
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "a int, id int, v array<double>")
    y = np.array([[r["x"], r["y"]] for r in P.tsne_points(df, "v", "a", "id").orderBy("id").collect()])
    first = np.array([[r["x"], r["y"]] for r in P.pca_points(df, "v").orderBy("id").collect()])
    assert len(y) == 600 and not np.allclose(np.abs(y), np.abs(first), atol=1e-3)
    near = [np.argsort(((y - p) ** 2).sum(1))[1:6] // 50 for p in y]
    assert sum((n == i // 50).all() for i, n in enumerate(near)) >= 580
    # far apart beyond what a linear projection gives: local neighbours are kept, too
    true = [set(np.argsort(((x - p) ** 2).sum(1))[1:6]) for p in x]
    kept = lambda z: sum(len(t & set(np.argsort(((z - z[i]) ** 2).sum(1))[1:6])) for i, t in enumerate(true))
    assert kept(y) > kept(first)


def test_block_repulsion_is_the_exact_one():
    y = np.random.default_rng(2).normal(0, 20, (700, 2))
    d = y[:, None] - y[None]
    w = 1 / (1 + (d * d).sum(-1))
    np.fill_diagonal(w, 0)
    force, total = P.repulsion(y)
    assert abs(total / w.sum() - 1) < 1e-4 and np.allclose(force, ((w * w)[..., None] * d).sum(1), atol=1e-3)


def test_extent_and_nearest(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 2.0), (2, None, 9.0)], "id int, x double, y double")
    assert tuple(P.axis_extent(df).first()) == (0.0, 1.0, 2.0, 9.0)
    assert tuple(P.axis_extent(df.limit(0)).first()) == (None,) * 4
    assert P.nearest(df, 1.0, 2.5, 10.0).first()["id"] == 0


def test_articles(spark, one):
    r = A.record("a/b/My.TXT", "/lib")
    assert r["original_name"] == "My.TXT" and r["status"] == "uploaded" and r["source_path"].startswith("/lib/article_id=")
    with pytest.raises(ValueError):
        A.record("x.exe", "/lib")
    log = A.records_frame(spark, [r | {"updated_at": "1"}, r | {"updated_at": "2", "status": "processed"}])
    assert A.latest(log, ["id"], "updated_at").first()["status"] == "processed"
    assert one(A.percent_of("p", "s"), p=None, s="ner") == 60
    assert one(A.percent_of("p", "s"), p=None, s="else") == 50
    assert one(A.allowed_step("b", "a"), b=None, a="uploaded") is True
    assert one(A.allowed_step("b", "a"), b="processed", a="uploaded") is False


def test_library(spark, tmp_path):
    root = str(tmp_path)
    r = A.record("x.txt", root)
    A.records_frame(spark, [r | {"updated_at": "1", "status": "processed"}]).write.parquet(f"{root}/records")
    spark.createDataFrame([A.progress_row(r["id"], 1, "ner", None), A.progress_row(r["id"], 2, "completed", 100)], readers.schemas.PROGRESS).write.parquet(f"{root}/progress")
    spark.createDataFrame([(r["id"], "TITLE: Hello you\nx")], "article_id string, text string").write.parquet(f"{root}/cleaned")
    emb = [(i, [float(i), float(i * i)], "MODEL", f"e{i}", 0, 0, "s", r["id"]) for i in range(4)]
    spark.createDataFrame(emb, "id long, embedding array<double>, label string, entity string, text_index int, sentence_id int, sentence_text string, article_id string").write.parquet(f"{root}/embeddings")
    spark.createDataFrame([], readers.schemas.POINT).withColumn("article_id", F.lit("none")).write.parquet(f"{root}/points")
    lib = A.Library(spark, root)
    assert lib.list_articles().count() == 0
    assert lib.points(r["id"]).count() == 4  # projected anew
    assert lib.list_articles().count() == 1
    meta = lib.meta(r["id"]).first()
    assert meta["title"] == "Hello you" and meta["progress"]["percent"] == 100
    with pytest.raises(KeyError):
        lib.ner(r["id"])


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("TITLE: T\n\none\n\ntwo")
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF")
    files = readers.read_texts(spark, str(tmp_path / "in")).withColumn("doc_id", F.lit(1))
    texts = readers.article_texts(files)
    assert [r["text"] for r in texts.orderBy("text_index").collect()] == ["TITLE: T", "one", "two"]
    assert sinks.joined_paragraphs(texts).first()["text"] == "TITLE: T\n\none\n\ntwo\n\n"
    assert files.select(readers.source_type("path")).first()[0] == "txt"
    sinks.write_json(texts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    (tmp_path / "ner.json").write_text(json.dumps([{"text": "T", "entities": [{"entity_group": "MODEL", "score": 0.5, "word": "t", "start": 0, "end": 1}]}]))
    assert readers.read_ner_results(spark, str(tmp_path / "ner.json")).first()["entities"][0]["score"] == 0.5
    np.savez(tmp_path / "e.npz", embeddings=np.ones((2, 3), "f4"), labels=["A", "B"], texts=["x", "y"], text_index=[0, 0], sentence_texts=["s", "s"], sentence_ids=[0, 0])
    assert [tuple(r) for r in readers.import_npz(spark, str(tmp_path)).select("id", "entity").orderBy("id").collect()] == [(0, "x"), (1, "y")]


def test_progress_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    rows = [{"article_id": "a", "seq": 1, "stage": "ner", "percent": 22}, {"article_id": "a", "seq": 2, "stage": "tsne"}, {"article_id": "b", "seq": 1, "stage": "x"}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    q = progress.run_to_table(progress.latest_progress(progress.progress_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r["article_id"]: (r["stage"], r["percent"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("tsne", 85), "b": ("x", 50)}
