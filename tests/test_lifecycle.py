"""Articles from upload to points, the command line, documents for viewers, PDF files, streams."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslens import cli
from corpuslens.operators import articles, entities, project
from corpuslens.operators.articles import Library
from corpuslens.sources import readers, sinks
from corpuslens.streaming import progress

TERMS = {"BERT": "MODEL", "accuracy": "METRIC", "attention": "TECHNIQUE"}
TEXT = "TITLE: A study of models\n\nBERT uses attention. BERT has accuracy.\n\nNo term is here.\n\nAccuracy and attention again."


@pytest.fixture
def library(spark, tmp_path):
    (tmp_path / "paper.txt").write_text(TEXT, encoding="utf-8")
    return Library(spark, str(tmp_path / "library")), str(tmp_path / "paper.txt")


def test_an_article_from_upload_to_points(spark, library):
    lib, path = library
    article = lib.ingest(path)
    state = lambda: articles.latest_records(lib.table("records")).first()
    assert (state()["status"], state()["original_name"]) == ("uploaded", "paper.txt")
    assert lib.table("progress").select("stage", "percent").collect() == [("queued", 0)]
    done = lib.process(article, TERMS, entities.hashed_vectors)
    assert done["status"] == state()["status"] == "processed"
    steps = [tuple(r) for r in lib.table("progress").orderBy("seq").select("stage", "percent").collect()]
    assert steps == [("queued", 0), ("loading", 5), ("ner", 75), ("tsne", 85), ("completed", 100)]
    # a text file is kept as it came, and its parts are the texts
    assert lib.cleaned_text(article["id"]).first()["text"] == TEXT
    assert [(r["text_index"], r["n_entities"]) for r in lib.ner(article["id"]).collect()] == [(0, 0), (1, 4), (2, 0), (3, 2)]
    points = lib.points(article["id"])
    assert points.count() == 6 and [r["id"] for r in points.collect()] == list(range(6))
    assert lib.point(article["id"], 3).first()["entity"] == "accuracy"
    assert lib.example_points().count() == 6
    assert [r["id"] for r in lib.list_articles().collect()] == [article["id"]]
    meta = lib.meta(article["id"]).first()
    assert (meta["article"]["status"], meta["progress"]["percent"], meta["title"]) == ("processed", 100, "A study of models")


def test_points_are_made_once_from_embeddings(spark, library):
    lib, path = library
    article = lib.process(lib.ingest(path), TERMS)
    rows = spark.createDataFrame([(i, [float(i), 1.0, i * 0.5], "MODEL", "x", 0, 0, "s") for i in range(4)], readers.schemas.EMBEDDED)
    lib.append("embeddings", rows.withColumn("article_id", F.lit(article["id"])))
    assert lib.points(article["id"]).count() == lib.points(article["id"]).count() == 4


def test_a_failure_is_a_state(spark, library):
    lib, path = library
    article = lib.ingest(path)

    def broken(chunks):
        raise RuntimeError("no model here")

    with pytest.raises(Exception, match="no model here"):
        lib.process(article, broken)
    last = articles.latest_records(lib.table("records")).first()
    assert last["status"] == "failed" and "no model here" in last["error"]
    assert lib.table("progress").where("stage = 'failed'").count() == 1
    with pytest.raises(ValueError, match="no step"):
        articles.stepped(spark, dict(article, status="processed"), "uploaded")
    # a failed article may be tried again
    assert lib.process(last.asDict(), TERMS)["status"] == "processed"


def test_no_example_without_an_article(spark, tmp_path):
    lib = Library(spark, str(tmp_path))
    (tmp_path / "a.txt").write_text("x")
    lib.ingest(str(tmp_path / "a.txt"))
    with pytest.raises(KeyError):
        lib.points("nobody")
    with pytest.raises(ValueError, match="not an article"):
        lib.ingest(str(tmp_path / "a.doc"))


def test_a_loaded_tagger_is_made_on_the_worker(spark):
    def make():
        import os

        return lambda chunks, pid=os.getpid(): [[("MODEL", 1.0, str(pid), 0, 1)] for _ in chunks]

    chunks = spark.range(40).select(F.lit("some chunk").alias("chunk")).coalesce(1)
    rows = entities.tagged(chunks, entities.LoadedTagger(make)).select(F.col("entities")[0]["word"].alias("pid")).distinct().collect()
    import os

    assert len(rows) == 1 and rows[0]["pid"] != str(os.getpid())


def test_a_late_layout_is_the_principal_components(spark):
    rows = spark.createDataFrame([(0, i, [float(i % 7), float(i * i % 11), float(i % 3)]) for i in range(30)], "article int, id long, embedding array<double>")
    late = project.projected(rows, "embedding", "article", "id", seconds=-1.0)
    plain = project.pca_points(rows, "embedding")
    both = late.select("id", "x").join(plain.select("id", F.col("x").alias("p")), "id").collect()
    sign = 1 if sum(r["x"] * r["p"] for r in both) > 0 else -1
    assert all(r["x"] == pytest.approx(sign * r["p"]) for r in both)
    assert project.projected(rows, "embedding", "article", "id").count() == 30


def test_documents_are_indented_json(spark, tmp_path):
    sinks.write_document(spark.createDataFrame([(1, "é"), (2, None)], "id int, text string").orderBy("id"), str(tmp_path / "d.json"))
    text = (tmp_path / "d.json").read_text(encoding="utf-8")
    assert json.loads(text) == [{"id": 1, "text": "é"}, {"id": 2, "text": None}] and '\n    "id": 1' in text and "é" in text
    sinks.write_document(spark.createDataFrame([], "id int"), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == []


def test_command_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "terms.json").write_text(json.dumps(TERMS))
    at = lambda name: str(tmp_path / name)
    made = ["--output", at("ner.json"), "--embeddings", at("vectors"), "--tsne-output", at("points.json"), "--progress-file", at("progress.json")]
    assert cli.main(["run", "--article", at("a.txt"), "--terms", at("terms.json"), *made]) == 0
    results = readers.read_ner_results(spark, at("ner.json"))
    assert [len(r["entities"]) for r in results.collect()] == [0, 4, 0, 2]
    assert readers.read_points(spark, at("points.json")).count() == 6
    steps = json.loads((tmp_path / "progress.json").read_text())
    assert [s["percent"] for s in steps] == [0, 5, 75, 85, 100]
    assert cli.main(["project", "--embeddings", at("vectors"), "--output", at("pca.json")]) == 0
    assert readers.read_points(spark, at("pca.json")).count() == 6
    assert cli.main(["clean", at("a.txt"), "--output", at("clean"), "--save-processed", at("processed")]) == 0
    assert spark.read.parquet(at("processed")).count() == 1
    assert cli.main(["run", "--terms", at("terms.json"), "--output", at("default.json")]) == 0
    assert readers.read_ner_results(spark, at("default.json")).count() == len(readers.DEFAULT_TEXTS)


FAKE_READER = '''
class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        return self.text


class PdfReader:
    def __init__(self, stream):
        title, *pages = stream.read().decode().split("|")
        self.metadata = type("Meta", (), {"title": title})()
        self.pages = [Page(p) for p in pages]
'''


def test_pdf_files(spark, tmp_path):
    """No PDF library is installed here: a module of the name that is tried first stands in for it."""
    (tmp_path / "pypdf.py").write_text(FAKE_READER)
    spark.sparkContext.addPyFile(str(tmp_path / "pypdf.py"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_text("The title||exam-\nple one|two SomeNet")
    row = readers.read_pdfs(spark, str(tmp_path / "in")).first()
    assert (row["title_hint"], row["first_page"], row["pages"], row["source_type"]) == ("The title", "", 3, "pdf")
    assert row["text"] == "example one\n\ntwo Some Net"


def test_the_progress_stream_keeps_the_newest(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    rows = [("a", 0, "queued", 0), ("a", 1, "ner", None), ("b", 0, "queued", 0)]
    keys = ("article_id", "seq", "stage", "percent")
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in rows))
    run = lambda: progress.run_to_table(progress.latest_progress(progress.progress_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    (folder / "2.json").write_text(json.dumps(dict(zip(keys, ("a", 2, "completed", 100), strict=True))))
    run()
    got = {r["article_id"]: (r["stage"], r["percent"]) for r in progress.newest(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": ("completed", 100), "b": ("queued", 0)}
