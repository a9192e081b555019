import re

import pytest

from corpuslens.operators import segment as S
from corpuslens.operators import title as T


def packed(text, low, high):
    out, cur = [], ""
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)):
        if not s:
            continue
        if len(cur + s + ". ") <= high:
            cur += s + ". "
        else:
            if len(cur) > low and any(map(str.isalpha, cur)):
                out.append(cur.strip())
            cur = s + ". "
    return out + [cur.strip()] * (len(cur) > low and any(map(str.isalpha, cur)))


@pytest.mark.parametrize("text", ["One is here. Two! Three? " * 9, "x" * 90 + ". y. z " + "w" * 70 + ".", "", "12. 34. 56. " * 9, "a. b. c."])
def test_packing(one, text):
    assert one(S.pack_sentences("t", 10, 60), t=text) == packed(text, 10, 60)


def test_packing_without_a_second_stop(one):
    assert one(S.pack_sentences("t", 0, 60, repeat_stop=False), t="What? Yes. so") == ["What? Yes. so."]


@pytest.mark.parametrize(("n", "expected"), [(119, 119), (121, 120), (240, 120), (361, 120)])
def test_sampling(one, n, expected):
    from pyspark.sql import functions as F

    got = one(S.sampled(F.split("t", " "), 120), t=" ".join(map(str, range(n))))
    assert len(got) == expected
    assert got[1] == {119: "1", 121: "1", 240: "2", 361: "3"}[n]


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (320, 1), (321, 2), (615, 2), (616, 3)])
def test_windows(spark, n, chunks):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
    rows = [r["chunk"].split() for r in S.word_windows(df).orderBy("chunk_index").collect()]
    assert len(rows) == chunks
    assert {w for r in rows for w in r} == {f"w{i}" for i in range(n)}
    assert all(a[-25:] == b[:25] for a, b in zip(rows, rows[1:]))


def test_short_text_is_a_chunk_as_it_is(spark):
    df = spark.createDataFrame([(1, "a\n\n b "), (2, None), (3, "  ")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk"]) for r in S.word_windows(df).collect()] == [(1, "a\n\n b ")]


def test_paragraphs(one):
    text = "Short\n\nA paragraph that is long enough to be kept here.\n\n1234567890123456789012345678901234567890"
    assert one(S.paragraphs("t"), t=text) == ["A paragraph that is long enough to be kept here."]
    assert one(S.paragraphs("t", pdf=True), t="line one of the text that stays\n\nno") == ["line one of the text that stays"]
    assert one(S.paragraphs("t"), t="x" * 500) == ["x" * 450, "x" * 50]


def test_parts(one):
    assert one(S.article_parts("t"), t="x\nTITLE: a b\nc\n\nd") == ["TITLE: a b", "x\nc", "d"]
    assert one(S.article_parts("t"), t="a\n \nb") == ["a", "b"]
    assert one(S.body_paragraphs("t"), t="TITLE: q\n\nbody\r\n\r\n c") == ["body", "c"]


def test_titles(one):
    assert one(T.display_title("t"), t="\nTitle: Hello there\n x") == "Hello there"
    assert one(T.display_title("t"), t="Abstract of it\nA fitting first line of text") == "A fitting first line of text"
    head = "Contents lists available at X\nThe study of many document kinds\nAnna Black*, Carl White\nrest"
    assert one(T.document_title("t"), t=head) == "The study of many document kinds"
    assert one(T.first_page_title("t"), t=head) == "The study of many document kinds"
    two = "A first line of a longer title\ncontinued on the second line here\nAnna Black, Carl White\n"
    assert one(T.document_title("t"), t=two) == "A first line of a longer title continued on the second line here"
    assert one(T.document_title("t"), t="a\nb") is None
    assert one(T.is_bad_title("t"), t="see www.x") is True
    assert one(T.is_bad_title("t"), t=None) is True
    assert one(T.panel_title("t", T.F.array(T.F.lit("x"), T.F.lit("TITLE: N"))), t="") == "N"
