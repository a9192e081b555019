import re

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import normalize as N
from corpuslens.functions import text as X
from corpuslens.functions.register import register


@pytest.mark.parametrize("t", ["a\n\nb", "  x \t", "", "a ", "a\r\nb\rc\n", "x\x1cy z", "\n", "one"])
def test_lines_and_strip_are_pythons(one, t):
    assert one(X.lines("t"), t=t) == t.splitlines()
    assert one(X.strip("t"), t=t) == t.strip()
    assert one(X.rstrip("t"), t=t) == t.rstrip()
    assert one(X.lstrip("t"), t=t) == t.lstrip()


def test_counts(one):
    t = "Añ 1² ٣ _x"
    assert one(X.letters("t"), t=t) == sum(c.isalpha() for c in t)
    assert one(X.digits("t"), t=t) == sum(c.isdigit() for c in t)
    assert one(X.where("t", "b"), t="abc") == 1
    assert one(X.where("t", "z"), t="abc") is None


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (N.join_hyphens, "exam-\nple", "example"),
        (N.split_camel_case, "SomeNet", "Some Net"),
        (N.join_lines, "a\nB\n1", "a B\n1"),
        (N.fix_characters, "ﬁ–•x y­", "fi- x y"),
        (N.fix_mojibake, "Â© donâ€™t â€œqâ€\x9d Â", "© don't \"q\" "),
        (N.remove_extra_whitespace, "a\n\nb", "a\nb"),
        (N.remove_extra_whitespace, "  a", "\na"),
        (N.normalize_extracted, "a____b \x07 ====", "a b    ".replace("    ", " ")),
        (N.entity_key, "  Deep   Learning ", "deep learning"),
        (N.escape_html, "<a href='x'>&\"", "&lt;a href=&#039;x&#039;&gt;&amp;&quot;"),
        (N.normalize_title, "Review Article A Title A B S T R A C T text", "A Title"),
        (N.normalize_title, " - ", None),
        (N.sanitize_title, " The  name Abstract x", "The name"),
    ],
)
def test_normalisers(one, f, given, expected):
    assert one(f("t"), t=given) == expected


def test_whitespace_option_keeps_blank_lines(one):
    assert one(N.remove_extra_whitespace("t", preserve_blank_lines=True), t="a\n\n  b") == "a\n\nb"


def test_eta_and_names(one):
    assert one(N.eta_text("s"), s=75) == "1m 15s"
    assert one(N.eta_text("s"), s=9) == "9s"
    assert one(N.file_name("p"), p="a/b\\C.PDF") == "C.PDF"
    assert one(N.file_suffix("p"), p="a/b\\C.PDF") == ".pdf"
    assert one(N.is_log_noise("p"), p=" Procesando: 3") is True


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select entity_key(' A  b '), round(bubble_size(5, 30), 4), progress_percent(2, 4), remove_urls('x http://www.a.b y')").first()
    assert tuple(row) == ("a b", 37.7544, 40, "x  y")


def test_nulls_stay_null(one):
    for f in (N.fix_spacing, N.entity_key, N.escape_html, N.normalize_title, X.strip, X.lines):
        assert one(f(F.col("t")), t=None) is None


def test_regular_expression_flags(one):
    assert one(X.sub("t", r"a.*$", "", "i"), t="xA b\nc") == re.sub(r"a.*$", "", "xA b\nc", flags=re.I)
