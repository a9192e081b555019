"""More named queries with SQL: whole profiles, packing, paragraphs, titles, entity rows, spans, points.

They register in the catalogue beside those of the single operators.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import articles, clean, entities, frequency, project, removal, segment, spans, title
from ..sources import readers
from .catalog import _BLANKS, _SPAN_TERMS, _STATS, SHORT, _decorated_sql, _projected, _replaced, _span_rows, by_turn, decorated, query, short, table

BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"'^{BLANK}+|{BLANK}+$', '', 'g'"


# ---- packing and paragraphs


def _packing(parts: str, low: int, high: int) -> str:
    """CTEs `packed` (keys, i, chunk) of parts (doc_id, part, text): sentences packed greedily."""
    return rf"""
sentence AS (
  SELECT doc_id, part, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]){BLANK}+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, {STRIP})), lambda x: x <> '') AS a
  FROM {parts}),
pack(doc_id, part, i, cur, done) AS (
  SELECT doc_id, part, 0, '', CAST(NULL AS VARCHAR) FROM sentence
  UNION ALL
  SELECT doc_id, part, i + 1,
    CASE WHEN length(cur || a[i + 1] || '. ') <= {high} THEN cur || a[i + 1] || '. ' ELSE a[i + 1] || '. ' END,
    CASE WHEN length(cur || a[i + 1] || '. ') <= {high} THEN NULL ELSE cur END
  FROM pack JOIN sentence USING (doc_id, part) WHERE i < len(a)),
packed AS (
  SELECT doc_id, part, i, regexp_replace(chunk, {STRIP}) AS chunk
  FROM (SELECT doc_id, part, i, done AS chunk FROM pack WHERE done IS NOT NULL UNION ALL SELECT doc_id, part, i + 1, cur FROM pack JOIN sentence USING (doc_id, part) WHERE i = len(a))
  WHERE length(chunk) > {low} AND regexp_matches(chunk, '\pL'))"""


@query(rf"""
WITH RECURSIVE whole AS (SELECT doc_id, 0 AS part, text FROM documents), {_packing("whole", 30, 450)}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS text_index, chunk AS text FROM packed""")
def sentence_pack(spark, sf):
    docs = table(spark, sf, "documents")
    return segment.exploded(docs, segment.pack_sentences("text"))


def _paragraphs_sql(low: int, high: int, fine: str, keep: str, last: str) -> str:
    return rf"""
WITH RECURSIVE t AS {_decorated_sql(_BLANKS[1])},
split AS (SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) AS part FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM t)),
para AS (SELECT doc_id, part, text FROM (SELECT doc_id, part, regexp_replace(text, {STRIP}) AS text FROM split) WHERE {keep}),
long AS (SELECT * FROM para WHERE length(text) > {high}), {_packing("long", low, high)},
lone AS (SELECT long.*, generate_series(0, (length(a[1]) - 1) // {high}) AS k FROM long JOIN sentence USING (doc_id, part) WHERE len(a) = 1 AND length(a[1]) > {high}),
cut AS (SELECT doc_id, part, k, regexp_replace(text[k * {high} + 1:k * {high} + {high}], {STRIP}) AS text FROM (SELECT doc_id, part, text, unnest(k) AS k FROM lone)),
counts AS (SELECT *, greatest(length(text), 1) AS n, len(regexp_extract_all(text, '\pL')) AS alpha, len(regexp_extract_all(text, '[\p{{Nd}}²³¹⁰⁴-⁹₀-₉]')) AS digit FROM para WHERE length(text) BETWEEN {low + 1} AND {high}),
pieces AS (
  SELECT doc_id, part, i, chunk AS text FROM packed WHERE (doc_id, part) NOT IN (SELECT (doc_id, part) FROM lone)
  UNION ALL SELECT doc_id, part, k, text FROM cut WHERE length(text) > {low} AND regexp_matches(text, '\pL')
  UNION ALL SELECT doc_id, part, 0, text FROM counts WHERE alpha > 0 AND {fine}),
made AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, i) - 1 AS x, text FROM pieces)
{last}"""


_LINES = rf"""
SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS x
FROM (SELECT doc_id, j, regexp_replace(line, {STRIP}) AS text FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM t)))
WHERE length(text) > 20 AND regexp_matches(text, '\pL')"""


@query(_paragraphs_sql(30, 450, "alpha / n > 0.2 AND digit / n < 0.4", "TRUE", "SELECT doc_id, CAST(x AS INTEGER) AS text_index, text FROM made"))
def paragraphs_txt(spark, sf):
    return segment.exploded(decorated(spark, sf, _BLANKS[0]), segment.paragraphs("text"))


@query(
    _paragraphs_sql(
        20, 700, "alpha / n > 0.1 AND digit / n < 0.6", r"NOT regexp_matches(text, '\.{4,}\s*\d+\s*$') AND NOT regexp_matches(text, '^\s*\d+(\.\d+)*\s+.*\s+\d+\s*$')",
        f""", few AS (SELECT doc_id FROM t WHERE doc_id NOT IN (SELECT doc_id FROM made GROUP BY doc_id HAVING count(*) >= 5)),
chosen AS (SELECT doc_id, x, text FROM made WHERE doc_id NOT IN (SELECT doc_id FROM few) UNION ALL SELECT doc_id, x, text FROM ({_LINES}) WHERE doc_id IN (SELECT doc_id FROM few)),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM chosen),
stepped AS (SELECT *, CASE WHEN n > 120 THEN greatest(n // 120, 1) ELSE 1 END AS step FROM sized)
SELECT doc_id, CAST(x // step AS INTEGER) AS text_index, text FROM stepped WHERE x % step = 0 AND (n <= 120 OR x // step < 120)""",
    )
)
def paragraphs_pdf(spark, sf):
    return segment.exploded(decorated(spark, sf, _BLANKS[0]), segment.paragraphs("text", pdf=True))


@query(rf"""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'TITLE: A title' || chr(10) || chr(10) WHEN 1 THEN 'TITLE: B' || chr(10) || 'first' || chr(13) || chr(10) || ' ' || chr(10) ELSE '' END || text AS text FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, {STRIP}), '\r?\n\s*\r?\n'), lambda x: regexp_replace(x, {STRIP})), lambda x: x <> '') AS a FROM t),
b AS (SELECT doc_id, list_filter(list_transform(a, lambda x: CASE WHEN regexp_matches(x, '(?i)^TITLE:') THEN regexp_replace(regexp_replace(x, '(?i)^TITLE:\s*[^\r\n]*\s*', ''), {STRIP}) ELSE x END), lambda x: x <> '') AS a FROM p)
SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS text_index, md5(unnest(a)) AS text_md5 FROM b""")
def body_paragraphs(spark, sf):
    k = F.col("doc_id") % 3
    pre = F.when(k == 0, F.lit("TITLE: A title\n\n")).when(k == 1, F.lit("TITLE: B\nfirst\r\n \n")).otherwise("")
    d = table(spark, sf, "documents").select("doc_id", F.concat(pre, "text").alias("text"))
    return segment.exploded(d, segment.body_paragraphs("text")).select("doc_id", "text_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- cleaning


def _cut(text: str, least: float) -> str:
    head = rf"regexp_extract({text}, '(?is)\A(.*?)(?:\n|\A)(?:References|Bibliography|Works Cited)\b', 1)"
    return rf"CASE WHEN regexp_matches({text}, '(?i)(?:\n|\A)(References|Bibliography|Works Cited)\b') AND length({head}) >= floor(length({text}) * {least}::DOUBLE) THEN regexp_replace({head}, '{BLANK}+$', '') ELSE {text} END"


def _all(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_SECTION = r"(?i)(?:Abstract|Acknowledgments?|Funding|Conflicts? of Interest|Author Contributions|Data Availability)[^\n]*"
_APPENDIX = r"(?i)(?:\A|\n)Appendix[^\n]*"
_FIGURE = r"(?i)(?:Fig(?:ure)?|Table|Eq\.?|Equation)\s*\.?\s*\d+[^.]*\.?"
_CITED, _CITED_SHORT = r"\([A-Z][a-z]+\s*(?:et\s+al\.?)?,?\s*\d{4}\)", r"\([A-Z][a-z]+\s+\d{4}\)"
_CLEAN_SQL = rf"""
WITH t AS {_decorated_sql(_STATS[1])},
a AS (SELECT doc_id, length(text) AS chars_before, text AS whole, {_cut("text", 0.6)} AS text FROM t),
b AS (SELECT *, CAST(whole <> text AS INTEGER) AS removed_references, {_all("text", _SECTION)} AS s1, regexp_replace(text, '{_SECTION}', '', 'g') AS t1 FROM a),
c AS (SELECT *, {_all("t1", _APPENDIX)} AS s2, regexp_replace(t1, '{_APPENDIX}', '', 'g') AS t2 FROM b),
d AS (SELECT *, {_all("t2", _FIGURE)} AS f, regexp_replace(t2, '{_FIGURE}', '', 'g') AS t3 FROM c),
e AS (SELECT *, {_all("t3", _CITED)} AS c1, regexp_replace(t3, '{_CITED}', '', 'g') AS t4 FROM d),
g AS (SELECT *, {_all("t4", _CITED_SHORT)} AS c2, regexp_replace(t4, '{_CITED_SHORT}', '', 'g') AS t5 FROM e),
h AS (SELECT *, {_all("t5", "https?://[^\\s]+")} + {_all("t5", "www\\.[^\\s]+")} AS u, {_replaced("t5", ("https?://[^\\s]+", "''"), ("www\\.[^\\s]+", "''"))} AS t6 FROM g),
z AS (SELECT *, {_replaced("t6", (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n" + BLANK + "+", "chr(10)"), (r"\A" + BLANK + "+", "chr(10)"))} AS done FROM h)
SELECT doc_id, CAST(chars_before AS INTEGER) AS chars_before, CAST(length(done) AS INTEGER) AS chars_after, CAST(chars_before - length(done) AS INTEGER) AS chars_removed,
  round(100 * (chars_before - length(done)) / greatest(1, chars_before), 4) AS percent_removed,
  removed_references, CAST(c1 + c2 AS INTEGER) AS removed_citations, CAST(f AS INTEGER) AS removed_figures_tables, CAST(s1 + s2 AS INTEGER) AS removed_special_sections, CAST(u AS INTEGER) AS removed_urls
FROM z"""


@query(_CLEAN_SQL)
def clean_stats(spark, sf):
    done = clean.clean_txt(decorated(spark, sf, _STATS[0]))
    return clean.report(done).withColumn("percent_removed", F.round("percent_removed", 4))


_MORE = r"(?:\n[^\n]+)"
_projected(
    "strip_figure_blocks", by_turn("\nFigure 3 shows\nline one\nline two\nline three\nline four", "\nFig. 2: caption\n\nrest", "\nTable 7 of all\nx"), removal.remove_figure_blocks,
    _replaced("text", (rf"(?i)(?:\A|\n)(Figure|Fig\.|Table)\s*\d+[^\n]*{_MORE}{{0,3}}", "chr(10)"), (rf"(?i)(?:\A|\n)(Fig\.|Figure|Table)\s*\d+:\s*[^\n]*{_MORE}{{0,3}}", "chr(10)")),
)
_projected(
    "strip_captions", by_turn("\nEquation 3 is\na\nb\nc\nd", "\nEq. (4): x\ny\nz\nw\nTable 3: t", "\nFigure 8: q\n\nFig. 9 r"), removal.remove_captions,
    _replaced(
        "text", *[(p, "chr(10)") for p in (
            rf"(?i)(?:\A|\n)Equation\s*\d+[^\n]*{_MORE}{{0,3}}", rf"(?i)(?:\A|\n)Eq\.?\s*\(?\d+\)?[:\s][^\n]*{_MORE}{{0,2}}", rf"(?i)(?:\A|\n)Table\s*\d+[:\s][^\n]*{_MORE}{{0,3}}",
            rf"(?i)(?:\A|\n)Figure\s*\d+[:\s][^\n]*{_MORE}{{0,3}}", rf"(?i)(?:\A|\n)Fig\.?\s*\d+[:\s][^\n]*{_MORE}{{0,3}}")],
    ),
)
_projected(
    "strip_licences", by_turn("\nCopyright by them\nAll rights reserved.\nx", "\nThis is an open access article under it\n© 2020 all", "\nCreative Commons by\nend"), removal.remove_licences,
    _replaced("text", *[(p, "chr(10)") for p in (r"(?i)(?:\n|\A)(Copyright|©)\s*[^\n]*", r"(?i)(?:\n|\A)All rights reserved\.*", r"(?i)(?:\n|\A)This is an open access article[^\n]*", r"(?i)(?:\n|\A)Creative Commons[^\n]*")]),
)

# ---- titles

_TITLES = ["Review Article  A  study of many things -", "Learning  to read A B S T R A C T we read", "Fig. 3. A figure of it: ", "Abstract only", " plain title ", "Original Articleof mice abstract and men"]
_TITLE = f"list_extract({_TITLES}, CAST(doc_id % {len(_TITLES)} + 1 AS BIGINT))"
_ABSTRACT = (r"(?is)\bA\W*B\W*S\W*T\W*R\W*A\W*C\W*T\b.*\z", r"(?is)\bAbstract\b.*\z")


def _stripped(expr: str) -> str:
    return f"regexp_replace({expr}, {STRIP})"


def _without_abstract(expr: str) -> str:
    for p in _ABSTRACT:
        expr = _stripped(f"regexp_replace({expr}, '{p}', '')")
    return expr


_NORMAL = _without_abstract(_stripped(rf"regexp_replace({_stripped('x')}, '(?i)^(Review Article|Original Article|Research Article)\s*', '')"))
_NORMAL = _stripped(rf"regexp_replace({_NORMAL}, '(?i)^Fig\.{{0,2}}\s*\d+\.{{0,2}}\s*', '')")


@query(rf"""
SELECT doc_id, nullif(trim(regexp_replace({_NORMAL}, '\s{{2,}}', ' ', 'g'), ' -:' || chr(9)), '') AS normalized,
  {_stripped(rf"regexp_replace({_without_abstract(_stripped('x'))}, '\s{{2,}}', ' ', 'g')")} AS sanitized,
  x = '' OR regexp_matches(lower(x), 'abstract|keywords|article info|article history|journal homepage|contents lists available|sciencedirect|doi|www\.|fig\.') OR regexp_matches(x, '(?i)\bA\W*B\W*S\W*T\W*R\W*A\W*C\W*T\b') OR length(x) > 220 AS bad
FROM (SELECT doc_id, {_TITLE} AS x FROM documents)""")
def title_forms(spark, sf):
    x = F.get(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES)).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", x.alias("x"))
    return d.select("doc_id", N.normalize_title("x").alias("normalized"), N.sanitize_title("x").alias("sanitized"), title.is_bad_title("x").alias("bad"))


@query(rf"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  Given   title ' END AS x, ['first sentence', CASE WHEN doc_id % 3 = 0 THEN ' Title:  The  name' ELSE 'second' END] AS s FROM documents)
SELECT doc_id, coalesce(CASE WHEN x IS NOT NULL THEN 'Given title' END, CASE WHEN regexp_matches(s[2], '(?i)^\s*TITLE:') THEN 'The name' END) AS title FROM t""")
def panel_titles(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "  Given   title ").alias("x"), F.array(F.lit("first sentence"), F.when(F.col("doc_id") % 3 == 0, " Title:  The  name").otherwise("second")).alias("s")
    )
    return d.select("doc_id", title.panel_title("x", "s").alias("title"))


# ---- entity rows

_TAGGED = {"the": "MODEL", "that": "TECHNIQUE", "of": "METRIC", "this": "DATASET"}
_PIECES = r"[\pL\pM\p{N}_]+|[^\pL\pM\p{N}_]+"
_ENTITY_SQL = rf"""
WITH texts AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS text_index, text FROM conversations),
pieces AS (SELECT doc_id, text_index, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT *, regexp_extract_all(text, '{_PIECES}') AS p FROM texts)),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, text_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM pieces),
lexicon(word, label) AS (VALUES {", ".join(f"('{w}', '{x}')" for w, x in _TAGGED.items())}),
hits AS (SELECT doc_id, text_index, i, label, piece AS entity, s0 AS "start", s0 + length(piece) AS "end" FROM placed JOIN lexicon ON lower(piece) = word)"""


def _tagged(spark, sf):
    texts = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("text_index"), "text")
    return texts, entities.tagged(segment.word_windows(texts, keep=("doc_id", "text_index")), entities.GazetteerTagger(_TAGGED))


@query(rf"""{_ENTITY_SQL}
SELECT doc_id, text_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY text_index, i) - 1 AS INTEGER) AS id, label, entity, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end" FROM hits""")
def entity_rows(spark, sf):
    _, chunks = _tagged(spark, sf)
    rows = entities.with_ids(entities.entity_rows(chunks, ["doc_id", "text_index", "chunk_index"]), ["doc_id"], ["text_index", "chunk_index", "entity_index"])
    return rows.select("doc_id", "text_index", "id", "label", "entity", "start", "end")


@query(rf"""{_ENTITY_SQL},
own AS (SELECT doc_id, text_index, string_agg(label || ':' || lower(entity) || ':' || "start", ',' ORDER BY i) AS words, count(*) AS n FROM hits GROUP BY doc_id, text_index)
SELECT doc_id, text_index, coalesce(words, '') AS words, CAST(coalesce(n, 0) AS INTEGER) AS n_entities FROM texts LEFT JOIN own USING (doc_id, text_index) WHERE regexp_matches(text, '\S')""")
def text_entities(spark, sf):
    _, chunks = _tagged(spark, sf)
    rows = entities.text_results(chunks, ["doc_id", "text_index"])
    words = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["entity_group"], e["word"], e["start"].cast("string"))), ",")
    return rows.select("doc_id", "text_index", words.alias("words"), "n_entities")


# ---- spans


def _occurrences(term: str) -> str:
    """Starts of non-overlapping occurrences, from the lengths of what lies between them."""
    pieces, n = f"string_split(text, '{term}')", len(term)
    return f"list_transform(generate_series(1, len({pieces}) - 1), lambda k: CAST(list_sum(list_transform({pieces}[1:k], lambda p: length(p))) + (k - 1) * {n} AS INTEGER))"


def _span_sql() -> str:
    steps = ["s0 AS (SELECT conv_id, turn, text, CAST([] AS STRUCT(\"start\" INTEGER, \"end\" INTEGER, id INTEGER, label VARCHAR, entity VARCHAR)[]) AS taken FROM conversations)"]
    for i, (label, term) in enumerate(_SPAN_TERMS):
        n = len(term)
        free = f'list_filter({_occurrences(term)}, lambda s: len(list_filter(taken, lambda r: s < r."end" AND s + {n} > r."start")) = 0)[1]'
        new = f'struct_pack("start" := s0, "end" := CAST(s0 + {n} AS INTEGER), id := {i}, label := \'{label}\', entity := \'{term}\')'
        steps.append(f"f{i} AS (SELECT *, {free} AS s0 FROM s{i})")
        steps.append(f"s{i + 1} AS (SELECT conv_id, turn, text, CASE WHEN s0 IS NULL THEN taken ELSE list_append(taken, {new}) END AS taken FROM f{i})")
    return f"WITH {', '.join(steps)}, ranged AS (SELECT conv_id, turn, text, list_sort(taken) AS r FROM s{len(_SPAN_TERMS)})"


def _escaped(expr: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        expr = f"replace({expr}, '{sign}', '{entity}')"
    return expr


@query(f"{_span_sql()} SELECT conv_id, turn, CAST(to_json(r) AS VARCHAR) AS ranges FROM ranged")
def span_assign(spark, sf):
    return _span_rows(spark, sf).select("conv_id", "turn", F.to_json("ranges").alias("ranges"))


_BEFORE = 'CASE WHEN i = 1 THEN 0 ELSE r[i - 1]."end" END'


@query(f"""{_span_sql()}
SELECT conv_id, turn, md5(
  coalesce(array_to_string(list_transform(generate_series(1, len(r)), lambda i: {_escaped(f'text[{_BEFORE} + 1:r[i]."start"]')}
    || '<span class="entity ' || lower(r[i].label) || '" data-id="' || r[i].id || '">' || {_escaped('text[r[i]."start" + 1:r[i]."end"]')} || '</span>'), ''), '')
  || {_escaped('text[CASE WHEN len(r) = 0 THEN 0 ELSE r[len(r)]."end" END + 1:]')}) AS html_md5 FROM ranged""")
def highlight_html(spark, sf):
    return _span_rows(spark, sf).select("conv_id", "turn", F.md5(spans.highlighted("text", "ranges").cast("binary")).alias("html_md5"))


@query(f"SELECT conv_id, turn, array_to_string({_occurrences('th')}, ',') AS starts FROM conversations")
def occurrence_places(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.transform(spans.occurrences_of("text", F.lit("th")), lambda s: s.cast("string")), ",").alias("starts"))


# ---- points


@query("""
WITH p AS (SELECT lower(event_type) AS key, event_type AS entity, event_id AS id, value AS x, user_id AS y FROM events)
SELECT key, count(*) AS frequency, round(avg(coalesce(x, 0)), 4) AS cx, round(avg(coalesce(y, 0)), 4) AS cy, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids_md5 FROM p GROUP BY key""")
def entity_centroids(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("entity"), F.lit("MODEL").alias("label"), F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").alias("y"))
    ids = F.array_join(F.transform("occurrences", lambda o: o["id"].cast("string")), ",")
    places = frequency.occurrences(e).select("key", F.md5(ids.cast("binary")).alias("ids_md5"))
    rows = frequency.entity_frequency(e).join(places, "key")
    return rows.select("key", "frequency", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "ids_md5")


@query("""
SELECT CAST(vec_id AS INTEGER) AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, CAST(label AS VARCHAR) AS label, 'entity ' || vec_id AS entity,
  CAST(vec_id % 7 AS INTEGER) AS text_index, CAST(vec_id % 7 AS INTEGER) AS sentence_id, CASE WHEN vec_id % 2 = 0 THEN 'even' END AS sentence_text FROM embeddings""")
def point_table(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"), "label", F.concat(F.lit("entity "), F.col("vec_id").cast("string")).alias("entity"),
        (F.col("vec_id") % 7).alias("text_index"), (F.col("vec_id") % 7).alias("sentence_id"), F.when(F.col("vec_id") % 2 == 0, "even").alias("sentence_text"), F.lit(1).alias("other"),
    )
    return project.points(e).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("SELECT vec_id AS id, CASE WHEN vec_id IN (3, 5, 8) THEN '#000' ELSE '#666' END AS colour FROM embeddings")
def recoloured_points(spark, sf):
    return frequency.recoloured(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("#666").alias("colour")), [3, 5, 8], "#000")


@query("""
WITH c AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings WHERE label < 3),
m AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM c GROUP BY dim),
z AS (SELECT vec_id, dim, (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM c JOIN m USING (dim))
SELECT round(sum(z * z), 3) AS total, count(DISTINCT vec_id) AS n FROM z""")
def pca_keeps_variance(spark, sf):
    """All components together hold the variance of the standardised vectors: a rotation."""
    e = table(spark, sf, "embeddings").where("label < 3").withColumn("embedding", F.col("embedding").cast("array<double>"))
    pc = project.pca(e, "embedding", 64)
    return pc.agg(F.round(F.sum(F.aggregate("pc", F.lit(0.0), lambda a, x: a + x * x)), 3).alias("total"), F.count("*").alias("n"))


# ---- sources and the catalogue of articles


@query(r"SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN lower(url) LIKE '%.txt' THEN 'txt' END AS kind FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.txt' ELSE '' END AS url FROM pages)")
def source_kinds(spark, sf):
    k = F.col("page_id") % 3
    url = F.concat("url", F.when(k == 0, "/a.PDF").when(k == 1, "/b.txt").otherwise(""))
    return table(spark, sf, "pages").select("page_id", url.alias("url")).select("page_id", readers.source_type("url").alias("kind"))


@query("""
WITH l AS (SELECT user_id AS id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE lpad(CAST(event_id AS VARCHAR), 9, '0') END AS updated_at, lpad(CAST(event_id AS VARCHAR), 9, '0') AS uploaded_at, event_type AS status FROM events)
SELECT id, arg_max(status, coalesce(updated_at, uploaded_at)) AS status, max(coalesce(updated_at, uploaded_at)) AS at FROM l GROUP BY id""")
def record_states(spark, sf):
    at = F.lpad(F.col("event_id").cast("string"), 9, "0")
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.when(F.col("event_id") % 3 != 0, at).alias("updated_at"), at.alias("uploaded_at"), F.col("event_type").alias("status")
    )
    return articles.latest_records(log).select("id", "status", F.coalesce("updated_at", "uploaded_at").alias("at"))


@query("""
SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY w DESC, doc_id) - 1 AS INTEGER) AS place
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE lpad(CAST(doc_id AS VARCHAR), 9, '0') END AS w FROM documents) WHERE w <> ''""")
def article_order(spark, sf):
    at = F.when(F.col("doc_id") % 10 != 0, F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    records = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), at.alias("uploaded_at"), F.lit("processed").alias("status"))
    listed = articles.listed(records).select("id", "uploaded_at").where("uploaded_at is not null")
    return listed.select("id", (F.row_number().over(Window.orderBy(F.col("uploaded_at").desc(), "id")) - 1).alias("place"))


@query(f"""
SELECT doc_id, {SHORT.replace("text)", "j)")} FROM (SELECT doc_id, string_agg(text || chr(10) || chr(10), '' ORDER BY i) AS j FROM (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) GROUP BY doc_id)""")
def joined_lines(spark, sf):
    from ..sources.sinks import joined_paragraphs

    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("text_index", "text"))
    return joined_paragraphs(rows).select("doc_id", *short())
