"""Named queries over the test tables, each with the equivalent DuckDB SQL.

The documents hold none of what the cleaners remove, so the queries decorate their texts first,
alike on both sides, by doc_id modulo small numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import normalize as N
from ..functions import text as X
from ..operators import articles, clean, entities, frequency, project, removal, segment, spans, title
from .pipeline import term_frequencies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TERMS = {"that": "TECHNIQUE", "with": "TECHNIQUE", "this": "MODEL", "tion": "MODEL", "from": "METRIC", "ment": "METRIC", "rewh": "DATASET", "elle": "DATASET"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def decorated(spark: SparkSession, sf_dir: str, extra: tuple[str, ...]) -> DataFrame:
    """(doc_id, text) with one of `extra` after the text, by doc_id modulo their number."""
    docs = table(spark, sf_dir, "documents")
    turn = F.get(F.array(*map(F.lit, extra)), F.pmod(F.col("doc_id"), F.lit(len(extra))).cast("int"))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), turn).alias("text"))


def by_turn(*choices: str) -> tuple[tuple[str, ...], str]:
    """The choices, for decorated(), and the same in DuckDB's SQL."""
    cases = (f" WHEN doc_id % {len(choices)} = {i} THEN {_text(c)}" for i, c in enumerate(choices))
    return choices, f" CASE{''.join(cases)} END"


def _text(s: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


def _decorated_sql(duck: str) -> str:
    return f"(SELECT doc_id, coalesce(text, '') || ({duck}) AS text FROM documents)"


def short(c: str = "text") -> list[Column]:
    """What is compared of a long text: its hash and length."""
    return [F.md5(F.col(c).cast("binary")).alias("text_md5"), F.length(c).cast("long").alias("n_chars")]


SHORT = "md5(text) AS text_md5, length(text) AS n_chars"

# ---- entity frequencies and other aggregates

_LEXICON = ", ".join(f"('{t}', '{label}')" for t, label in TERMS.items())
_SIZE = """CASE WHEN frequency <= 1 THEN 9.0 WHEN greatest(2, top) <= 2 THEN 16.0 ELSE
  16 + 44 * pow(least(1.0, greatest(0.0, (ln(greatest(frequency, 2)) - ln(2)) / greatest(ln(greatest(2, top)) - ln(2), 1e-9))), 0.65) END"""
_WINDOWS = r"""
words AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
chunks AS (
  SELECT doc_id, k AS chunk_index, CASE WHEN len(w) <= 320 THEN text ELSE array_to_string(w[k * 295 + 1:k * 295 + 320], ' ') END AS chunk
  FROM (SELECT *, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 320) / 295.0) AS INTEGER)))) AS k FROM words WHERE len(w) > 0))"""


@query(f"""
WITH {_WINDOWS},
tokens AS (SELECT doc_id, chunk_index, unnest(t) AS entity, generate_subscripts(t, 1) - 1 AS k FROM (SELECT doc_id, chunk_index, regexp_extract_all(chunk, '[A-Za-z]+') AS t FROM chunks)),
lexicon(key, label) AS (VALUES {_LEXICON}),
hits AS (SELECT lower(entity) AS key, entity, label, doc_id, chunk_index, k FROM tokens JOIN lexicon ON lower(entity) = lexicon.key),
grouped AS (SELECT key, arg_min(entity, (doc_id, chunk_index, k)) AS entity, count(*) AS frequency, any_value(label) AS label FROM hits GROUP BY key),
topped AS (SELECT *, max(frequency) OVER () AS top FROM grouped)
SELECT key, entity, frequency, label, round({_SIZE}, 6) AS size FROM topped""")
def entity_frequency(spark, sf):
    rows = term_frequencies(table(spark, sf, "documents"), TERMS)
    return rows.withColumn("size", F.round("size", 6))


@query("""
WITH per AS (SELECT user_id, event_type AS label, count(*) AS n, min(event_id) AS o FROM events GROUP BY ALL)
SELECT user_id, label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o) AS r FROM per) WHERE r = 1""")
def dominant_label(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("label"))
    return frequency.dominant_label(events, ["user_id"], "label", "event_id")


@query("SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, md5(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS ids_md5 FROM embeddings GROUP BY label")
def label_series(spark, sf):
    pts = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    rows = frequency.label_series(pts, "vec_id")
    ids = F.array_join(F.transform("points", lambda p: p["vec_id"].cast("string")), ",")
    return rows.select("label", F.size("points").cast("long").alias("n"), F.md5(ids.cast("binary")).alias("ids_md5"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, max(value) AS top FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, round(max(top) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS running_max FROM d""")
def running_global_max(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.max("value").alias("top"))
    return project.running_max(days, "day", "top").select("day", F.round("running_max", 6).alias("running_max"))


@query("""
WITH p AS (SELECT doc_id AS sentence_id, CASE WHEN doc_id % 7 = 0 THEN 'TITLE: ' || text ELSE text END AS sentence_text FROM documents)
SELECT count(DISTINCT sentence_id) AS paragraphs FROM p WHERE NOT regexp_matches(sentence_text, '(?i)^\\s*TITLE:')""".replace("\\\\", "\\"))
def paragraphs_with_entities(spark, sf):
    docs = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("TITLE: "), "text")).otherwise(F.col("text"))
    return frequency.paragraphs_with_entities(docs.select(F.col("doc_id").alias("sentence_id"), text.alias("sentence_text")))


@query("SELECT count(*) AS entities, count(DISTINCT user_id) AS paragraphs FROM events")
def entity_totals(spark, sf):
    return frequency.totals(table(spark, sf, "events").select(F.col("user_id").alias("sentence_id")))


@query("SELECT max(n) AS max_frequency FROM (SELECT count(*) AS n FROM events WHERE trim(event_type) <> '' GROUP BY lower(event_type))")
def max_entity_frequency(spark, sf):
    return frequency.max_frequency(table(spark, sf, "events").select(F.col("event_type").alias("entity")))


@query("""
SELECT user_id AS sentence_id, arg_min(props, event_id) AS sentence_text, min(event_id) AS first, count(*) AS n,
  md5(string_agg(event_type, ',' ORDER BY event_id)) AS entities_md5 FROM events GROUP BY user_id""")
def entities_by_sentence(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("sentence_id"), F.col("props").alias("sentence_text"), F.col("event_id").alias("id"), F.col("event_type").alias("entity"), F.col("event_type").alias("label")
    )
    names = F.array_join(F.transform("entities", lambda x: x["entity"]), ",")
    rows = frequency.by_sentence(e)
    return rows.select("sentence_id", "sentence_text", "first", F.size("entities").cast("long").alias("n"), F.md5(names.cast("binary")).alias("entities_md5"))


@query("SELECT user_id AS id, max(event_id) AS last_event, arg_max(event_type, event_id) AS entity FROM events GROUP BY user_id")
def entity_map(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("last_event"), F.col("event_type").alias("entity"))
    return frequency.last_by_id(e, "last_event")


@query("""
WITH own AS (SELECT * FROM events WHERE lower(event_type) = 'click'),
top AS (SELECT arg_min(l, (-n, o)) AS label FROM (SELECT user_id % 3 AS l, count(*) AS n, min(event_id) AS o FROM own GROUP BY 1))
SELECT event_id AS id, CAST(label AS VARCHAR) AS label FROM own, top""")
def expand_entity(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("entity"), (F.col("user_id") % 3).cast("string").alias("label"))
    return frequency.expanded(e, "click").select("id", "label")


_COLOURS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schemas.COLOURS.items())
_NAMES = list(schemas.COLOURS) + ["OTHER"]


@query(f"""
SELECT vec_id, label, CASE label {_COLOURS} ELSE '#666' END AS colour
FROM (SELECT vec_id, list_extract({_NAMES}, CAST(label % 8 + 1 AS BIGINT)) AS label FROM embeddings)""")
def label_colour_join(spark, sf):
    names = F.array(*map(F.lit, _NAMES))
    pts = table(spark, sf, "embeddings").select("vec_id", F.get(names, F.col("label") % 8).alias("label"))
    return frequency.with_colours(pts)


@query(f"""
WITH g AS (SELECT event_type, user_id, count(*) AS frequency FROM events GROUP BY ALL), t AS (SELECT *, max(frequency) OVER () AS top FROM g)
SELECT event_type, user_id, round({_SIZE}, 6) AS size, round(greatest(14.0, 0.55 * {_SIZE}), 6) AS expanded FROM t""")
def bubble_size(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("frequency"))
    rows = frequency.sized(g)
    return rows.select("event_type", "user_id", F.round("size", 6).alias("size"), F.round(project.expanded_size("size"), 6).alias("expanded"))


@query("SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)")
def axis_extent(spark, sf):
    pts = table(spark, sf, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    e = project.axis_extent(pts)
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


@query("""
SELECT id, round(sqrt(pow(x - 0.1, 2) + pow(y - 0.1, 2)), 6) AS distance
FROM (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
WHERE sqrt(pow(x - 0.1, 2) + pow(y - 0.1, 2)) <= 10 ORDER BY sqrt(pow(x - 0.1, 2) + pow(y - 0.1, 2)), id LIMIT 1""")
def nearest_point(spark, sf):
    pts = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y")
    )
    return project.nearest(pts, 0.1, 0.1, 10.0).select("id", F.round("distance", 6).alias("distance"))


# ---- vectors


@query("""
WITH c AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 5) AS v FROM c GROUP BY ALL""")
def mean_pool(spark, sf):
    rows = entities.mean_pooled(table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), ["label"], "embedding")
    return rows.select("label", F.posexplode("embedding").alias("dim", "v")).select("label", "dim", F.round(F.col("v").cast("double"), 5).alias("v"))


@query("""
WITH c AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
m AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM c GROUP BY dim)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS z FROM c JOIN m USING (dim)""")
def standardize(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return project.standardized(e, "embedding", "vec_id").withColumn("z", F.round("z", 5))


@query()
def pca_2d(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return project.pca_points(e, "embedding").select("vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def tsne_2d(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return project.tsne_points(e, "embedding", "label", "vec_id")


@query("""
WITH t AS (SELECT o_orderkey AS doc_id, l_linenumber AS k, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + l_linenumber % 3 AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 20 AS INTEGER) AS "start", CAST(o_custkey % 20 + 15 AS INTEGER) AS "end" FROM orders)
SELECT t.doc_id, k, s, e FROM n JOIN t USING (doc_id) WHERE s >= "start" AND e <= "end" AND e > s""")
def token_entity_join(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    tokens = items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("k"), q.alias("s"), (q + F.col("l_linenumber") % 3).alias("e"))
    tokens = tokens.join(orders.select(F.col("o_orderkey").alias("doc_id")), "doc_id", "left_semi")
    own = (F.col("o_custkey") % 20).cast("int")
    ents = orders.select(F.col("o_orderkey").alias("doc_id"), own.alias("start"), (own + 15).alias("end"))
    return entities.contained_tokens(ents, tokens, ["doc_id"]).select("doc_id", "k", "s", "e")


@query(r"""
WITH w AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS k FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS t FROM conversations)),
g AS (SELECT *, CASE WHEN length(token) % 4 = 0 THEN 'B-MODEL' WHEN length(token) % 4 = 1 THEN 'I-MODEL' WHEN length(token) % 4 = 2 THEN 'I-METRIC' ELSE 'O' END AS tag FROM w),
c AS (SELECT *, regexp_replace(tag, '^[BI]-', '') AS cls FROM g),
n AS (SELECT *, CASE WHEN lag(cls) OVER x IS NULL OR lag(cls) OVER x <> cls OR tag LIKE 'B-%' THEN 1 ELSE 0 END AS new FROM c WINDOW x AS (PARTITION BY conv_id, turn ORDER BY k)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY k) AS island FROM n WHERE TRUE)
SELECT conv_id, turn, any_value(cls) AS entity_group, CAST(min(k) AS INTEGER) AS "start", CAST(max(k) + 1 AS INTEGER) AS "end" FROM i WHERE tag <> 'O' GROUP BY conv_id, turn, island""")
def bio_islands(spark, sf):
    c = table(spark, sf, "conversations")
    w = c.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("k", "token"))
    n = F.length("token") % 4
    tag = F.when(n == 0, "B-MODEL").when(n == 1, "I-MODEL").when(n == 2, "I-METRIC").otherwise("O")
    w = w.select("conv_id", "turn", "k", tag.alias("tag"), F.lit(1.0).alias("score"), F.col("k").alias("start"), (F.col("k") + 1).alias("end"))
    return entities.tag_islands(w, ["conv_id", "turn"]).drop("score")


@query(f"SELECT doc_id, CASE WHEN doc_id % 20 BETWEEN 0 AND 14 THEN list_extract({list(schemas.TAGS)}, CAST(doc_id % 20 + 1 AS BIGINT)) END AS tag FROM documents")
def tag_names(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 20).cast("int").alias("i"))
    return d.select("doc_id", entities.tag_name("i").alias("tag"))


# ---- segmentation


@query(f"WITH {_WINDOWS} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS text_md5, length(chunk) AS n_chars FROM chunks")
def word_chunks(spark, sf):
    return segment.word_windows(table(spark, sf, "documents")).select("doc_id", "chunk_index", *short("chunk"))


@query(r"""
WITH p AS (SELECT doc_id, trim(text[k * 450 + 1:k * 450 + 450], E' \t\n\r') AS text, k
  FROM (SELECT doc_id, text, unnest(generate_series(0, (greatest(length(text), 1) - 1) // 450)) AS k FROM documents)),
kept AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM p WHERE length(text) > 30 AND regexp_matches(text, '\pL'))
SELECT doc_id, CAST(i AS INTEGER) AS text_index, md5(text) AS text_md5, length(text) AS n_chars FROM kept""")
def fixed_width_split(spark, sf):
    rows = segment.exploded(table(spark, sf, "documents"), segment.fixed_width("text", 450, 30))
    return rows.select("doc_id", "text_index", *short())


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
s AS (SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS i, len(a) AS n FROM l),
k AS (SELECT *, CASE WHEN n > 5 THEN greatest(n // 5, 1) ELSE 1 END AS step FROM s)
SELECT doc_id, CAST(i // step AS INTEGER) AS text_index, md5(text) AS text_md5, length(text) AS n_chars FROM k WHERE i % step = 0 AND (n <= 5 OR i // step < 5)""")
def systematic_sample(spark, sf):
    rows = segment.exploded(table(spark, sf, "documents"), segment.sampled(F.split("text", "\n"), 5))
    return rows.select("doc_id", "text_index", *short())


_BLANKS = by_turn("\n\nSecond part that is long enough to stay as a paragraph of its own.\n\n12345", "\n\nshort\n\nAnother paragraph, of fifty characters or so, to keep here.", "")


@query(r"""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'TITLE: A title' || chr(10) WHEN 1 THEN 'first' || chr(10) || chr(10) ELSE '' END || text AS text FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_concat(['TITLE: A title'], string_split_regex(regexp_replace(text, '^TITLE: A title\n', ''), '\n\s*\n')) ELSE string_split_regex(text, '\n\s*\n') END AS p FROM t),
s AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM b)
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS text_index, md5(unnest(p)) AS text_md5 FROM s""")
def title_block_split(spark, sf):
    pre = F.when(F.col("doc_id") % 3 == 0, F.lit("TITLE: A title\n")).when(F.col("doc_id") % 3 == 1, F.lit("first\n\n")).otherwise("")
    d = table(spark, sf, "documents").select("doc_id", F.concat(pre, "text").alias("text"))
    return segment.exploded(d, segment.article_parts("text")).select("doc_id", "text_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- normalisation


def _projected(name: str, extra: tuple[tuple[str, ...], str], spark_side: Callable[[Column], Column], duck: str) -> None:
    """A query of one text function on decorated documents; duck is SQL over `text`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = decorated(spark, sf_dir, extra[0])
        return rows.withColumn("text", spark_side(F.col("text"))).select("doc_id", *short())

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = f"SELECT doc_id, {SHORT} FROM (SELECT doc_id, {duck} AS text FROM {_decorated_sql(extra[1])})"


def _replaced(expr: str, *pairs: tuple[str, str], flags: str = "g") -> str:
    for pattern, to in pairs:
        expr = f"regexp_replace({expr}, '{pattern}', {to}, '{flags}')"
    return expr


_moji = "text"
for _bad, _good in N.MOJIBAKE:
    _quoted = [x.replace("'", "''").replace("\x9d", "' || chr(157) || '") for x in (_bad, _good)]
    _moji = f"replace({_moji}, '{_quoted[0]}', '{_quoted[1]}')"
_projected("mojibake_fix", by_turn(" Â© 2020 Ã— â€œquotedâ€\x9d", " donâ€™t â€“ Â½ Â·", "Â plain"), N.fix_mojibake, _moji)
ORACLE["mojibake_fix"] = ORACLE["mojibake_fix"].replace("\x9d", "' || chr(157) || '")
_projected(
    "whitespace_norm", by_turn("\n\n\n\nmany   blanks\n  indented", "\t\ttabs\n\n x", "x\n\n\ny"), N.remove_extra_whitespace,
    _replaced("text", (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n\s+", "chr(10)"), (r"\A\s+", "chr(10)")),
)
_projected(
    "pdf_normalize", by_turn(" ____ x ------ y\x07z", " ==== two  blanks \t tab", "Â keep - this _ one ="), N.normalize_extracted,
    _replaced("replace(text, 'Â', '')", (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "' '"), (r"[_\-]{4,}", "' '"), (r"={3,}", "' '"), (r"[ \t]{2,}", "' '")),
)
_projected(
    "spacing_fix", by_turn(" exam-\nple SomeNet.Then", " a\nb  c\n\n\nd", " ﬁne ﬂow • dot"), N.fix_spacing,
    r"regexp_replace("
    + _replaced(
        f"translate(replace(replace(replace({_moji}, chr(173), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '‐‑–—•·' || chr(160), '----   ')",
        (r"-\n([\w\pL])", r"'\1'"), (r"(?i)([a-záéíóúñ])\n([a-záéíóúñ])", r"'\1 \2'"), (r"\.([A-Z])", r"'. \1'"), ("([a-z])([A-Z])", r"'\1 \2'"),
        (" +", "' '"), (r"\t+", "' '"), (r"\n\n+", "chr(10) || chr(10)"),
    ) + r", '^\s+|\s+$', '', 'g')",
)


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS html_md5 FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(N.escape_html("html").cast("binary")).alias("html_md5"))


@query(r"SELECT doc_id, lower(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS key FROM (SELECT doc_id, '  ' || string_split(text, chr(10))[1] || '   End ' AS line FROM documents)")
def entity_keys(spark, sf):
    line = F.concat(F.lit("  "), F.get(F.split("text", "\n"), F.lit(0)), F.lit("   End "))
    return table(spark, sf, "documents").select("doc_id", N.entity_key(line).alias("key"))


@query("SELECT event_id, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS eta FROM (SELECT event_id, event_id % 400 AS s FROM events)")
def eta_text(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("event_id") % 400).alias("s")).select("event_id", N.eta_text("s").alias("eta"))


@query("""
SELECT doc_id, line FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'Loading weights 3%' WHEN 2 THEN ' Procesando: x' ELSE 'error ' || doc_id END AS line FROM documents)
WHERE trim(line) <> '' AND trim(line) NOT LIKE 'Loading weights%' AND trim(line) NOT LIKE 'Procesando:%'""")
def log_filter(spark, sf):
    k = F.col("doc_id") % 4
    line = F.when(k == 0, "  ").when(k == 1, "Loading weights 3%").when(k == 2, " Procesando: x").otherwise(F.concat(F.lit("error "), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", line.alias("line")).where(~N.is_log_noise("line"))


@query(r"SELECT page_id, regexp_extract(url, '[^/\\]*$') AS name, lower(regexp_extract(regexp_extract(url, '[^/\\]*$'), '(\.[^.]+)$', 1)) AS suffix FROM pages")
def file_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.file_name("url").alias("name"), N.file_suffix("url").alias("suffix"))


# ---- removal

_projected("strip_urls", by_turn(" see http://www.a.org/b now", " www.c.de https://d.e", ""), removal.remove_urls, _replaced("text", (r"https?://[^\s]+", "''"), (r"www\.[^\s]+", "''")))
_projected(
    "strip_citations", by_turn(" (Smith, 2020) and (Lee 1999)", " (Smith et al., 2019) (smith, 2020)", ""), removal.remove_citations,
    _replaced("text", (r"\([A-Z][a-z]+\s*(?:et\s+al\.?)?,?\s*\d{4}\)", "''"), (r"\([A-Z][a-z]+\s+\d{4}\)", "''")),
)
_projected(
    "strip_figures", by_turn(" Fig. 3 shows x. See Table", " as shown in Table 4\nand more. end", " config 3 is set. ok"), removal.remove_figures_tables,
    _replaced("text", (r"(?i)(?:Fig(?:ure)?|Table|Eq\.?|Equation)\s*\.?\s*\d+[^.]*\.?", "''")),
)
_projected(
    "strip_special", by_turn("\nWe thank funding bodies.\nNext", "\nAbstract of this\nAcknowledgments to all", "\nAppendix A is here\nEnd"), removal.remove_special_sections,
    _replaced("text", (r"(?i)(?:Abstract|Acknowledgments?|Funding|Conflicts? of Interest|Author Contributions|Data Availability)[^\n]*", "''"), (r"(?i)\A()Appendix[^\n]*", "''"), (r"(?i)\nAppendix[^\n]*", "''")),
)
_REFS = by_turn("\nReferences\n[1] x", "\nBibliography of nothing here\n", "")
_projected(
    "strip_references", _REFS, removal.remove_references,
    r"CASE WHEN regexp_matches(text, '(?i)(?:\n|\A)(References|Bibliography|Works Cited)\b') AND length(regexp_extract(text, '(?is)\A(.*?)(?:\n|\A)(?:References|Bibliography|Works Cited)\b', 1)) >= floor(length(text) * 0.6::DOUBLE)"
    r" THEN regexp_replace(regexp_extract(text, '(?is)\A(.*?)(?:\n|\A)(?:References|Bibliography|Works Cited)\b', 1), '\s+$', '') ELSE text END",
)
_projected(
    "strip_references_anywhere", _REFS, lambda c: removal.remove_references(c, 0.0),
    r"CASE WHEN regexp_matches(text, '(?i)(?:\n|\A)(References|Bibliography|Works Cited)\b')"
    r" THEN regexp_replace(regexp_extract(text, '(?is)\A(.*?)(?:\n|\A)(?:References|Bibliography|Works Cited)\b', 1), '\s+$', '') ELSE text END",
)
_projected(
    "strip_headers_footers", by_turn("\nPage 3 of 12\nVol. 4 of all\nx", "\nISSN 1234-567X\ndoi: 10.1/x y", "\n3 / 12 "), removal.remove_headers_footers,
    _replaced(
        "text", (r"(?i)(?:\A|\n)Page\s+\d+\s*(?:of\s+\d+)?", "chr(10)"), (r"(?:\A|\n)\d+\s*/\s*\d+\s*\z", "chr(10)"), (r"(?i)(?:\A|\n)Vol\.?\s*\d+[^\n]*", "chr(10)"),
        (r"(?i)(?:\A|\n)ISSN\s*\d{4}-\d{3}[\dxX]", "chr(10)"), (r"(?i)(?:\A|\n)doi:\s*\S+", "chr(10)"),
    ),
)
_projected(
    "strip_boilerplate", by_turn("\nContents lists available at X\njournal homepage: y\nz", "\nKeywords: a; b\nReceived 3 May\nq", "\nA R T I C L E I N F O here\nAvailable online 4"), removal.remove_boilerplate,
    _replaced(
        "text", *[(p, "chr(10)") for p in (
            r"(?i)(?:\A|\n)Contents lists available at[^\n]*", r"(?i)(?:\A|\n)journal homepage:[^\n]*", r"(?i)(?:\A|\n)A\s+R\s+T\s+I\s+C\s+L\s+E\s+I\s+N\s+F\s+O[^\n]*",
            r"(?i)(?:\A|\n)Keywords?:[^\n]*", r"(?i)(?:\A|\n)Received\s+[^\n]*", r"(?i)(?:\A|\n)Accepted\s+[^\n]*", r"(?i)(?:\A|\n)Available\s+online[^\n]*")],
    ),
)
_projected(
    "strip_inline_noise", by_turn("\nx ARTICLE INFO y\nz", " * Corresponding author. me\nE-mail address: a b", "\nArticle history: q"), removal.remove_inline_noise,
    _replaced("text", (r"(?i)ARTICLE INFO[^\n]*", "' '"), (r"(?i)Article history:[^\n]*", "' '"), (r"(?i)\*+\s*Corresponding authors?\.[^\n]*", "' '"), (r"(?i)E-?mail addresses?:[^\n]*", "' '")),
)
_projected(
    "front_matter", by_turn("", ""), lambda c: removal.strip_front_matter(F.concat(F.lit("Some Authors\nIntroduction to it\n"), c), F.when(F.col("doc_id") % 2 == 0, F.lit("A Title"))),
    "CASE WHEN doc_id % 2 = 0 THEN 'TITLE: A Title' || chr(10) || chr(10) ELSE '' END || CASE WHEN 12 < floor((length(text) + 33) * 0.55::DOUBLE) THEN 'Introduction to it' || chr(10) || text ELSE 'Some Authors' || chr(10) || 'Introduction to it' || chr(10) || text END",
)


def _line_query(name: str, extra: tuple[tuple[str, ...], str], spark_side: Callable[[Column], Column], drop: str) -> None:
    """A query of a line filter; drop is SQL over line and s, its stripped form."""
    _projected(name, extra, spark_side, "text")
    ORACLE[name] = rf"""
    WITH t AS {_decorated_sql(extra[1])},
    l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM t)),
    s AS (SELECT doc_id, i, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l WHERE NOT (i = n AND line = '')),
    k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM s WHERE NOT coalesce({drop}, FALSE) GROUP BY doc_id)
    SELECT doc_id, md5(coalesce(k.text, '')) AS text_md5, length(coalesce(k.text, '')) AS n_chars FROM t LEFT JOIN k USING (doc_id)"""


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(s, '{pattern}'))"


_NOISE = "|".join(removal.NOISY_LINES).replace("'", "''")
_line_query("line_noise_filter", by_turn("\nme@x.org wrote\nkeep", "\nPublished by Elsevier B.V.\n  Contents  ", "\n1234-5678 code\nRevised 3 May"), removal.remove_noisy_lines, rf"s <> '' AND regexp_matches(s, '(?i)(?:{_NOISE})')")
_line_query(
    "toc_filter", by_turn("\n1.2 Methods ...... 12\nkeep", "\n3 Results and more 14\nx", "\n2 words only\n"), removal.remove_toc_lines,
    r"regexp_matches(line, '\.{4,}\s*\d+\s*$') OR (regexp_matches(line, '^\s*\d+(\.\d+)*\s+.*$') AND regexp_matches(line, '\s+\d+\s*$'))",
)
_line_query(
    "dense_table_filter", by_turn("\nABC 12 | 34 % DEF 56 | 78 % GHI (90) [12] {34} JKL 56 | 78 % MNO 90 = 12", "\nSummary of all\nx", ""), removal.remove_dense_table_lines,
    rf"s <> '' AND (s LIKE '%/C2%' OR s LIKE '%FDA approval%' OR s LIKE '%Scanner system%' OR s LIKE '%Summary of %' OR (length(s) > 60 AND {_n(r'[\p{Nd}]')} / length(s) > 0.15"
    rf" AND {_n(r'[/\\|%_=+\[\]()<>:;,*]')} / length(s) > 0.08 AND CASE WHEN {_n(r'\pL')} > 0 THEN {_n(r'\p{Lu}')} / {_n(r'\pL')} ELSE 0 END > 0.45))",
)
_line_query(
    "garbled_filter", by_turn("\nXKCDQRT7 BZPFGH9K LMNPQRSTVW XZ", "\nÂÃÅÆÍ¿€‰ some words here too", "\nplain"), removal.remove_garbled_lines,
    rf"s <> '' AND (({_n(r'\pL')} >= 25 AND {_n(r'\p{Ll}')} / greatest({_n(r'\pL')}, 1) < 0.18 AND {_n('[aeiouAEIOU]')} / greatest({_n(r'\pL')}, 1) < 0.22)"
    rf" OR (({_n('[ÂÃÅÆÍ¿€‰]')} / length(s) > 0.08 OR {_n(r'[^\x00-\x7F]')} / length(s) > 0.25) AND length(s) >= 20)"
    rf" OR (len(list_filter(string_split_regex(s, '[^\pL\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z0-9]{{6,}}'))) >= 2 AND length(s) >= 20 AND CASE WHEN {_n(r'\pL')} > 0 THEN {_n(r'\p{Ll}')} / {_n(r'\pL')} ELSE 1 END < 0.45))",
)


@query(rf"""
WITH t AS {_decorated_sql(by_turn('''
Page 7
hello
Page 7
hello
Page 7
hello''', '''
Page 7''')[1])},
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM t)),
s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM s),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM c WHERE NOT (n >= 3 AND s <> '' AND length(s) <= 120 AND regexp_matches(s, '(?i)(lab invest|et al\.|^\d+$|^\d+\s+\d+\s+\d+|^page\s+\d+)')) GROUP BY doc_id)
SELECT doc_id, {SHORT} FROM k""")
def repeated_lines(spark, sf):
    extra = by_turn("\nPage 7\nhello\nPage 7\nhello\nPage 7\nhello", "\nPage 7")[0]
    return removal.remove_repeated_lines(decorated(spark, sf, extra)).select("doc_id", *short())


_TABLES = by_turn("\nTable 3 lists\na 1 2\nb 3 4\n\nafter it", "\nsome long prefix of more than fifty characters with eight or more spaces Table 2\nrow\nMethods follow", "\nTable 1\nTable 2\nx\n\nTable 9")


@query(rf"""
WITH t AS {_decorated_sql(_TABLES[1])},
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM t)),
s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l WHERE NOT (i = n AND line = '')),
f AS (SELECT *, regexp_matches(s, '(?i)\bTable\s+\d+\b') AS is_start,
  s = '' OR regexp_matches(s, '(?i)^(Introduction|Methods?|Results?|Discussion|Conclusion|References)\b') OR
  ({_n('[A-Za-z]{2,}')} >= 14 AND s LIKE '%.' AND {_n(r'\pL')} > 60 AND {_n(r'[/\\|%_=+\[\]()<>:;,*]')} / greatest(length(s), 1) < 0.07) AS is_break FROM s),
w AS (SELECT *, max(CASE WHEN is_start THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls,
  max(CASE WHEN is_break THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS lb FROM f),
x AS (SELECT *, ls IS NOT NULL AND (lb IS NULL OR lb <= ls) AS inside FROM w),
p AS (SELECT *, regexp_replace(regexp_extract(s, '(?i)^(.*?)\bTable\s+\d+\b', 1), '^\s+|\s+$', '', 'g') AS prefix FROM x),
o AS (SELECT doc_id, i, CASE WHEN NOT inside AND NOT is_start THEN line WHEN is_start AND NOT inside AND length(prefix) >= 50 AND length(prefix) - length(replace(prefix, ' ', '')) >= 8 THEN prefix END AS line FROM p),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM o WHERE line IS NOT NULL GROUP BY doc_id)
SELECT doc_id, md5(coalesce(k.text, '')) AS text_md5, length(coalesce(k.text, '')) AS n_chars FROM t LEFT JOIN k USING (doc_id)""")
def table_block_skip(spark, sf):
    return decorated(spark, sf, _TABLES[0]).withColumn("text", removal.remove_table_blocks("text")).select("doc_id", *short())


@query(rf"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
SELECT doc_id, CAST(i AS INTEGER) AS i, length(s) AS n, {_n(r'\pL')} AS letters, {_n(r'\p{Nd}')} AS digits, {_n(r'\p{Lu}')} AS upper, {_n(r'[^\x00-\x7F]')} AS non_ascii FROM l""")
def line_char_metrics(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    n = lambda c: c.cast("long")
    return rows.select(
        "doc_id", "i", n(F.length("s")).alias("n"), n(X.letters("s")).alias("letters"), n(X.count("s", r"\p{Nd}")).alias("digits"),
        n(X.count("s", r"\p{Lu}")).alias("upper"), n(X.count("s", r"[^\x00-\x7F]")).alias("non_ascii"),
    )


_STATS = by_turn("\nsee http://www.a.org/b (Smith, 2020) Fig. 3 shows x. end", "\nFunding by all\nwww.x.y z", "\nReferences\n[1] x")


@query()
def clean_pdf_profile(spark, sf):
    head = F.lit("Contents lists available at ScienceDirect\nLearning methods for large document collections\nJohn Smith, Mary Jones\nIntroduction\n")
    docs = decorated(spark, sf, _STATS[0]).withColumn("text", F.concat(head, "text"))
    return clean.clean_pdf(docs).select("doc_id", "title", *short())


# ---- titles


@query(r"""
WITH t AS (SELECT doc_id, list_transform(string_split(CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || 'title:  The name ' || chr(10) || text ELSE text END, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM documents)
SELECT doc_id, coalesce(nullif(regexp_replace(list_filter(l[1:30], lambda x: regexp_matches(x, '(?i)^TITLE:\s*(.+)$'))[1], '(?i)^TITLE:\s*', ''), ''),
  list_filter(l[1:60], lambda x: length(x) BETWEEN 15 AND 220 AND NOT regexp_matches(lower(x), '^(abstract|keywords|introduction)') AND NOT contains(lower(x), 'journal homepage') AND NOT contains(lower(x), 'contents lists available'))[1]) AS title FROM t""")
def title_from_text(spark, sf):
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x\ntitle:  The name \n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text")).select("doc_id", title.display_title("text").alias("title"))


@query()
def pdf_title(spark, sf):
    k = F.col("doc_id") % 3
    pre = F.when(k == 0, "Contents lists available at ScienceDirect\nLearning methods for large document collections\nJohn Smith, Mary Jones\n").when(
        k == 1, "Another study of many document kinds\nAnna Black*, Carl White\nUniversity of X\n"
    )
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce(pre, F.lit("")), "text").alias("text"))
    return d.select("doc_id", title.document_title("text").alias("title"), title.first_page_title("text").alias("header_title"))


# ---- spans


@query("""
SELECT conv_id, turn, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS INTEGER) AS n FROM conversations""")
def term_occurrences(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.size(spans.occurrences_of("text", F.lit("th"))).alias("n"))


_SPAN_TERMS = [("MODEL", "the"), ("TECHNIQUE", "t"), ("MODEL", "the"), ("METRIC", "er")]


def _span_rows(spark, sf):
    ents = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(e).alias("entity")) for i, (label, e) in enumerate(_SPAN_TERMS)])
    c = table(spark, sf, "conversations").withColumn("ents", ents)
    return c.withColumn("ranges", spans.assigned_spans("text", "ents"))


# ---- articles


@query("""
SELECT doc_id AS id, lang AS original_name, CAST(n_chars AS VARCHAR) AS uploaded_at FROM documents
WHERE doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels)""")
def servable_articles(spark, sf):
    d = table(spark, sf, "documents")
    status = F.when(F.col("doc_id") % 2 == 0, "processed").otherwise("failed")
    records = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("original_name"), F.col("n_chars").cast("string").alias("uploaded_at"), status.alias("status"))
    pts = table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"))
    return articles.listed(records, pts).drop("status")


@query("SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS stage, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id")
def progress_latest(spark, sf):
    log = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), "value")
    return articles.latest(log, ["user_id"], "seq").withColumn("value", F.round("value", 6))


_STAGES = ["queued", "processing", "ner", "tsne", "completed", "failed", "other"]
_STAGE_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in articles.STAGE_PERCENT.items())


@query(f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(5 + floor(70 * (event_id % 4) / 4) AS INTEGER) ELSE CASE list_extract({_STAGES}, CAST(event_id % 7 + 1 AS BIGINT)) {_STAGE_SQL} ELSE 50 END END AS percent FROM events""")
def stage_percent(spark, sf):
    e = table(spark, sf, "events")
    given = F.when(F.col("event_id") % 5 == 0, project.progress_percent(F.col("event_id") % 4, F.lit(4)))
    stage = F.get(F.array(*map(F.lit, _STAGES)), (F.col("event_id") % 7).cast("int"))
    return e.select("event_id", articles.percent_of(given, stage).alias("percent"))


@query(f"""
WITH s AS (SELECT event_id, list_extract(['uploaded','processing','processed','failed'], CAST(event_id % 4 + 1 AS BIGINT)) AS b, list_extract(['processing','processed','uploaded','failed','processing'], CAST(event_id % 5 + 1 AS BIGINT)) AS a FROM events)
SELECT event_id, ({" OR ".join(f"(b = '{k}' AND a IN ({', '.join(repr(x) for x in v)}))" for k, v in articles.TRANSITIONS.items() if k)}) AS allowed FROM s""")
def status_steps(spark, sf):
    e = table(spark, sf, "events")
    before = F.get(F.array(*map(F.lit, ["uploaded", "processing", "processed", "failed"])), (F.col("event_id") % 4).cast("int"))
    after = F.get(F.array(*map(F.lit, ["processing", "processed", "uploaded", "failed", "processing"])), (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", articles.allowed_step(before, after).alias("allowed"))


@query("SELECT page_id, CASE WHEN contains(lower(url), 'article') THEN 'article' ELSE 'texts' END AS kind FROM pages")
def output_routing(spark, sf):
    return table(spark, sf, "pages").select("page_id", articles.output_kind("url").alias("kind"))
