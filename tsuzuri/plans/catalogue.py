"""Registered queries of the analytics engine over the driver's tables, and the same in SQL.

Mapping: basename = doc_id, section = lang, genre1 = source, sentence = non-blank line; the bundled test
lexicon marks the first words and last endings of lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsuzuri.functions import text as tx
from tsuzuri.operators import extract, lexicon, network, reports, search, sections, segment, stats, structure
from tsuzuri.operators.lexicon import CONNECTIVE, FINAL, FIXTURE
from tsuzuri.sources import corpus, store
from tsuzuri.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = lambda spark, d: wide(f(spark, d))
        if sql:
            _SQL[name] = sql
        return f

    return keep


def wide(df: DataFrame) -> DataFrame:
    """Integers as long, as SQL engines count."""
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def secs(spark: SparkSession, d: str) -> DataFrame:
    return segment.sections(table(spark, d, "documents"))


def sents(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentences(secs(spark, d))


def found(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_matches(sents(spark, d))


def found_once(spark: SparkSession, d: str) -> DataFrame:
    """Matches for steps that read them several times; without texts of sentences and paragraphs, which each match would repeat."""
    return store.once(found(spark, d).select("section", "genre1", "sentence_id", "type", "expr", "position", "end_position", "span_text"))


def r6(c):
    return F.round(c, 6) + 0.0


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LEX = ", ".join(f"({_q(e.type)}, {_q(e.name)}, {_q(e.function)}, {_q(e.subclass)})" for e in FIXTURE)
_FIRST = "(?i)^\\s*(" + "|".join(e.name for e in FIXTURE if e.type == CONNECTIVE) + ")([^\\p{L}]|$)"
_LAST = "(?i)(" + "|".join(e.name for e in FIXTURE if e.type == FINAL) + ")[.!?]?\\s*$"
ALL = r"""WITH all_s AS (
 SELECT *, CAST('0x' || substr(md5(basename::VARCHAR || '|' || section || '|' || sentence_text), 1, 15) AS BIGINT) AS sentence_id FROM (
  SELECT basename, section, genre1, para, paragraph_text, unnest(string_split(paragraph_text, chr(10))) AS sentence_text, CAST(generate_subscripts(string_split(paragraph_text, chr(10)), 1) - 1 AS BIGINT) AS line FROM (
   SELECT doc_id AS basename, lang AS section, source AS genre1, unnest(string_split(text, chr(10) || chr(10))) AS paragraph_text, CAST(generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS BIGINT) AS para FROM documents))
 WHERE regexp_matches(sentence_text, '\S'))"""
SENT = ALL + """,
s AS MATERIALIZED (SELECT * FROM all_s QUALIFY row_number() OVER (PARTITION BY sentence_id ORDER BY basename, para, line) = 1)"""
MATCH = (
    SENT
    + f""",
lex(type, expr, func, subfunc) AS (VALUES {_LEX}),
hit AS (SELECT *, '{CONNECTIVE}' AS type, lower(regexp_extract(sentence_text, '{_FIRST}', 1)) AS expr, CAST(length(regexp_extract(sentence_text, '^\\s*', 0)) AS BIGINT) AS position FROM s WHERE regexp_matches(sentence_text, '{_FIRST}')
  UNION ALL SELECT *, '{FINAL}', lower(regexp_extract(sentence_text, '{_LAST}', 1)), CAST(length(sentence_text) - length(regexp_extract(sentence_text, '{_LAST}', 0)) AS BIGINT) FROM s WHERE regexp_matches(sentence_text, '{_LAST}')),
best AS MATERIALIZED (SELECT basename, section, genre1, sentence_id, sentence_text, type, expr, func, subfunc, position, length(expr) AS len, position + length(expr) AS end_position FROM hit JOIN lex USING (type, expr)),
m AS MATERIALIZED (SELECT basename, section, genre1, sentence_id, sentence_text, type, expr, func, subfunc, position, end_position, substr(sentence_text, position + 1, len) AS span_text, CASE WHEN length(sentence_text) > 0 THEN position / length(sentence_text) ELSE 0 END AS rel_position FROM best a
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.sentence_id = a.sentence_id AND b.type <> a.type AND a.position < b.end_position AND b.position < a.end_position)),
p AS (SELECT sentence_id, type, expr, min(position) AS position FROM m GROUP BY ALL),
pr AS (SELECT sentence_id, c.expr AS conn, f.expr AS final, c.position AS conn_pos, f.position AS final_pos FROM p c JOIN p f USING (sentence_id) WHERE c.type = '{CONNECTIVE}' AND f.type = '{FINAL}')"""
)


@query("sentences", SENT + " SELECT basename, section, genre1, para, line, sentence_id, sentence_text FROM s")
def _(spark, d):
    return sents(spark, d).select("basename", "section", "genre1", "para", "line", "sentence_id", "sentence_text")


@query("all_sentences", ALL + " SELECT basename, section, para, line, sentence_id, sentence_text FROM all_s")
def _(spark, d):
    return segment.all_sentences(secs(spark, d)).select("basename", "section", "para", "line", "sentence_id", "sentence_text")


@query("paragraph_split", r"SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS para, p AS paragraph_text FROM (SELECT conv_id, turn, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT conv_id, turn, string_split_regex(regexp_replace(text, '(?m)^[ \t]+$', '', 'g'), '\n{2,}') AS x FROM conversations)) WHERE regexp_matches(p, '\S')")
def _(spark, d):
    return segment.paragraphs(table(spark, d, "conversations")).select("conv_id", "turn", "para", "paragraph_text")


_SEG = """SELECT doc_id AS basename, CAST(i AS BIGINT) AS segment_index, CAST(i * 60 AS BIGINT) AS start_char, CAST(least(i * 60 + 60, length(text)) AS BIGINT) AS end_char,
 CASE WHEN length(substr(text, i * 60 + 1, 60)) > 50 THEN substr(text, i * 60 + 1, 50) || '...' ELSE substr(text, i * 60 + 1, 60) END AS preview
 FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, greatest(1, CAST(ceil(length(coalesce(text, '')) / 60) AS BIGINT)))) AS i FROM documents)"""


@query("char_segments", _SEG)
def _(spark, d):
    return segment.segments(secs(spark, d)).select("basename", "segment_index", "start_char", "end_char", "preview")


@query("segment_wrap_grid", f"SELECT basename, segment_index, segment_index % 10 AS col, segment_index // 10 AS row FROM ({_SEG})")
def _(spark, d):
    return segment.wrap(segment.segments(secs(spark, d)), "segment_index", 10).select("basename", "segment_index", "col", "row")


@query("long_text_chunks")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(segment.split_long(F.regexp_replace("text", r"\.", "。"), 500)).alias("chunk", "body"))


_IGN = tx.CJK_IGNORED.replace("'", "''")


@query("script_ratio", f"SELECT conv_id, turn, CASE WHEN length(b) = 0 THEN 0.0 ELSE round(length(regexp_replace(b, '[^{tx.CJK}]', '', 'g')) / length(b), 6) END AS share FROM (SELECT conv_id, turn, regexp_replace(text, '[\\s{_IGN}]', '', 'g') AS b FROM conversations)")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", r6(tx.cjk_share(F.col("text"))).alias("share"))


@query("cjk_ratio_filter", f"SELECT doc_id FROM (SELECT doc_id, text, regexp_replace(text, '[\\s{_IGN}]', '', 'g') AS b FROM (SELECT doc_id, translate(text, 'aeiourn', 'あえいおうらん') AS text FROM documents)) WHERE length(b) > 0 AND ((length(b) <= 10 AND length(regexp_replace(b, '[^{tx.CJK}]', '', 'g')) >= 1) OR (length(text) > 100 AND length(regexp_replace(b, '[^{tx.CJK}]', '', 'g')) > 20) OR length(regexp_replace(b, '[^{tx.CJK}]', '', 'g')) / length(b) >= 0.6)")
def _(spark, d):
    kana = table(spark, d, "documents").withColumn("text", F.translate("text", "aeiourn", "あえいおうらん"))
    return kana.where(tx.mostly_cjk(F.col("text"))).select("doc_id")


@query("collapse_whitespace", f"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</?sup\\b[^>]*>', '', 'g'), '([{tx.CJK}])[ \\t　]+([{tx.CJK}])', '\\1\\2', 'g')) AS digest FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.collapse_cjk_space(tx.strip_inline_html(F.col("html"))).cast("binary")).alias("digest"))


@query("headings_html", "SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS heading FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), "<[^>]*>", "").alias("heading"))


@query("page_blocks", "SELECT page_id, CAST(i - 1 AS BIGINT) AS block, b AS body FROM (SELECT page_id, unnest(x) AS b, generate_subscripts(x, 1) AS i FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<(?:p|li)>(.*?)</(?:p|li)>', 1), lambda b: regexp_replace(b, '<[^>]*>', '', 'g')) AS x FROM pages))")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(F.transform(F.regexp_extract_all("html", F.lit("(?s)<(?:p|li)>(.*?)</(?:p|li)>"), F.lit(1)), lambda b: F.regexp_replace(b, "<[^>]*>", ""))).alias("block", "body"))


# Headings with their labels.
HEADINGS = ("はじめに", "結論", "方法", "参考文献", "謝辞", "キーワード", "3. 研究の仮説と目的", "注", "4. 分析結果", "先行研究", "付録")


@query("heading_classify", "SELECT * FROM (VALUES ('はじめに', 'introduction', NULL), ('結論', 'conclusion', NULL), ('方法', 'methods', NULL), ('参考文献', 'references', NULL), ('謝辞', 'acknowledgments', NULL), ('キーワード', 'keywords', NULL), ('3. 研究の仮説と目的', 'introduction', '3.'), ('注', 'notes', NULL), ('4. 分析結果', 'results', '4.'), ('先行研究', 'literature_review', NULL), ('付録', 'appendix', NULL)) t(heading, label, prefix)")
def _(spark, d):
    h = spark.createDataFrame([(x,) for x in HEADINGS], "heading string")
    return h.select("heading", structure.primary_label(structure.with_parents(structure.heading_labels(F.col("heading")))).alias("label"), structure.number_prefix(F.col("heading")).alias("prefix"))


# Levels of the elements of a page that are nodes of its tree.
_LEVELS = {"html": 1, "body": 2, "nav": 3, "article": 3, "footer": 3, "ul": 4, "h1": 4, "p": 5, "li": 6}
_OPENED = "<(" + "|".join(_LEVELS) + ")[ >]"
_NODES_SQL = f"""WITH o AS (SELECT page_id AS doc, regexp_extract_all(html, '{_OPENED}', 1) AS x FROM pages),
 n AS (SELECT doc, CAST(idx AS BIGINT) AS idx, CAST(list_extract(map_extract(MAP {{{", ".join(f"'{k}': {v}" for k, v in _LEVELS.items())}}}, x[idx]), 1) AS BIGINT) AS level, CAST((idx - 1) * 10 AS BIGINT) AS start, CAST(len(x) * 10 AS BIGINT) AS doc_len FROM (SELECT doc, x, unnest(range(1, len(x) + 1)) AS idx FROM o))"""


def _nodes(spark, d):
    opened = F.regexp_extract_all("html", F.lit(_OPENED), F.lit(1))
    levels = F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv])
    n = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.size(opened).alias("n"), F.posexplode(opened).alias("i", "name"))
    n = n.select("doc", (F.col("i") + 1).cast("long").alias("idx"), levels[F.col("name")].cast("long").alias("level"), (F.col("i") * 10).cast("long").alias("start"), (F.col("n") * 10).cast("long").alias("doc_len"))
    return structure.tree(n)


@query("section_tree", _NODES_SQL + " SELECT CAST(doc AS BIGINT) AS doc, CAST(idx AS BIGINT) AS idx, CAST((SELECT max(b.idx) FROM n b WHERE b.doc = a.doc AND b.idx < a.idx AND b.level < a.level) AS BIGINT) AS parent FROM n a")
def _(spark, d):
    return _nodes(spark, d).select("doc", "idx", "parent")


@query("section_end", _NODES_SQL + " SELECT CAST(doc AS BIGINT) AS doc, CAST(idx AS BIGINT) AS idx, CAST(coalesce((SELECT min(b.start) FROM n b WHERE b.doc = a.doc AND b.idx > a.idx AND b.level <= a.level), doc_len) AS BIGINT) AS stop FROM n a")
def _(spark, d):
    return _nodes(spark, d).select("doc", "idx", "stop")


@query("smooth_levels", _NODES_SQL + " SELECT CAST(doc AS BIGINT) AS doc, CAST(idx AS BIGINT) AS idx, CAST(idx + (SELECT min(b.level - b.idx) FROM n b WHERE b.doc = a.doc AND b.idx <= a.idx) AS BIGINT) AS smooth FROM n a")
def _(spark, d):
    return _nodes(spark, d).select("doc", "idx", "smooth")


@query("block_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def _(spark, d):
    return structure.offsets(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start")


@query("title_runs", "SELECT conv_id, CAST(run AS BIGINT) AS run, role, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AND lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL THEN 0 ELSE 1 END AS new FROM conversations)) GROUP BY ALL")
def _(spark, d):
    return structure.runs(table(spark, d, "conversations"), "conv_id", "turn", "role")


_COLS = "sentence_id, type, expr, func, subfunc, position, end_position, span_text"


@query("extract_matches", MATCH + f" SELECT basename, section, genre1, {_COLS}, round(rel_position, 6) AS rel_position FROM m")
def _(spark, d):
    return found(spark, d).select("basename", "section", "genre1", *_COLS.split(", "), r6(F.col("rel_position")).alias("rel_position"))


@query("extract_connectives", MATCH + f" SELECT {_COLS} FROM (SELECT *, substr(sentence_text, position + 1, len) AS span_text FROM best) WHERE type = '{CONNECTIVE}'")
def _(spark, d):
    return extract.extract_matches(sents(spark, d), kinds=(CONNECTIVE,)).select(*_COLS.split(", "))


@query("extract_sentence_final", MATCH + f" SELECT {_COLS} FROM (SELECT *, substr(sentence_text, position + 1, len) AS span_text FROM best) WHERE type = '{FINAL}'")
def _(spark, d):
    return extract.extract_matches(sents(spark, d), kinds=(FINAL,)).select(*_COLS.split(", "))


@query("overlap_invalidate", MATCH + f" SELECT sentence_id, a.expr AS conn, b.expr AS final FROM best a JOIN best b USING (sentence_id) WHERE a.type = '{CONNECTIVE}' AND b.type = '{FINAL}' AND a.position < b.end_position AND b.position < a.end_position")
def _(spark, d):
    raw = extract.extract_matches(sents(spark, d), cross_check=False)
    at = F.col("position"), F.col("end_position")
    both = stats.side_by_side(raw, [F.col("expr").alias("conn"), at[0].alias("p"), at[1].alias("e")], [F.col("expr").alias("final"), *at])
    return both.where("p < end_position and position < e").select("sentence_id", "conn", "final")


@query("filter_matches", MATCH + f" SELECT {_COLS} FROM m WHERE regexp_matches(span_text, '^[TtDd]') AND type IN ('{CONNECTIVE}') AND genre1 IN ('src0', 'src1')")
def _(spark, d):
    return search.filter_by(found(spark, d), "^[TtDd]", [CONNECTIVE], ["src0", "src1"]).select(*_COLS.split(", "))


@query("exclude_sections", "SELECT doc_id AS basename, lang AS section FROM documents WHERE lang NOT IN ('en', 'fr')")
def _(spark, d):
    return search.exclude_sections(secs(spark, d), ("en", "fr")).select("basename", "section")


_COUNT = "SELECT type, genre1, func, subfunc, expr, count(*) AS freq FROM m GROUP BY ALL"


@query("count_matches", MATCH + _COUNT.replace("SELECT", " SELECT", 1))
def _(spark, d):
    return stats.count_by(found(spark, d))


@query("export_count", MATCH + " SELECT type, genre1, func, subfunc, expr, freq FROM (" + _COUNT + ") WHERE freq >= 2")
def _(spark, d):
    return stats.count_by(found(spark, d)).where("freq >= 2")


@query("section_counts", "SELECT lang AS section, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    return secs(spark, d).groupBy("section").agg(F.count("*").alias("n"))


@query("genre_counts", "SELECT source AS genre1, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return secs(spark, d).where("genre1 is not null").groupBy("genre1").agg(F.count("*").alias("n"))


_FILES = "SELECT source AS basename, CASE WHEN lang = 'en' THEN 'unknown' ELSE lang END AS section, text FROM documents"
_SUMMARY = f"SELECT basename, count(*) AS n_sections, count(*) FILTER (section = 'unknown') AS n_unknown, count(*) FILTER (section = 'unknown') / count(*) AS unknown_ratio, (arg_min(text, {{'a': section, 'b': text}})) AS example_text FROM ({_FILES}) GROUP BY basename"


def _files(spark, d):
    docs = table(spark, d, "documents")
    return stats.summarize_by_file(docs.select(F.col("source").alias("basename"), F.when(F.col("lang") == "en", "unknown").otherwise(F.col("lang")).alias("section"), "text"))


@query("summarize_by_file", f"SELECT basename, n_sections, n_unknown, round(unknown_ratio, 6) AS unknown_ratio, md5(example_text) AS example FROM ({_SUMMARY})")
def _(spark, d):
    return _files(spark, d).select("basename", "n_sections", "n_unknown", r6(F.col("unknown_ratio")).alias("unknown_ratio"), F.md5(F.col("example_text").cast("binary")).alias("example"))


@query("find_problematic", f"SELECT basename, n_sections, round(unknown_ratio, 6) AS unknown_ratio, substr(example_text, 1, 320) AS snippet FROM ({_SUMMARY}) WHERE n_sections <= 2 OR unknown_ratio >= 0.6 ORDER BY unknown_ratio DESC, n_sections, basename LIMIT 200")
def _(spark, d):
    return stats.find_problematic(_files(spark, d)).select("basename", "n_sections", r6(F.col("unknown_ratio")).alias("unknown_ratio"), "snippet")


_LEVELS_SQL = f""", f AS (SELECT type, func, count(*) AS n FROM m GROUP BY ALL), w AS (SELECT *, regexp_extract(func, '^[0-9]+', 0) AS code, list_filter(regexp_split_to_array(regexp_replace(func, '^[0-9]+', ''), '[・、]'), lambda x: x <> '') AS t FROM f)
 SELECT type, func, n, CASE WHEN type = '{CONNECTIVE}' THEN code || t[1] ELSE t[1] END AS func_1, CASE WHEN type <> '{CONNECTIVE}' THEN array_to_string(t, '') WHEN len(t) > 1 THEN code || t[1] || '・' || t[2] END AS func_2,
 CASE WHEN type = '{CONNECTIVE}' AND len(t) > 2 THEN code || t[1] || '・' || t[2] || '・' || t[3] END AS func_3 FROM w"""


@query("function_levels", MATCH + _LEVELS_SQL)
def _(spark, d):
    return extract.expand_functions(found(spark, d)).groupBy("type", "func", "func_1", "func_2", "func_3").agg(F.count("*").alias("n"))


@query("min_position", MATCH + " SELECT * FROM p")
def _(spark, d):
    return stats.min_positions(found(spark, d))


@query("pairs_distinct", MATCH + " SELECT * FROM pr")
def _(spark, d):
    return stats.pairs(found(spark, d))


@query("pairs_multiset", MATCH + f" SELECT c.sentence_id, c.expr AS conn, f.expr AS final FROM m c JOIN m f USING (sentence_id) WHERE c.type = '{CONNECTIVE}' AND f.type = '{FINAL}'")
def _(spark, d):
    return stats.pairs(found(spark, d), False).select("sentence_id", "conn", "final")


def _pmi_sql(by: str) -> str:
    k = f"{by}, " if by else ""
    on = f"AND a.{by} IS NOT DISTINCT FROM b.{by}" if by else ""
    return (
        MATCH
        + f""", pk AS (SELECT {k}sentence_id, type, expr, min(position) AS position FROM m GROUP BY ALL),
j AS (SELECT {'a.' + by + ', ' if by else ''}a.expr AS conn, b.expr AS final, count(*) AS joint, count(*) FILTER (a.position < b.position) AS ahead FROM pk a JOIN pk b ON a.sentence_id = b.sentence_id {on} WHERE a.type = '{CONNECTIVE}' AND b.type = '{FINAL}' GROUP BY ALL),
t AS (SELECT {k}count(DISTINCT sentence_id) AS sentences FROM pk GROUP BY ALL),
n AS (SELECT {k}type, expr, count(*) AS n FROM pk GROUP BY ALL),
x AS (SELECT j.*, t.sentences, c.n AS n_conn, f.n AS n_final, joint / sum(joint) OVER (PARTITION BY {'j.' + by + ', ' if by else ''}conn) AS pc, joint / sum(joint) OVER (PARTITION BY {'j.' + by + ', ' if by else ''}final) AS pf FROM j JOIN t ON {f't.{by} IS NOT DISTINCT FROM j.{by}' if by else 'true'} JOIN n c ON c.type = '{CONNECTIVE}' AND c.expr = conn {f'AND c.{by} IS NOT DISTINCT FROM j.{by}' if by else ''} JOIN n f ON f.type = '{FINAL}' AND f.expr = final {f'AND f.{by} IS NOT DISTINCT FROM j.{by}' if by else ''})
SELECT {k}conn, final, joint, n_conn, n_final, sentences, round(log2((joint / sentences) / ((n_conn / sentences) * (n_final / sentences))), 6) + 0.0 AS pmi, round(ahead / n_conn, 6) + 0.0 AS transition,
 round(sum(-pc * log2(pc)) OVER (PARTITION BY {k}conn), 6) + 0.0 AS conn_entropy, round(sum(-pf * log2(pf)) OVER (PARTITION BY {k}final), 6) + 0.0 AS final_entropy FROM x"""
    )


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query("pmi_entropy", _pmi_sql(""))
def _(spark, d):
    return _rounded(stats.pmi_entropy(found_once(spark, d)), "pmi", "transition", "conn_entropy", "final_entropy")


@query("pmi_entropy_by_section", _pmi_sql("section"))
def _(spark, d):
    return _rounded(stats.pmi_entropy(found_once(spark, d), ["section"]), "pmi", "transition", "conn_entropy", "final_entropy")


@query("contingency_long", MATCH + " SELECT section AS cat, expr, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d):
    return stats.contingency(found(spark, d), "section")


@query("contingency_wide", "SELECT l_returnflag AS cat, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY ALL")
def _(spark, d):
    return stats.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", wide=True)


@query("contingency_multi", "SELECT l_returnflag || ' / ' || l_linestatus AS cat, CAST(l_linenumber AS VARCHAR) AS expr, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    return stats.contingency(table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("string")), ["l_returnflag", "l_linestatus"], "l_linenumber")


def _chi_sql(counts: str) -> str:
    return f"""WITH t AS ({counts}), r AS (SELECT cat, sum(n) AS row FROM t GROUP BY ALL), c AS (SELECT expr, sum(n) AS col FROM t GROUP BY ALL), n AS (SELECT sum(n) AS total FROM t),
z AS (SELECT r.cat, c.expr, coalesce(t.n, 0) AS n, CAST(row AS DOUBLE) * col / total AS e, total FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN t ON t.cat = r.cat AND t.expr = c.expr)"""


_ORD = "SELECT o_orderstatus AS cat, o_orderpriority AS expr, count(*) AS n FROM orders GROUP BY ALL"


@query("chi2_residuals", _chi_sql(_ORD) + " SELECT cat, expr, CAST(n AS BIGINT) AS n, round(e, 6) AS expected, round((n - e) / sqrt(e + 1e-12), 6) + 0.0 AS residual FROM z")
def _(spark, d):
    r = stats.chi2_residuals(stats.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))
    return _rounded(r.select("cat", "expr", "n", "expected", "residual"), "expected", "residual")


@query("chi2_summary", _chi_sql(_ORD) + " SELECT round(sum((n - e) * (n - e) / (e + 1e-12)), 6) AS chi2, CAST((count(DISTINCT cat) - 1) * (count(DISTINCT expr) - 1) AS BIGINT) AS dof, CAST(max(total) AS BIGINT) AS n, round(sqrt(sum((n - e) * (n - e) / (e + 1e-12)) / max(total) / (least(count(DISTINCT cat), count(DISTINCT expr)) - 1)), 6) AS cramers_v FROM z")
def _(spark, d):
    return _rounded(stats.chi2_summary(stats.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")), "chi2", "cramers_v")


@query("residual_top_k", MATCH + ", " + _chi_sql("SELECT section AS cat, expr, count(*) AS n FROM m GROUP BY ALL").removeprefix("WITH ") + " SELECT expr, round(sum(abs((n - e) / sqrt(e + 1e-12))), 6) AS score FROM z GROUP BY expr ORDER BY round(sum(abs((n - e) / sqrt(e + 1e-12))), 6) DESC, expr LIMIT 5")
def _(spark, d):
    r = stats.chi2_residuals(stats.contingency(found(spark, d), "section"))
    return r.groupBy("expr").agg(r6(F.sum(F.abs("residual"))).alias("score")).orderBy(F.desc("score"), "expr").limit(5)


_LLR = """, k AS (SELECT expr, count(*) FILTER (section = 'en') AS a, count(*) FILTER (section IS DISTINCT FROM 'en') AS b FROM m GROUP BY ALL),
k2 AS (SELECT *, CAST((SELECT sum(a) FROM k) AS DOUBLE) AS n1, CAST((SELECT sum(b) FROM k) AS DOUBLE) AS n2 FROM k),
k3 AS (SELECT expr, a, b, 2 * ((CASE WHEN a > 0 THEN a * ln(a / ((a + b) * n1 / (n1 + n2) + 1e-12)) ELSE 0 END) + (CASE WHEN b > 0 THEN b * ln(b / ((a + b) * n2 / (n1 + n2) + 1e-12)) ELSE 0 END)) AS llr, a / greatest(n1, 1) - b / greatest(n2, 1) AS target_rel FROM k2 WHERE a + b >= 5)"""


@query("llr_keyness", MATCH + _LLR + " SELECT expr, a, b, round(llr, 6) + 0.0 AS llr, round(target_rel, 6) + 0.0 AS target_rel FROM k3")
def _(spark, d):
    return _rounded(stats.llr_keyness(found(spark, d), "en").select("expr", "a", "b", "llr", "target_rel"), "llr", "target_rel")


def _keyness(method: str) -> Query:
    return lambda spark, d: _rounded(stats.llr_keyness(found(spark, d), "en", correction=method).select("expr", "llr", "p", "p_adj"), "llr", "p", "p_adj")


query("llr_keyness_fdr")(_keyness("fdr_bh"))
query("keyness_bonferroni")(_keyness("bonferroni"))


@query("bh_adjust", "WITH p AS (SELECT o_orderpriority AS k, round(avg(o_totalprice) / 1000000, 9) AS p FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p) SELECT k, p, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adj FROM r")
def _(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.avg("o_totalprice") / 1000000, 9).alias("p"))
    return _rounded(stats.adjust(p, F.col("p")), "p_adj")


@query("keyness_top5_wide")
def _(spark, d):
    return stats.top_characteristic(found_once(spark, d), ["de", "en", "es", "fr"])


@query("dominant_category", MATCH + " SELECT expr, section AS category, n FROM (SELECT expr, section, count(*) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY expr ORDER BY n DESC, section DESC) = 1")
def _(spark, d):
    return stats.dominant_category(found(spark, d))


_FORM = f"SELECT f.expr AS final, c.expr AS conn, f.span_text AS surface, count(*) AS n FROM m c JOIN m f USING (sentence_id) WHERE c.type = '{CONNECTIVE}' AND f.type = '{FINAL}' GROUP BY ALL"
_FORM_C = _FORM.replace("f.span_text", "c.span_text")


@query("surface_forms_sf", MATCH + " " + _FORM)
def _(spark, d):
    return search.surface_forms(found(spark, d), FINAL)


@query("surface_forms_conn", MATCH + " " + _FORM_C)
def _(spark, d):
    return search.surface_forms(found(spark, d), CONNECTIVE)


def _listed_sql(form: str) -> str:
    return f"(SELECT final, conn, CAST(sum(n) AS BIGINT) AS freq, string_agg(surface || ': ' || n, '; ' ORDER BY n DESC, surface) FILTER (rn <= 10) || CASE WHEN max(rn) > 10 THEN '; 他(' || count(*) FILTER (rn > 10) || '): ' || CAST(sum(n) FILTER (rn > 10) AS BIGINT) ELSE '' END AS forms FROM (SELECT *, row_number() OVER (PARTITION BY final, conn ORDER BY n DESC, surface) AS rn FROM ({form})) GROUP BY final, conn)"


@query("collocation_report", MATCH + f" SELECT final, conn, a.freq, a.forms AS final_forms, b.forms AS conn_forms FROM {_listed_sql(_FORM)} a JOIN {_listed_sql(_FORM_C)} b USING (final, conn)")
def _(spark, d):
    return search.collocation_report(found_once(spark, d))


@query("pair_samples", MATCH + " SELECT final, conn, sentence_id, sentence_text FROM (SELECT DISTINCT final, conn, sentence_id FROM pr) JOIN s USING (sentence_id) QUALIFY row_number() OVER (PARTITION BY final, conn ORDER BY md5(sentence_id || '|42'), sentence_id) <= 5")
def _(spark, d):
    return search.pair_samples(stats.pairs(found(spark, d)), sents(spark, d)).select("final", "conn", "sentence_id", "sentence_text")


@query("sample_by_section", "SELECT doc_id AS basename, lang AS section FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= 20")
def _(spark, d):
    return search.sample_by_section(secs(spark, d), 20).select("basename", "section")


@query("sample_balanced", "WITH g AS (SELECT DISTINCT lang, source FROM documents), h AS (SELECT *, count(*) OVER (PARTITION BY lang) AS g, row_number() OVER (PARTITION BY lang ORDER BY md5(source || '|42')) AS place FROM g) SELECT doc_id AS basename, lang AS section, source AS genre1 FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '|42'), doc_id) AS rn FROM documents) JOIN h USING (lang, source) WHERE rn <= 50 // g + CASE WHEN place <= 50 % g THEN 1 ELSE 0 END")
def _(spark, d):
    return search.sample_by_section(secs(spark, d), 50, balance="genre1").select("basename", "section", "genre1")


_EV = "WITH e AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), w AS (SELECT src, dst, count(*) AS weight FROM e WHERE dst IS NOT NULL GROUP BY ALL), d AS (SELECT node, CAST(sum(weight) AS BIGINT) AS deg FROM (SELECT src AS node, weight FROM w UNION ALL SELECT dst, weight FROM w) GROUP BY ALL), t AS (SELECT CAST(sum(weight) AS DOUBLE) AS total FROM w), ed AS (SELECT src, dst, weight, log2((weight / total) / ((a.deg / total) * (b.deg / total))) AS pmi FROM w JOIN d a ON a.node = src JOIN d b ON b.node = dst CROSS JOIN t), no AS (SELECT x.node, x.n + coalesce(d.deg, 0) AS frequency, coalesce(y.entropy, 0) AS entropy FROM (SELECT event_type AS node, count(*) AS n FROM events GROUP BY ALL) x LEFT JOIN d USING (node) LEFT JOIN (SELECT src AS node, sum(-weight / deg * log2(weight / deg)) AS entropy FROM w JOIN d ON d.node = src GROUP BY ALL) y USING (node))"


def _net(spark, d):
    ev = table(spark, d, "events")
    e = network.edge_events(ev, ["user_id"], ["ts", "event_id"], "event_type")
    return network.edges(e), network.nodes(ev, e, "event_type")


@query("network_edges", _EV + " SELECT src, dst, weight, round(pmi, 6) + 0.0 AS pmi FROM ed")
def _(spark, d):
    return _rounded(_net(spark, d)[0], "pmi")


@query("network_nodes", _EV + " SELECT node, frequency, round(entropy, 6) + 0.0 AS entropy FROM no")
def _(spark, d):
    return _rounded(_net(spark, d)[1], "entropy")


@query("network_filtered", _EV + " SELECT src, dst, weight, round(pmi, 6) + 0.0 AS pmi FROM ed WHERE pmi >= -2.01 AND src IN (SELECT node FROM no WHERE frequency >= 100) AND dst IN (SELECT node FROM no WHERE frequency >= 100)")
def _(spark, d):
    return _rounded(network.filtered(*_net(spark, d), min_pmi=-2.01, min_freq=100)[0], "pmi")


_HIT = "SELECT basename, section, sentence_text, min(sentence_id) AS sentence_id FROM s WHERE {} GROUP BY ALL"


@query("search_selector", MATCH + " " + _HIT.format(f"sentence_id IN (SELECT sentence_id FROM m WHERE type = '{CONNECTIVE}' AND expr = 'the') AND sentence_id IN (SELECT sentence_id FROM m WHERE type = '{FINAL}')"))
def _(spark, d):
    return search.search(sents(spark, d), found(spark, d), conn="the", final=search.ANY)


@query("search_none", MATCH + " " + _HIT.format(f"sentence_id NOT IN (SELECT sentence_id FROM m WHERE type = '{CONNECTIVE}') AND sentence_id IN (SELECT sentence_id FROM m WHERE type = '{FINAL}' AND expr = 'ing')"))
def _(spark, d):
    return search.search(sents(spark, d), found(spark, d), conn=search.NONE, final="ing")


@query("search_regex", MATCH + " " + _HIT.format("regexp_matches(lower(sentence_text), 'tion.*ble')"))
def _(spark, d):
    return search.search(sents(spark, d), found(spark, d), query="tion.*BLE")


@query("search_require_both", MATCH + " " + _HIT.format("sentence_id IN (SELECT sentence_id FROM m GROUP BY sentence_id HAVING count(DISTINCT type) >= 2)"))
def _(spark, d):
    return search.search(sents(spark, d), found(spark, d), require_both=True)


@query("search_ppm", MATCH + " SELECT h AS hits, t AS sentences, round(h / t * 1e6, 6) AS ppm FROM (SELECT count(*) AS h FROM (" + _HIT.format("sentence_id IN (SELECT sentence_id FROM m GROUP BY sentence_id HAVING count(DISTINCT type) >= 2)") + ")), (SELECT count(DISTINCT sentence_id) AS t FROM s)")
def _(spark, d):
    s = sents(spark, d)
    return _rounded(search.per_million(search.search(s, found(spark, d), require_both=True), s), "ppm")


@query("highlight_spans")
def _(spark, d):
    m = found(spark, d).groupBy("sentence_id", "sentence_text").agg(F.collect_list(F.struct(F.col("position").alias("start"), F.col("end_position").alias("stop"))).alias("spans"))
    return m.select("sentence_id", extract.highlight(F.col("sentence_text"), F.col("spans")).alias("html"))


@query("quality_report", MATCH + f" SELECT (SELECT count(*) FROM m WHERE genre1 IS NULL) AS null_genre, (SELECT count(*) FROM (SELECT sentence_id FROM m WHERE type = '{CONNECTIVE}' GROUP BY ALL HAVING count(DISTINCT expr) > 1)) AS multi_connective, (SELECT count(*) FROM (SELECT 1 FROM m GROUP BY sentence_id, type, expr, position, end_position HAVING count(*) > 1)) AS anchor_dups")
def _(spark, d):
    return search.quality_report(found_once(spark, d))


@query("marker_catalogue", MATCH + " SELECT DISTINCT type, expr, func FROM m")
def _(spark, d):
    return found(spark, d).select("type", "expr", "func").distinct()


@query("ca_row_coords")
def _(spark, d):
    return stats.correspondence(stats.contingency(found(spark, d), "section"))[0]


@query("metadata_join", "SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    return docs.join(labels.withColumn("labelled", F.lit(True)), "doc_id", "left").select("doc_id", "lang", "quality", "toxic", F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("token_pattern_match", "SELECT lang, CAST(sum(len(regexp_extract_all('<' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n.,!?<>|;]+'), lambda w: w <> ''), '><') || '>', '<(?:the|of|de|la)><[^<>]*(?:tion|ment)>(?:<and>)?'))) AS BIGINT) AS hits FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def _(spark, d):
    rule = lexicon.compile_tokens([{"LEMMA": {"IN": ["the", "of", "de", "la"]}}, lexicon.Either(({"ORTH": {"REGEX": "tion$"}}, {"ORTH": {"REGEX": "ment$"}})), {"ORTH": "and", "OP": "?"}])
    words = F.filter(F.split(F.lower("text"), r"[ \t\n.,!?<>|;]+"), lambda w: w != "")
    tokens = F.transform(words, lambda w: F.struct(w.alias("orth"), w.alias("norm"), w.alias("lemma"), F.lit("").alias("pos"), F.lit("").alias("tag"), F.lit("").alias("morph")))
    rows = table(spark, d, "documents").where("text is not null")
    return rows.groupBy("lang").agg(F.sum(F.size(extract.match_tokens(tokens, rule))).alias("hits"))


@query("genre_meta", "SELECT source AS genre1, CASE WHEN doc_id % 3 > 0 THEN lang END AS genre2, 'n' || (doc_id % 5) AS genre3, source || CASE WHEN doc_id % 3 > 0 THEN ' / ' || lang ELSE '' END || ' / n' || (doc_id % 5) AS genre_path, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    area = F.when(F.col("doc_id") % 3 > 0, F.map_from_arrays(F.array(F.lit("subject_area")), F.array("lang"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    words = F.concat(F.lit("n"), (F.col("doc_id") % 5).cast("string"), F.lit("、more"))
    meta = F.map_concat(F.map_from_arrays(F.array(F.lit("corpus"), F.lit("keywords")), F.array(F.col("source"), words)), area)
    rows = corpus.genre_meta(table(spark, d, "documents").select(meta.alias("meta")))
    return rows.groupBy("genre1", "genre2", "genre3", "genre_path").agg(F.count("*").alias("n"))


# Each conversation as a Markdown document with a heading for each turn.
_TURNS = {"user": "はじめに", "assistant": "考察", "system": "注"}
_TURNS_SQL = "WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'はじめに' WHEN 'assistant' THEN '考察' ELSE '注' END AS heading, CASE role WHEN 'user' THEN 'introduction' WHEN 'assistant' THEN 'discussion' ELSE 'notes' END AS category, text AS body FROM conversations), o AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 2 AS BIGINT) AS idx, CAST(coalesce(sum(length(heading) + length(body) + 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(length(heading) + length(body) + 4) OVER (PARTITION BY conv_id) - 2 AS BIGINT) AS whole FROM t)"


@query("markdown_sections", _TURNS_SQL + " SELECT conv_id, idx, heading, category, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY idx), whole) AS stop, body, category <> 'notes' AS shown FROM o")
def _(spark, d):
    names = F.create_map(*[F.lit(x) for kv in _TURNS.items() for x in kv])
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), names[F.col("role")], F.lit("\n\n"), F.col("text")).alias("body")))).alias("t"))
    docs = turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["body"]), "\n\n").alias("text"))
    return sections.nodes(docs, "conv_id").select("conv_id", F.col("idx").cast("long").alias("idx"), "heading", "category", "start", "stop", "body", "shown")


@query("exclusive_bodies", "SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<nav\\b.*?</nav\\s*>', '', 'g') AS body FROM pages")
def _(spark, d):
    # Whole pages without their script, style and nav elements.
    inner = structure.places(F.col("html"), r"(?is)<(script|style|nav)\b.*?</\1\s*>")
    return table(spark, d, "pages").select("page_id", F.array_join(structure.without_intervals(F.col("html"), inner), "").alias("body"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    e = ingest.windowed_events(table(spark, d, "events"))
    return e.withColumn("total", F.round("total", 4))


@query("occurrence_rank", "SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 5")
def _(spark, d):
    n = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    return n.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query("title_counts", MATCH + f" SELECT count(DISTINCT sentence_id) AS sentences, count(DISTINCT section) AS sections, count(DISTINCT expr) FILTER (type = '{CONNECTIVE}') AS connectives, count(DISTINCT expr) FILTER (type = '{FINAL}') AS finals, (SELECT count(*) FROM (SELECT DISTINCT conn, final FROM pr)) AS collocations FROM m")
def _(spark, d):
    return reports.title_counts(found_once(spark, d))


@query("collocation_column", MATCH + f" SELECT sentence_id, c.section, c.expr || '→' || f.expr AS expr FROM m c JOIN m f USING (sentence_id) WHERE c.type = '{CONNECTIVE}' AND f.type = '{FINAL}'")
def _(spark, d):
    return reports.collocation_column(found_once(spark, d))


_KEY_ALL = """, k AS (SELECT section AS cat, expr, count(*) AS a FROM m WHERE section IS NOT NULL GROUP BY ALL), e AS (SELECT expr, count(*) AS both_n FROM m GROUP BY ALL), c AS (SELECT cat, sum(a) AS n1 FROM k GROUP BY ALL), tot AS (SELECT count(*) AS n FROM m),
 k2 AS (SELECT cat, expr, a, both_n - a AS b, both_n, n1, n - n1 AS n2, n FROM k JOIN e USING (expr) JOIN c USING (cat) CROSS JOIN tot WHERE both_n >= 5),
 k3 AS (SELECT cat, expr, a, b, 2 * (CASE WHEN a > 0 THEN a * ln(a / (both_n * n1 / n + 1e-12)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / (both_n * n2 / n + 1e-12)) ELSE 0 END) AS llr, a / greatest(n1, 1) - b / greatest(n2, 1) AS target_rel FROM k2)"""


@query("keyness_by_category", MATCH + _KEY_ALL + " SELECT cat, expr, a, b, round(llr, 6) + 0.0 AS llr, round(target_rel, 6) + 0.0 AS target_rel FROM k3")
def _(spark, d):
    return _rounded(stats.keyness_by_category(found_once(spark, d)), "llr", "target_rel")


@query("keyness_over", MATCH + _KEY_ALL + " SELECT expr, round(llr, 6) + 0.0 AS llr FROM k3 WHERE cat = 'en' AND target_rel > 0 ORDER BY k3.llr DESC, target_rel DESC, expr LIMIT 5")
def _(spark, d):
    return _rounded(stats.over_under(stats.keyness_by_category(found_once(spark, d)).where("cat = 'en'"), 5), "llr").select("expr", "llr")


@query("keyness_under", MATCH + _KEY_ALL + " SELECT expr, round(llr, 6) + 0.0 AS llr FROM k3 WHERE cat = 'en' AND target_rel < 0 ORDER BY k3.llr DESC, target_rel, expr LIMIT 5")
def _(spark, d):
    return _rounded(stats.over_under(stats.keyness_by_category(found_once(spark, d)).where("cat = 'en'"), 5, over=False), "llr").select("expr", "llr")


@query("global_index", "SELECT event_id, CAST(row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS BIGINT) AS global_index FROM events")
def _(spark, d):
    return reports.indexed(table(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_id", "global_index")


@query("sentence_of_span", "SELECT doc_id, CAST(CASE WHEN p >= 0 THEN length(substr(text, 1, p)) - length(replace(substr(text, 1, p), chr(10), '')) ELSE -1 END AS BIGINT) AS sentence, CASE WHEN p >= 0 THEN string_split(text, chr(10))[length(substr(text, 1, p)) - length(replace(substr(text, 1, p), chr(10), '')) + 1] END AS body FROM (SELECT doc_id, text, CAST(instr(text, 'heit') - 1 AS INT) AS p FROM documents)")
def _(spark, d):
    hit = structure.sentence_of(F.col("text"), F.instr("text", "heit") - 1)
    return table(spark, d, "documents").select("doc_id", hit.alias("s")).select("doc_id", "s.sentence", "s.body")


@query("aggregated_genre", "SELECT text AS expr, section, genre1, genre1 AS selected_genre FROM (SELECT lang AS section, source AS genre1, text FROM documents) WHERE section IN ('en', 'de') AND text IS NOT NULL AND genre1 IS NOT NULL")
def _(spark, d):
    rows = reports.complete(reports.include_sections(secs(spark, d), ["en", "de"]), ["text", "genre1"])
    return reports.selected_genre(reports.aggregated(rows, "text").drop("basename"), "genre9")


@query("hits_and_misses", MATCH + f", h AS (SELECT sentence_id, expr FROM m WHERE type = '{CONNECTIVE}') SELECT sentence_id, expr FROM h UNION ALL SELECT sentence_id, NULL FROM s WHERE sentence_id NOT IN (SELECT sentence_id FROM h)")
def _(spark, d):
    hits = found_once(spark, d).where(F.col("type") == CONNECTIVE).select("sentence_id", "expr")
    return reports.hits_and_misses(sents(spark, d), hits)


@query("long_form", "SELECT cat, expr, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT o_orderstatus AS cat FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority AS expr FROM orders) LEFT JOIN (" + _ORD + ") USING (cat, expr)")
def _(spark, d):
    return reports.long_form(stats.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", wide=True), "cat")


@query("json_rows", "SELECT to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS payload FROM region")
def _(spark, d):
    return reports.to_json(table(spark, d, "region").select("r_regionkey", "r_name"))


@query("drawn_edges", _EV + " SELECT src, dst, weight, round(log10(weight), 6) AS log_weight FROM ed WHERE weight >= 20")
def _(spark, d):
    return _rounded(network.drawn_parts(_net(spark, d)[0], 20)[0], "log_weight")


_SQL["keyness_top5_wide"] = MATCH + _KEY_ALL + """, t AS (SELECT cat, row_number() OVER (PARTITION BY cat ORDER BY llr DESC, expr) AS rank, printf('%s (%.1f)', expr, llr) AS cell FROM k3 WHERE target_rel > 0)
 SELECT rank, """ + ", ".join(f"coalesce(max(cell) FILTER (cat = '{c}'), '') AS {c}" for c in ("de", "en", "es", "fr")) + " FROM t WHERE rank <= 5 GROUP BY rank"
