"""Chunkers over documents with line structure, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, semantic
from .registry import query
from .views import LINES, TYPE_LIST, TYPES, planted_regions, structured_lines, table

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in chunking.LINE_KINDS.items()) + " ELSE 'text' END"
TYPED = f"{LINES}, t AS (SELECT *, {_KIND} AS kind, greatest(1, length(line) // 4) AS tokens FROM lines)"
_SECTIONS = """s AS (SELECT *, sum((kind = 'header')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM t),
    sp AS (SELECT *, ((sum(tokens) OVER (PARTITION BY doc_id, section ORDER BY i) - tokens) // 60)::BIGINT AS part,
           CASE WHEN kind = 'header' THEN regexp_replace(line, '^#+ ', '') END AS head FROM s),
    sections AS (SELECT doc_id, section::BIGINT AS section, part, max(max(head)) OVER (PARTITION BY doc_id, section) AS heading,
           string_agg(line, chr(10) ORDER BY i) AS chunk, sum(tokens)::BIGINT AS tokens, count(*) FILTER (kind = 'step') >= 3 AS has_procedure
           FROM sp GROUP BY doc_id, section, part)"""
_TABLES = """b AS (SELECT *, sum((kind = 'table' AND coalesce(before, '') <> 'table')::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS block
           FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM t)),
    bp AS (SELECT *, row_number() OVER w AS place, first_value(line) OVER w AS header FROM b WHERE kind = 'table' WINDOW w AS (PARTITION BY doc_id, block ORDER BY i)),
    tables AS (SELECT doc_id, block, ((place - 2) // 5)::BIGINT AS part, min(header) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_rows
           FROM bp WHERE place > 1 GROUP BY ALL)"""
_STEPS = """n AS (SELECT *, sum((kind = 'step')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM t),
    steps AS (SELECT doc_id, ((step - 1) // 5)::BIGINT AS part, min(step) FILTER (kind = 'step') || '-' || max(step) FILTER (kind = 'step') AS label,
           string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) FILTER (kind = 'warning') > 0 AS warned FROM n WHERE step > 0 GROUP BY doc_id, (step - 1) // 5)"""
_PAIRS = """q AS (SELECT *, lead(kind) OVER w AS next_kind, lead(line) OVER w AS next_line FROM t WHERE kind IN ('problem', 'solution') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    pairs AS (SELECT doc_id, i, trim(regexp_replace(line, '^[A-Za-z]+:', '')) AS problem, trim(regexp_replace(next_line, '^[A-Za-z]+:', '')) AS solution
           FROM q WHERE kind = 'problem' AND next_kind = 'solution')"""
_SEGMENTS = """g AS (SELECT doc_id, i, line, tokens, CASE WHEN kind IN ('table', 'step') THEN kind ELSE 'text' END AS kind FROM t),
    h AS (SELECT *, sum((coalesce(before, '') <> kind)::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS segment
           FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g)),
    segments AS (SELECT doc_id, segment, min(kind) AS kind, string_agg(line, chr(10) ORDER BY i) AS chunk, sum(tokens)::BIGINT AS tokens FROM h GROUP BY doc_id, segment)"""


def lines(spark, sf_dir):
    return chunking.typed(structured_lines(spark, sf_dir))


@query(f"WITH {TYPED}, {_SECTIONS} SELECT * FROM sections")
def h01_sections(spark, sf_dir):
    return chunking.sections(lines(spark, sf_dir))


@query(f"WITH {TYPED}, {_TABLES} SELECT * FROM tables")
def h03_table_chunks(spark, sf_dir):
    return chunking.table_chunks(lines(spark, sf_dir))


@query(f"WITH {TYPED}, {_STEPS} SELECT * FROM steps")
def h04_step_chunks(spark, sf_dir):
    return chunking.step_chunks(lines(spark, sf_dir))


@query(f"""WITH {TYPED}, e AS (SELECT *, max(i) OVER (PARTITION BY doc_id) AS last_line FROM t)
    SELECT doc_id, i, regexp_extract(line, '^([0-9]+)', 1)::BIGINT AS number, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, last_line) AS last FROM e WHERE kind = 'step'""")
def w08_step_ends(spark, sf_dir):
    return chunking.steps(lines(spark, sf_dir))


@query(f"WITH {TYPED}, {_PAIRS} SELECT * FROM pairs")
def h05_problem_pairs(spark, sf_dir):
    return chunking.problem_pairs(lines(spark, sf_dir))


@query(f"WITH {TYPED}, {_SEGMENTS} SELECT * FROM segments")
def h07_segments(spark, sf_dir):
    return chunking.segments(lines(spark, sf_dir))


def _of_types(strategy: str, sql: str) -> str:
    """The SQL of a chunker, over the lines of the types that use it."""
    types = ", ".join(repr(t) for t, (s, _) in chunking.STRATEGIES.items() if s == strategy)
    own = sql.replace("FROM t", f"FROM t_{strategy}")
    return f"t_{strategy} AS (SELECT * FROM t WHERE {TYPE_LIST}[(doc_id % 8 + 1)::INT] IN ({types})), {own}"


_ADAPTIVE = f"WITH {TYPED}, " + ", ".join(_of_types(*x) for x in (("sections", _SECTIONS), ("tables", _TABLES), ("steps", _STEPS), ("problems", _PAIRS), ("segments", _SEGMENTS))) + """,
    adaptive AS (SELECT doc_id, 'sections' AS strategy, section AS a, part AS b, chunk FROM sections
    UNION ALL SELECT doc_id, 'problems', i::BIGINT, 0, problem || chr(10) || solution FROM pairs
    UNION ALL SELECT doc_id, 'steps', part, 0, chunk FROM steps
    UNION ALL SELECT doc_id, 'tables', block, part, chunk FROM tables
    UNION ALL SELECT doc_id, 'segments', segment, 0, chunk FROM segments)"""


@query(_ADAPTIVE + " SELECT * FROM adaptive")
def h08_chunks_by_type(spark, sf_dir):
    """Each document cut by the strategy of its type."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return chunking.by_strategy(lines(spark, sf_dir).withColumn("document_type", kind))


_TICKET = """tickets AS (SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {_TICKET}, p AS (SELECT conv_id, unnest(range(1, (length(text) + 999) // 1000 + 1)) AS n, text FROM tickets)
    SELECT conv_id, n::BIGINT AS part, substr(text, (n - 1) * 1000 + 1, 1000) AS chunk FROM p""")
def h09_ticket_chunks(spark, sf_dir):
    """A ticket of up to a thousand characters is one chunk; a longer one is cut every thousand."""
    t = tickets(spark, sf_dir)
    n = F.floor((F.length("text") + 999) / 1000)
    placed = t.select("conv_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("part"))
    return placed.select("conv_id", "part", F.substring(F.col("text"), ((F.col("part") - 1) * 1000 + 1).cast("int"), F.lit(1000)).alias("chunk"))


def tickets(spark, sf_dir):
    """Conversations as texts: conv_id, turns, text."""
    said = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("said"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(said)).alias("l"))
    return c.select("conv_id", "turns", F.array_join(F.col("l.said"), "\n").alias("text"))


@query(_ADAPTIVE + f""", english AS (SELECT doc_id FROM documents WHERE lang = 'en'), c AS (SELECT a.*, md5(chunk) AS digest FROM adaptive a SEMI JOIN english USING (doc_id) WHERE length(trim(chunk)) >= 50),
    f AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, a, b) AS n FROM c)
    SELECT doc_id, strategy, a, b, digest, substr(digest, 1, 12) AS chunk_id FROM f WHERE n = 1""")
def h10_adaptive_ingest(spark, sf_dir):
    """Classify, keep English, cut by type, drop short chunks and copies, name by content."""
    english = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    found = h08_chunks_by_type(spark, sf_dir).join(english, "doc_id", "left_semi").filter(F.length(F.trim("chunk")) >= 50).withColumn("digest", F.md5("chunk"))
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "a", "b", "strategy")).alias("f"))
    return first.select("f.doc_id", "f.strategy", "f.a", "f.b", "digest", F.substring("digest", 1, 12).alias("chunk_id"))


@query()
def w11_merged_chunks(spark, sf_dir):
    """Segments merged until they hold forty tokens."""
    return chunking.merged_small(chunking.segments(lines(spark, sf_dir)), ["segment"], 40)


@query(f"WITH {TYPED} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t GROUP BY kind")
def h00_line_kinds(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(f"""WITH {TYPED}, h AS (SELECT doc_id, i, regexp_replace(line, '^#+ ', '') AS name FROM t WHERE kind = 'header'),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS section, first_value(name) OVER (PARTITION BY doc_id ORDER BY i) AS first FROM h)
    SELECT doc_id, section, CASE WHEN first = name THEN name ELSE first || ' > ' || name END AS path FROM n""")
def x17_section_paths(spark, sf_dir):
    """The headings under which each section stands."""
    return chunking.section_paths(lines(spark, sf_dir))


@query(f"""WITH {TYPED} SELECT doc_id, bool_or(kind = 'step') AS "procedure", bool_or(kind = 'table') AS "table", bool_or(kind = 'warning') AS warning, bool_or(kind = 'problem') AS problem,
    bool_or(regexp_matches(line, '[A-Z]{{1,3}}[0-9]{{2,}}')) AS code, bool_or(regexp_matches(lower(line), '[0-9] ?(kg|mm|rpm)')) AS specs FROM t GROUP BY doc_id""")
def x11_content_flags(spark, sf_dir):
    """What kinds of lines, codes and measures each document has."""
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    g = lines(spark, sf_dir).groupBy("doc_id")
    return g.agg(has("step").alias("procedure"), has("table").alias("table"), has("warning").alias("warning"), has("problem").alias("problem"), F.bool_or(F.col("line").rlike("[A-Z]{1,3}[0-9]{2,}")).alias("code"), F.bool_or(F.lower("line").rlike("[0-9] ?(kg|mm|rpm)")).alias("specs"))


@query(f"""WITH {TYPED}, s AS (SELECT *, sum((kind = 'header')::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS section FROM t),
    c AS (SELECT doc_id, section, count(*) AS n, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'step') AS steps, count(*) FILTER (kind = 'solution') AS solutions, count(*) FILTER (kind = 'warning') AS warnings FROM s GROUP BY ALL)
    SELECT doc_id, section, n AS n_lines, CASE WHEN tables >= 1 AND tables >= 0.3 * n THEN 'table' WHEN steps >= 2 THEN 'procedure' WHEN solutions >= 1 THEN 'solution' WHEN warnings >= 1 AND warnings >= 0.2 * n THEN 'warning' ELSE 'text' END AS type FROM c""")
def c04_chunk_types(spark, sf_dir):
    """The type of each section, by a table of kinds of lines, numbers and shares."""
    placed = lines(spark, sf_dir).withColumn("section", F.sum((F.col("kind") == "header").cast("long")).over(chunking.in_order()))
    return chunking.chunk_types(placed, ["doc_id", "section"])


@query()
def h01_semantic_chunks(spark, sf_dir):
    """Documents as they are: sections by their headers, paragraphs, sentences, word windows, merged where small."""
    return semantic.semantic_chunks(table(spark, sf_dir, "documents"), budget=300, least=50)


@query()
def h07_hybrid_chunks(spark, sf_dir):
    """Documents with tables, steps and codes in their prose, each region cut by its own chunker."""
    return semantic.hybrid_chunks(planted_regions(spark, sf_dir), budget=300, least=50)
