"""Queries over document texts: cleaning, word windows, pages, clauses, sentence packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cases_ingest import WS, squeeze, strip
from checks.registry import case
from checks.views import Views, with_views
from noticelake.functions import text as tx
from noticelake.operators import chunking

M = "chr(57344)"

# ---- cleaning and word windows ----------------------------------------------------------------------


@case("clean_document_text", f"SELECT doc_id, {squeeze('text')} AS text FROM documents")
def clean_document_text(v: Views):
    return v.table("documents").select("doc_id", chunking.clean_document_text("text").alias("text"))


@case("document_id", f"""
    SELECT doc_id, 'user_' || (doc_id % (SELECT count(*) FROM supplier)) || '_doc_' || left(md5({squeeze('text')}), 12) AS document_id FROM documents""")
def document_id(v: Views):
    ns = v.size("supplier")
    docs = v.table("documents").withColumns({"u": F.col("doc_id") % ns, "clean": chunking.clean_document_text("text")})
    return docs.select("doc_id", tx.document_id("u", "clean").alias("document_id"))


FILE_SQL = """CASE WHEN source LIKE '%contract%' THEN 'contract' ELSE NULL END"""
NAMES_SQL = """(SELECT p_partkey, upper(left(p_type, 3)) || '-' || (2000 + p_size) || '-' || lpad((p_size * 7)::VARCHAR, 3, '0') || '_' ||
    CASE p_type WHEN 'PROMO' THEN 'Employment contract' WHEN 'SMALL' THEN 'NDA' WHEN 'LARGE' THEN 'lease terms' WHEN 'MEDIUM' THEN 'Policy' ELSE p_name END || '.pdf' AS filename FROM part)"""


@case("filename_metadata", f"""
    SELECT p_partkey, filename, nullif(regexp_extract(filename, '([A-Z]{{2,4}}-[0-9]{{4}}-[0-9]{{3}})', 1), '') AS case_id,
           CASE WHEN p_brand = 'Brand#1' THEN 'given' WHEN lower(filename) LIKE '%contract%' THEN 'contract' WHEN lower(filename) LIKE '%agreement%' THEN 'agreement'
                WHEN lower(filename) LIKE '%policy%' THEN 'policy' WHEN lower(filename) LIKE '%employment%' THEN 'employment_contract'
                WHEN lower(filename) LIKE '%nda%' THEN 'non_disclosure_agreement' WHEN lower(filename) LIKE '%lease%' THEN 'commercial_lease'
                WHEN lower(filename) LIKE '%terms%' THEN 'terms_and_conditions' END AS document_type
    FROM {NAMES_SQL} JOIN part USING (p_partkey)""")
def filename_metadata(v: Views):
    kind = F.when(F.col("p_type") == "PROMO", "Employment contract").when(F.col("p_type") == "SMALL", "NDA").when(
        F.col("p_type") == "LARGE", "lease terms").when(F.col("p_type") == "MEDIUM", "Policy").otherwise(F.col("p_name"))
    name = F.concat(
        F.upper(F.substring("p_type", 1, 3)), F.lit("-"), (F.col("p_size") + 2000).cast("string"), F.lit("-"),
        F.lpad((F.col("p_size") * 7).cast("string"), 3, "0"), F.lit("_"), kind, F.lit(".pdf"),
    )
    given = F.when(F.col("p_brand") == "Brand#1", F.create_map(F.lit("document_type"), F.lit("given")))
    m = v.table("part").select("p_partkey", name.alias("filename"), given.alias("given")).withColumn(
        "m", tx.filename_metadata("filename", "given")
    )
    return m.select("p_partkey", "filename", F.try_element_at("m", F.lit("case_id")).alias("case_id"),
                    F.try_element_at("m", F.lit("document_type")).alias("document_type"))


WINDOWS_SQL = f"""words AS (SELECT doc_id, list_filter(string_split({squeeze('text')}, ' '), lambda w: w <> '') AS w FROM documents),
  win AS (SELECT doc_id, s.i, array_to_string(w[(s.i * 800 + 1):(s.i * 800 + 1000)], ' ') AS chunk_text
          FROM words, LATERAL (SELECT unnest(range(0, ((len(w) + 799) // 800)::BIGINT)) AS i) s WHERE len(w) > 0),
  kept AS (SELECT doc_id, i, chunk_text FROM win WHERE length(chunk_text) > 100)"""


@case("word_window_chunks", f"""WITH {WINDOWS_SQL}
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index,
           (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks, chunk_text FROM kept""")
def word_window_chunks(v: Views):
    return chunking.word_window_chunks(v.table("documents"), ["doc_id"])


@case("chunk_quality", f"""WITH {WINDOWS_SQL}
    SELECT doc_id, len(w)::INT AS total_words, coalesce(n, 0)::INT AS chunks_stored
    FROM words LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1) USING (doc_id)""")
def chunk_quality(v: Views):
    return chunking.chunk_quality(v.table("documents"), "doc_id")


# ---- pages -------------------------------------------------------------------------------------------

# Pieces between page marks, with running lengths, give the position of each mark.
PAGES_SQL = f"""cut AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\[Page [0-9]+\\]', {M}, 'g'), {M}) AS parts,
         regexp_extract_all(text, '\\[Page ([0-9]+)\\]', 1) AS nums FROM legal_docs),
  each_mark AS (SELECT doc_id, i, length(parts[i]) AS len, nums[i] AS num FROM cut, LATERAL (SELECT unnest(range(1, len(nums) + 1)) AS i)),
  marks AS (SELECT doc_id, (sum(len) OVER w + coalesce(sum(length(num) + 7) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS pos,
         num::INT AS page FROM each_mark WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  by_mark AS (SELECT doc_id AS m_doc, pos AS m_pos, page AS m_page FROM marks)"""

OPENINGS = {
    "numbered_clause": rf"{WS}*[0-9]+\.(?:[0-9]+\.)*{WS}+[A-Z]",
    "section_header": rf"{WS}*(?i:SECTION|ARTICLE|CLAUSE){WS}+[0-9]",
    "schedule": rf"{WS}*(?i:SCHEDULE|APPENDIX|ANNEX){WS}+[A-Za-z0-9]",
}


def marked(patterns) -> str:
    text = "text"
    for p in patterns:
        text = rf"regexp_replace({text}, '(?m)^({p})', {M} || '\1', 'g')"
    return text


def pieces_sql(name: str, patterns) -> str:
    return f"""{name}_cut AS (SELECT doc_id, string_split({marked(patterns)}, {M}) AS parts FROM legal_docs),
  {name}_each AS (SELECT doc_id, i, parts[i] AS piece FROM {name}_cut, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
  {name} AS (SELECT * FROM (SELECT doc_id, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM {name}_each) WHERE i > 1)"""


def page_sql(doc: str, pos: str) -> str:
    return f"coalesce((SELECT max_by(m_page, m_pos) FROM by_mark WHERE m_doc = {doc} AND m_pos <= {pos}), 1)"


def legal(body: str, recursive: bool = False) -> str:
    return with_views("legal_docs", f"WITH {PAGES_SQL},\n  {pieces_sql('pieces', OPENINGS.values())}{body}", recursive)


@case("page_map", legal(" SELECT doc_id, pos, page FROM marks"))
def page_map(v: Views):
    return chunking.page_marks(v.legal_docs, "doc_id")


@case("page_of_position", legal(f" SELECT doc_id, p AS position, {page_sql('doc_id', 'p')} AS page FROM (SELECT doc_id, (length(text) // 2)::INT AS p FROM legal_docs)"))
def page_of_position(v: Views):
    half = F.floor(F.length("text") / 2).cast("int")
    return v.legal_docs.select("doc_id", half.alias("position"), chunking.page_at(chunking.page_map("text"), half).alias("page"))


KIND_SQL = "CASE " + " ".join(rf"WHEN regexp_matches(piece, '\A{p}') THEN '{k}'" for k, p in OPENINGS.items()) + " END"


@case("clause_boundaries", legal(f"""
    SELECT doc_id, (i - 2)::INT AS boundary_no, start AS position, {KIND_SQL} AS kind, {page_sql('doc_id', 'start')} AS page FROM pieces"""))
def clause_boundaries(v: Views):
    return chunking.clause_boundaries(v.legal_docs, "doc_id")


@case("page_asof", legal("""
    SELECT p.doc_id, p.start AS position, coalesce(m.page, 1) AS page FROM pieces p ASOF LEFT JOIN marks m ON p.doc_id = m.doc_id AND p.start >= m.pos"""))
def page_asof(v: Views):
    spots = chunking.clause_boundaries(v.legal_docs, "doc_id").select("doc_id", "position")
    return chunking.page_asof(spots, chunking.page_marks(v.legal_docs, "doc_id"), "doc_id")


@case("marker_stats", with_views("legal_docs", r"""
    SELECT doc_id, length(text)::INT AS text_length, text LIKE '%[Page%' AS has_markers, len(n)::INT AS marker_count,
           coalesce(list_max(n), 0)::INT AS max_page, len(list_distinct(n))::INT AS distinct_pages
    FROM (SELECT *, list_transform(regexp_extract_all(text, '\[Page ([0-9]+)\]', 1), lambda x: x::INT) AS n FROM legal_docs)"""))
def marker_stats(v: Views):
    return chunking.marker_stats(v.legal_docs, "doc_id")


@case("clause_index", with_views("legal_docs", f"""WITH {PAGES_SQL}, {pieces_sql('pieces', [rf'{WS}*[0-9]+[.]{WS}+[A-Z][a-z]'])}
    SELECT doc_id, start AS position, regexp_extract(piece, '\\A{WS}*([0-9]+)\\.{WS}+([A-Z][a-z]+)', 1) AS number,
           regexp_extract(piece, '\\A{WS}*([0-9]+)\\.{WS}+([A-Z][a-z]+)', 2) AS title_word, {page_sql('doc_id', 'start')} AS page FROM pieces"""))
def clause_index(v: Views):
    return chunking.clause_index(v.legal_docs, "doc_id")


# ---- sentence packing ----------------------------------------------------------------------------------

# Units are (doc_id, unit, base): a clause piece, or a whole document, with the position it starts at.
# ``sents`` numbers the sentences of a unit; ``pack`` walks them one by one.


def pack_sql(units: str, overlap: bool, prefix: str = "") -> str:
    p = prefix
    carry = f"(s.n > 1)" if overlap else "false"
    return f"""{p}units AS ({units}),
  {p}raw AS (SELECT doc_id, unit, base, string_split(regexp_replace(body, '([.!?]){WS}+', '\\1' || {M}, 'g'), {M}) AS parts FROM {p}units),
  {p}sents AS (SELECT doc_id, unit, base, row_number() OVER (PARTITION BY doc_id, unit ORDER BY i) AS k, sent,
         length(sent) AS len, coalesce(sum(length(sent) + 1) OVER (PARTITION BY doc_id, unit ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS rel
    FROM (SELECT doc_id, unit, base, i, {strip('parts[i]')} AS sent FROM {p}raw, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)) WHERE sent <> ''),
  {p}pack AS (
    SELECT doc_id, unit, k, sent AS cur, sent AS last, len AS size, 1 AS n, 0 AS part, NULL::VARCHAR AS done FROM {p}sents WHERE k = 1
    UNION ALL
    SELECT x.doc_id, x.unit, x.k,
           CASE WHEN s.size + x.len > 800 THEN CASE WHEN {carry} THEN s.last || ' ' || x.sent ELSE x.sent END ELSE s.cur || ' ' || x.sent END,
           x.sent,
           CASE WHEN s.size + x.len > 800 THEN CASE WHEN {carry} THEN length(s.last) + x.len ELSE x.len END ELSE s.size + x.len END,
           CASE WHEN s.size + x.len > 800 THEN CASE WHEN {carry} THEN 2 ELSE 1 END ELSE s.n + 1 END,
           CASE WHEN s.size + x.len > 800 THEN s.part + 1 ELSE s.part END,
           CASE WHEN s.size + x.len > 800 THEN s.cur END
    FROM {p}pack s JOIN {p}sents x ON x.doc_id = s.doc_id AND x.unit = s.unit AND x.k = s.k + 1),
  {p}out AS (
    SELECT t.doc_id, t.unit, t.part - 1 AS part_no, t.done AS chunk_text, x.base + x.rel AS pos
    FROM {p}pack t JOIN {p}sents x USING (doc_id, unit, k) WHERE t.done IS NOT NULL
    UNION ALL
    SELECT doc_id, unit, part, cur, base + rel + len + 1 FROM (
      SELECT t.doc_id, t.unit, t.part, t.cur, x.base, x.rel, x.len, row_number() OVER (PARTITION BY t.doc_id, t.unit ORDER BY t.k DESC) AS z
      FROM {p}pack t JOIN {p}sents x USING (doc_id, unit, k)) WHERE z = 1)"""


BIG = f"SELECT doc_id, i AS unit, start AS base, {strip('piece')} AS body FROM pieces WHERE length({strip('piece')}) > 800"
WHOLE = "SELECT doc_id, 0 AS unit, 0 AS base, text AS body FROM legal_docs"
NUMBER = rf"coalesce(nullif(regexp_extract(chunk_text, '\A{WS}*([0-9]+(?:\.[0-9]+)*)', 1), ''), 'unknown')"

CLAUSES = f"""{pack_sql(BIG, False)},
  chunked AS (
    SELECT doc_id, unit, part_no, chunk_text, {page_sql('doc_id', 'pos')} AS page, NULL::VARCHAR AS clause_number FROM out
    UNION ALL
    SELECT doc_id, unit, 0, chunk_text, {page_sql('doc_id', 'start')}, {NUMBER} FROM (
      SELECT doc_id, i AS unit, start, {strip('piece')} AS chunk_text FROM pieces) WHERE length(chunk_text) BETWEEN 50 AND 800)"""


@case("clause_number", legal(f" SELECT doc_id, start AS position, {NUMBER} AS clause_number FROM (SELECT *, piece AS chunk_text FROM pieces)"))
def clause_number(v: Views):
    p = v.legal_docs.select("doc_id", F.explode(chunking.clause_pieces("text")).alias("p"))
    return p.select("doc_id", F.col("p.start").alias("position"), chunking.clause_number("p.text").alias("clause_number"))


@case("clause_chunks", legal(f""",
  {CLAUSES}
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY unit, part_no) - 1)::INT AS chunk_index, chunk_text, page, clause_number FROM chunked""", True))
def clause_chunks(v: Views):
    return chunking.clause_chunks(v.legal_docs, "doc_id")


@case("split_large_clause", legal(f""",
  {pack_sql(BIG, False)}
    SELECT o.doc_id, u.base AS position, part_no::INT AS part_no, chunk_text, {page_sql('o.doc_id', 'pos')} AS page FROM out o JOIN units u USING (doc_id, unit)""", True))
def split_large_clause(v: Views):
    return chunking.split_large_clauses(v.legal_docs, "doc_id")


@case("sentence_chunks", legal(f""",
  {pack_sql(WHOLE, True)}
    SELECT doc_id, part_no::INT AS chunk_index, chunk_text, {page_sql('doc_id', 'pos')} AS page FROM out""", True))
def sentence_chunks(v: Views):
    return chunking.sentence_chunks(v.legal_docs, "doc_id")


GATE = """gate AS (SELECT doc_id, count(chunk_text)::INT AS clause_count, coalesce(avg(length(chunk_text)), 0) AS average_size
    FROM legal_docs LEFT JOIN chunked USING (doc_id) GROUP BY 1)"""


@case("structure_gate", legal(f""",
  {CLAUSES}, {GATE}
    SELECT doc_id, clause_count, round(average_size, 6) AS average_size, clause_count < 2 OR average_size < 100 AS use_fallback FROM gate""", True))
def structure_gate(v: Views):
    g = chunking.structure_gate(v.legal_docs, "doc_id")
    return g.withColumn("average_size", F.round("average_size", 6))


@case("chunk_enrich", legal(f""",
  {CLAUSES}, {GATE},
  {pack_sql(WHOLE, True, 'f_')},
  routed AS (
    SELECT c.doc_id, 'clause' AS chunk_type, unit, part_no, chunk_text, page, clause_number FROM chunked c JOIN gate g USING (doc_id) WHERE NOT (clause_count < 2 OR average_size < 100)
    UNION ALL
    SELECT o.doc_id, 'fallback', 0, part_no, chunk_text, {page_sql('o.doc_id', 'pos')}, NULL FROM f_out o JOIN gate g USING (doc_id) WHERE clause_count < 2 OR average_size < 100)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY unit, part_no) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks,
           chunk_type, length(chunk_text)::INT AS chunk_size, page, clause_number, chunk_text FROM routed""", True))
def chunk_enrich(v: Views):
    return chunking.legal_chunks(v.legal_docs, "doc_id")


@case("page_variety", legal(f""",
  {pack_sql(WHOLE, True)}
    SELECT doc_id, count(*) AS chunks, count(DISTINCT page) AS pages, bool_and(page = 1) AS all_page_one
    FROM (SELECT doc_id, {page_sql('doc_id', 'pos')} AS page FROM out) GROUP BY 1""", True))
def page_variety(v: Views):
    return chunking.page_variety(chunking.sentence_chunks(v.legal_docs, "doc_id"), "doc_id")
