"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from noticelake.llm import (
    centroids, chat, decontamination, fingerprints, html_text, licenses, near_dups, packing, pivot_index, token_counts, token_files, toxicity, variants,
)
from noticelake.llm.common import cut, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


OP1_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
           count(*) OVER (PARTITION BY conv_id) AS n_turns
    FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), prefixes AS (
    SELECT conv_id, place, n_turns,
           string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '')
               OVER (PARTITION BY conv_id ORDER BY place) AS said
    FROM turns
), whole AS (
    SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE place = n_turns GROUP BY ALL
), kept AS (
    SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place < p.n_turns AND p.place = w.n_turns AND p.said = w.said)
)
SELECT t.conv_id, (t.place - 1) // 256 AS segment, k.n_turns, k.n_copies,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM turns t JOIN kept k USING (conv_id) GROUP BY ALL
"""


@query("op1_chat_formatting", OP1_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


@query("op2_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(fingerprints.edited_pairs(table(spark, sf_dir, "documents")))
    own = rows.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo")).distinct()
    joined = rows.join(own, F.col("next_id").eqNullSafe(F.col("d")) & (F.col("next_print") == F.col("p")))
    asked = rows.where("doc_id % 100 = 0")
    close = fingerprints.within_radius(asked, rows).groupBy("q_hi", "q_lo").agg((F.count("*") - 1).alias("n_close"))
    found = asked.select("doc_id", "print", "hi", "lo").distinct().join(
        close, (F.col("hi") == F.col("q_hi")) & (F.col("lo") == F.col("q_lo"))
    ).select(F.col("doc_id").alias("c_id"), F.col("print").alias("c_print"), "n_close")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.join(found, (F.col("doc_id") == F.col("c_id")) & (F.col("print") == F.col("c_print")), "left").select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.hex_of(F.col("hi"), F.col("lo")).alias("fingerprint"),
        fingerprints.hex_of(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("hi"), F.col("lo"), F.col("e_hi"), F.col("e_lo")).alias("near_edited"),
        fingerprints.likeness(F.col("hi"), F.col("lo"), F.col("n_hi"), F.col("n_lo")).alias("near_next"),
        "n_close",
    )


def _templates_sql(templates: dict[str, tuple[str, ...]]) -> str:
    quoted = lambda s: s.replace("'", "''")
    return ", ".join(f"('{quoted(n)}', {k}, '{quoted(t)}')" for n, ts in templates.items() for k, t in enumerate(ts))


OP3_SQL = rf"""
WITH given(license, variant, said) AS (VALUES {_templates_sql(licenses.TEMPLATES)}),
lines AS (
    SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS said
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
sets AS (
    SELECT *, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs
    FROM (SELECT *, string_split(trim(regexp_replace(lower(said), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' ') AS w FROM
          (SELECT 0 AS kind, doc_id, line, NULL AS license, NULL AS variant, said FROM lines
           UNION ALL SELECT 1, NULL, NULL, license, variant, said FROM given))
),
pairs AS (SELECT kind, doc_id, line, license, variant, len(pairs) AS size, unnest(pairs) AS pair FROM sets),
dices AS (
    SELECT d.doc_id, d.line, t.license, t.variant, 2.0::DOUBLE * count(*) / (d.size + t.size) AS dice
    FROM pairs d JOIN pairs t ON d.kind = 0 AND t.kind = 1 AND d.pair = t.pair
    GROUP BY d.doc_id, d.line, t.license, t.variant, d.size, t.size
),
best AS (SELECT doc_id, line, license, max(dice) AS dice FROM dices WHERE dice >= 0.8 GROUP BY ALL),
texts(license, variant, said) AS (VALUES {_templates_sql(licenses.PASSAGES)}),
words AS (
    SELECT *, string_split(trim(regexp_replace(lower(said), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' ') AS w FROM
        (SELECT row_number() OVER () AS r, doc_id, NULL AS license, NULL AS variant, said FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS said FROM documents)
         UNION ALL SELECT NULL, NULL, license, variant, said FROM texts)
),
places AS (SELECT r, doc_id, license, variant, len(w) AS n, i - 1 AS word, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(w))) AS i FROM words)),
wanted AS (SELECT license, variant, n AS m, pair, count(*) AS held FROM places WHERE r IS NULL GROUP BY ALL),
hits AS MATERIALIZED (SELECT p.r, p.doc_id, p.n, p.word, t.* FROM places p JOIN wanted t ON p.r IS NOT NULL AND p.pair = t.pair),
times AS (
    SELECT s.r, s.doc_id, s.license, s.variant, s.m, s.n, s.word, least(count(*), h.held) AS times
    FROM hits s JOIN hits h ON h.r = s.r AND h.license = s.license AND h.variant = s.variant AND h.word BETWEEN s.word AND s.word + s.m - 2
    GROUP BY s.r, s.doc_id, s.license, s.variant, s.m, s.n, s.word, h.pair, h.held
),
passages AS (
    SELECT doc_id, license, word, 2.0::DOUBLE * sum(times) / (least(m, n - word) - 1 + m - 1) AS dice
    FROM times GROUP BY r, doc_id, license, variant, m, n, word
),
found AS (SELECT doc_id, license, max(dice) AS dice, 0 AS n_lines, arg_max(word, (dice, -word)) AS word FROM passages WHERE dice >= 0.8 GROUP BY ALL)
SELECT doc_id, license, max(dice) AS dice, sum(n_lines)::BIGINT AS n_lines, max(word)::INTEGER AS word FROM (
    SELECT doc_id, license, max(dice) AS dice, count(*) AS n_lines, NULL AS word FROM best GROUP BY ALL UNION ALL SELECT * FROM found
) GROUP BY doc_id, license
"""


@query("op3_license_scans", OP3_SQL)
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_of(table(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query("op5_toxicity")
def score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_token_files")
def write_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.positions(token_files.read_tokens(spark, path))


@query("op7_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


OP9_SQL = r"""
WITH split AS (
    SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM (SELECT 0 AS kind, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 1, item_id::VARCHAR, text FROM benchmark)
), windows AS (
    SELECT DISTINCT id AS item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win
    FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS pos
          FROM (SELECT id, w, least(13, len(w)) AS size FROM split WHERE kind = 1 AND len(w) > 0))
), places AS (
    SELECT id, pos, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win
    FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS pos
          FROM split, (SELECT DISTINCT size FROM windows) WHERE kind = 0 AND len(w) >= size)
), met AS (
    SELECT p.id, p.pos, p.size, i.item_id FROM places p JOIN windows i USING (size, win)
), hits AS (
    SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(pos, pos + size)) AS k FROM met) GROUP BY id
), items AS (
    SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM met GROUP BY id
)
SELECT s.id::BIGINT AS doc_id, len(s.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(s.w) AS contaminated
FROM split s LEFT JOIN hits h ON h.id = s.id LEFT JOIN items i ON i.id = s.id WHERE s.kind = 0
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_token_counts")
def delta_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive, toxic ones are withdrawn, English ones are counted anew by another tokenizer; the second batch is sent twice."""
    versions = ["word_bpe_49k", "byte_bpe_50k"]
    counted = cut(token_counts.counted(table(spark, sf_dir, "documents"), [public_tokenizers.path(f"{v}.json") for v in versions]))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("gone", F.lit(True))
    marked = counted.join(toxic, "doc_id", "left")

    def change(rows: DataFrame, op: str, old: int | None, new: int | None) -> DataFrame:
        side = lambda k, pre: [
            *[(F.col(c) if k is not None else F.lit(None)).cast("string").alias(f"{pre}{c}") for c in ("source", "lang")],
            F.lit(None if k is None else versions[k]).cast("string").alias(f"{pre}version"),
            (F.lit(None) if k is None else F.col("n_tokens")[k]).cast("long").alias(f"{pre or 'n_'}tokens"),
        ]
        return rows.select(F.lit(op).alias("op"), *side(new, ""), *side(old, "old_"))

    ledger = token_counts.Ledger(spark, token_files.fresh_path(spark, "token-counts"))
    withdrawn = change(marked.where("gone"), "delete", 0, None)
    ledger.commit(1, change(counted, "insert", None, 0))
    ledger.commit(2, withdrawn)
    ledger.compact()
    ledger.commit(3, change(marked.where("lang = 'en' AND gone IS NULL"), "revise", 0, 1))
    ledger.commit(2, withdrawn)
    return ledger.totals()


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.noisy_words(table(spark, sf_dir, "documents")))


def _op12_sql(rounds: int = 5) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
    SELECT rid, vec_id, v, b.d AS distance, b.c AS cluster
    FROM (SELECT k.rid, any_value(vec_id) AS vec_id, any_value(k.v) AS v,
                 min({{'d': list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': m.c}}) AS b
          FROM kept k, mean{r} m GROUP BY k.rid)
)""")
        if r < rounds:
            steps.append(f"""
parts{r} AS (SELECT cluster, i, floor(sum(v[i])::HUGEINT / count(*))::BIGINT AS x FROM (SELECT cluster, v, unnest(range(1, 65)) AS i FROM near{r}) GROUP BY ALL),
mean{r + 1} AS MATERIALIZED (
    SELECT m.c, coalesce(p.v, m.v) AS v FROM mean{r} m LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM parts{r} GROUP BY cluster) p ON p.cluster = m.c
)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
mean0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v
    FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT 40)
),{','.join(steps)},
sums AS (SELECT cluster, sum(distance)::BIGINT AS s FROM near{rounds} GROUP BY cluster)
SELECT n.vec_id, n.cluster, n.distance, s.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM sums) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM near{rounds} n JOIN sums s USING (cluster) JOIN mean{rounds} m ON m.c = n.cluster
"""


@query("op12_centroid_clustering", _op12_sql())
def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score, c.rid AS other
    FROM kept q JOIN kept c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM scores) WHERE rank <= 5
"""


@query("op13_exact_top_k", OP13_SQL)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
