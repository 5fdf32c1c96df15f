"""Queries ``opN_<name>`` of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import (
    bin_packing,
    embed_dedup,
    html_main,
    license_scan,
    mixing,
    near_dedup,
    neighbour_graph,
    preference,
    quality,
    records,
    toxicity,
    vector_codes,
    whitening,
)
from textlake.llm.common import prepare, table


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prepare(spark)
    net = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn_from=~held_out())
    return toxicity.score_documents(docs, net).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85,
                                      bands=32, rows=7)


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["license_id"])))
    return found.select("doc_id", F.col("license_id").alias("whole_text_license"),
                        F.size("notices").cast("long").alias("n_notices"),
                        F.array_join(ids, ",").alias("notice_licenses"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bin_packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        records.default_tokenizer("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                         "sequence_id", "offset")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.stale_answer_pairs(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    out = preference.format_preferences(turns)
    spans = lambda c: F.array_join(F.transform(
        c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return out.select("pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", "chosen",
                      spans("chosen_mask").alias("chosen_mask"), "rejected",
                      spans("rejected_mask").alias("rejected_mask"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("label")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_graph.search_all(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_near_dedup, op3_records, op4_embedding_dedup, op5_html_extraction, op6_license_scan,
    op7_best_fit_packing, op8_chat_format, op9_quality_rules, op10_mixing, op11_embedding_whitening,
    op12_vector_codes, op13_nearest_neighbours, pipeline)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_COMPONENTS = """
  reach AS (SELECT a AS id, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
  comp AS (SELECT id, min(root) AS g FROM reach GROUP BY id)
"""

OP2_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
  flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
  links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM flat p JOIN flat q ON p.x = q.x AND p.doc_id <> q.doc_id
            GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
{_COMPONENTS}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(g, doc_id) AS component_id,
       coalesce(g, doc_id) = doc_id AS kept
FROM sh LEFT JOIN comp ON comp.id = sh.doc_id
"""

OP4_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
            WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
  deg AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a),
{_COMPONENTS}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(g, vec_id) AS component_id, coalesce(g, vec_id) = vec_id AS kept
FROM v LEFT JOIN deg ON deg.id = vec_id LEFT JOIN comp ON comp.id = vec_id
"""


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canon(text: str) -> str:
    """DuckDB form of ``license_scan.normalise``: the same patterns, except that lines end with a line feed here (other line
    ends are turned into it first) and that the character after a title line is put back, as there is no lookahead."""
    notice = license_scan.COPYRIGHT.replace("'", "''")
    title = license_scan.TITLE.replace(r"(?:\r\n|\n|\r)(?=\s*\S)", r"\n(\s*\S)")
    out = rf"regexp_replace(lower({text}), '\r\n|\r', chr(10), 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '{notice}', ' ', 'g'), '{title}', ' \1')"
    out = rf"' ' || trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for a, b in license_scan.SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


OP6_SQL = f"""
WITH known AS (SELECT c, min(id) AS id FROM (SELECT id, {_canon('t')} AS c FROM (VALUES
  {", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in license_scan.KNOWN)}) AS k(id, t)) GROUP BY c),
  lines AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')) AS u FROM documents),
  hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids
           FROM (SELECT doc_id, {_canon('u')} AS c FROM lines) JOIN known USING (c) GROUP BY doc_id)
SELECT d.doc_id, k.id AS whole_text_license, coalesce(h.n, 0) AS n_notices, coalesce(h.ids, '') AS notice_licenses
FROM (SELECT doc_id, {_canon("coalesce(text, '')")} AS c FROM documents) d
LEFT JOIN known k ON k.c = d.c LEFT JOIN hits h ON h.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH conv AS (SELECT conv_id, coalesce(CAST(turn AS BIGINT), 9223372036854775807) AS turn, coalesce(role, 'user') AS role,
                coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r
           FROM conv WHERE role = 'assistant'),
  e AS (SELECT l.conv_id, l.turn AS last, coalesce(b.text, '') AS stale FROM (SELECT * FROM a WHERE r = 1) l
        LEFT JOIN (SELECT * FROM a WHERE r = 2) b USING (conv_id)),
  t AS (SELECT c.*, e.last, e.stale FROM conv c JOIN e USING (conv_id) WHERE c.turn <= e.last),
  x AS (SELECT conv_id, max(last) AS last,
          coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn)
                   FILTER (WHERE turn < last), '') AS prompt,
          count(*) FILTER (WHERE turn < last) AS n_prefix,
          max(text) FILTER (WHERE turn = last) AS good, max(stale) AS stale FROM t GROUP BY conv_id),
  m AS (SELECT *, good = stale AS same, '<|assistant|>' || chr(10) AS h, '<|end|>' || chr(10) AS z FROM x)
SELECT conv_id AS pair_id, CASE WHEN same THEN n_prefix + 1 ELSE n_prefix END AS n_prefix,
  CASE WHEN same THEN prompt || h || good || z ELSE prompt END AS prompt,
  CASE WHEN same THEN '' ELSE h || good || z END AS chosen,
  CASE WHEN same THEN '' ELSE '14:' || length(good) END AS chosen_mask,
  CASE WHEN same THEN '' ELSE h || stale || z END AS rejected,
  CASE WHEN same THEN '' ELSE '14:' || length(stale) END AS rejected_mask
FROM m
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
  win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
  cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
  f AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
          CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
          CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
          CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
        FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
  g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars
          OR 100 * n_dup_lines > 30 * n_words AS failed FROM f),
  hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM g GROUP BY source),
  mom AS (SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS sq, count(*) / sum(n) AS q FROM hosts),
  prior AS (SELECT m, CASE WHEN m * (1 - m) = 0 THEN 1.0 ELSE least(greatest(m * (1 - m)
              / greatest(greatest(sq - m * m - m * (1 - m) * q, 0.0), 1e-9) - 1, 1.0), 1000.0) END AS s FROM mom),
  verdict AS (SELECT source, (k + m * s) / (n + s) <= 0.5 AS ok FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM g JOIN verdict ON verdict.source IS NOT DISTINCT FROM g.source
"""

def _assigned(source: str, books: str) -> str:
    """Each part's distance to its nearest entry and that entry's number, as ``64 d + k`` (ties: the lower number)."""
    d = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(4))
    return f"""SELECT a.vec_id, a.p, min(({d}) * 64 + b.k) AS m, {", ".join(f"any_value(a.x{i}) AS x{i}" for i in range(4))}
           FROM {source} a JOIN {books} b ON a.p = b.p GROUP BY a.vec_id, a.p"""


def _moved(assigned: str, books: str) -> str:
    means = ", ".join(f"coalesce(CAST(floor(sum(a.x{i}) / count(a.p)) AS BIGINT), any_value(b.x{i})) AS x{i}" for i in range(4))
    return f"""SELECT b.p, b.k, {means} FROM {books} b
           LEFT JOIN {assigned} a ON a.p = b.p AND a.m % 64 = b.k GROUP BY b.p, b.k"""


# for vectors of 64 components, as the given tables hold: parts of four
OP12_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(256 * c) AS BIGINT)) AS e
           FROM embeddings WHERE len(embedding) = 64
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  parts AS (SELECT vec_id, p, {", ".join(f"e[4 * p + {i + 1}] AS x{i}" for i in range(4))}
            FROM (SELECT vec_id, e, unnest(range(16)) AS p FROM v)),
  b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x0, x1, x2, x3 FROM parts
         QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64),
  a0 AS ({_assigned("parts", "b0")}),
  b1 AS ({_moved("a0", "b0")}),
  a1 AS ({_assigned("parts", "b1")}),
  b2 AS ({_moved("a1", "b1")}),
  a2 AS ({_assigned("parts", "b2")}),
  coded AS (SELECT vec_id, string_agg(format('{{:02x}}', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error
            FROM a2 GROUP BY vec_id),
  book AS (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), book
"""

ORACLE = {"op12_vector_codes": OP12_SQL, "op2_near_dedup": OP2_SQL, "op4_embedding_dedup": OP4_SQL, "op6_license_scan": OP6_SQL,
          "op8_chat_format": OP8_SQL, "op9_quality_rules": OP9_SQL}
