"""The queries over these operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe_fragments import round_trip
from .chat_format import format_turns, read_back
from .common import table
from .divergence import divergence
from .exact_dedup import exact_dedup
from .jpeg_media import media_features, to_jpeg
from .neighbours import neighbours
from .ngram_join import jaccard_components
from .packing import pack_documents
from .substring_dedup import substring_dedup
from .token_files import write_and_read
from .toxicity import toxicity
from .turn_repair import repair_damaged
from .url_filter import filter_urls

#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


#: A conversation that op1 formats besides those of the table: (conv_id, turn, role, text).
CLASHING = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op1_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CLASHING, "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_turns(turns.unionByName(more)))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), percent=90, size=3).select("doc_id", "n_shingles", "n_links", "component_id")


END_ID = 2


def op3_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=END_ID)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_media_columns(spark, sf_dir):
    return media_features(to_jpeg(table(spark, sf_dir, "documents")))


def op10_token_id_output(spark, sf_dir):
    return write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)


def op4_bpe_round_trip(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_filters(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


def op12_structure_repair(spark, sf_dir):
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_WS = "'[\\x20\\x09-\\x0D]'"

OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ') + length(text) + len(regexp_extract_all(text, '###[ \t]*\pL+:|</turn>')) + length('.</turn>.')) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP5_SQL = """
WITH hp AS (
  SELECT page_id, split_part(split_part(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '?', 1), '#', 1) AS hp
  FROM pages
), cut AS (
  SELECT page_id, translate(split_part(hp, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(hp, length(split_part(hp, '/', 1)) + 1) AS path
  FROM hp
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, c.host, c.path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut c LEFT JOIN best b ON c.host = b.host AND c.path = b.path
"""

OP6_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s
  FROM w, LATERAL (SELECT unnest(generate_series(1, len(ws) - 34)) AS i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS j FROM rep)
), per AS (
  SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(js, k)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN per ON w.doc_id = per.doc_id
"""

OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), {_WS}, '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3
), l AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang
), g AS (
  SELECT x.lang, x.source, coalesce(any_value(l.v), 0) AS v, any_value(l.total) AS lang_total, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN l ON l.lang = x.lang
  LEFT JOIN c ON c.lang = x.lang AND c.source = x.source
  LEFT JOIN k ON k.lang = c.lang AND k.term = c.term
  GROUP BY x.lang, x.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (g.lang_total + g.v) AS lang_p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - lang_p) * (p - lang_p)) // lang_p FROM p WHERE n > 0 AND p > lang_p
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _add(state: str, cost: str, letter: str) -> str:
    """SQL: a cost of nine digits and an audit, with an edit more; null stays null, and the least of several is the cheapest and then least."""
    return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}'"


OP12_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([CAST(4294967295 AS BIGINT)] || bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named, steps
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS trimmed FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, trimmed = '' AS blank,
         count(*) OVER (PARTITION BY conv_id, role, text ORDER BY i ROWS UNBOUNDED PRECEDING) > 1 AS again, NOT right(trimmed, 1) IN ('.', '!', '?') AS cut
  FROM numbered
), paid AS (
  SELECT *, CASE WHEN cut AND NOT blank AND NOT again THEN 5 ELSE 0 END AS more FROM faulty
), dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM paid
  UNION ALL
  SELECT y.conv_id, r.i, {_add("v0", "2", "D")},
         CASE WHEN blank OR again THEN {_add("v1", "2", "D")} WHEN initial = 's' THEN least({_add("v1", "2", "D")}, {_add("v0", "more", "K")}) ELSE {_add("v1", "2", "D")} END,
         CASE WHEN blank OR again THEN {_add("n2", "2", "D")}
              ELSE least({_add("n2", "2", "D")}, {_add("v0", "more + 1", "R")}, {_add("v1", "more + 1", "R")}, {_add("n3", "more + 1", "R")},
                         CASE WHEN initial = 'u' THEN least({_add("v0", "more", "K")}, {_add("v1", "more", "K")}, {_add("n3", "more", "K")}) END) END,
         CASE WHEN blank OR again THEN {_add("n3", "2", "D")} ELSE least({_add("n3", "2", "D")}, {_add("n2", "more + 1", "R")}, CASE WHEN initial = 'a' THEN {_add("n2", "more", "K")} END) END
  FROM (SELECT *, least(v3, {_add("n2", "5", "I")}) AS n3
        FROM (SELECT *, least(v2, {_add("v0", "5", "I")}, {_add("v1", "5", "I")}, {_add("v3", "5", "I")}) AS n2 FROM dp)) y
  JOIN paid r ON r.conv_id IS NOT DISTINCT FROM y.conv_id AND r.i = y.i + 1
), sound AS (
  SELECT conv_id, least(v0, v3, {_add("n2", "5", "I")}) AS v
  FROM (SELECT *, least(v2, {_add("v0", "5", "I")}, {_add("v1", "5", "I")}, {_add("v3", "5", "I")}) AS n2
        FROM (SELECT conv_id, i, v0, v1, v2, v3, max(i) OVER (PARTITION BY conv_id) AS last FROM dp) WHERE i = last)
), letters AS (
  SELECT conv_id, j, substr(v, CAST(9 + j AS BIGINT), 1) AS x, count(*) FILTER (substr(v, CAST(9 + j AS BIGINT), 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i,
         count(*) FILTER (substr(v, CAST(9 + j AS BIGINT), 1) <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS nth
  FROM (SELECT conv_id, v, unnest(range(1, length(v) - 8)) AS j FROM sound)
), turns AS (
  SELECT l.conv_id, j, x, nth, r.role, r.text, bool_or(x = 'K' AND initial = 's') OVER (PARTITION BY l.conv_id) AS opened
  FROM letters l LEFT JOIN paid r ON x <> 'I' AND r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i
), said AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role ELSE CASE WHEN (nth - CASE WHEN opened THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END
                                    || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
  FROM turns WHERE x <> 'D' GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND again) AS duplicate,
         count_if(NOT blank AND NOT again AND cut) AS truncated, count_if(before IS NOT NULL AND NOT before || initial IN ('su', 'ua', 'au')) AS illegal
  FROM paid GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(v, 9), '0') AS BIGINT) AS cost,
       coalesce(substr(v, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN sound s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN said a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def queries():
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_url_filters": op5_url_filters,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_media_columns": op9_media_columns,
        "op10_token_id_output": op10_token_id_output,
        "op11_source_divergence": op11_source_divergence,
        "op12_structure_repair": op12_structure_repair,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


def oracle_sql():
    return {
        "op1_chat_formatting": OP1_SQL,
        "op5_url_filters": OP5_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op11_source_divergence": OP11_SQL,
        "op12_structure_repair": OP12_SQL,
    }
