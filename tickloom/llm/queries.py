"""The dealt operators over their whole tables, as contracts ask for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import decontaminate, hard_negatives, language, licenses, lines, mixing, ngram_join, quality, sharding, substring, topk, warc, whitening
from tickloom.llm.base import query, table
from tickloom.llm.words import with_row_id


# Classes are texts with equal sets; only classes are compared, and components grow along their links.
_NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM w
), c AS (SELECT s, min(r) AS c FROM s WHERE len(s) > 0 GROUP BY s),
t AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM c),
links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
label AS (SELECT a AS c, min(b) AS label FROM reach GROUP BY a),
named AS (SELECT s.doc_id, s.r, len(s.s) AS n, label.label FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN label ON label.c = c.c)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY label) END AS component_id FROM named
"""


@query("op3_ngram_jaccard_join", _NGRAM_SQL)
def _ngram_jaccard_join(spark, sf_dir):
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op6_language_id")
def _language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id", 5, 0))
    model = language.fit_languages(docs.where("NOT held_out"))
    return language.identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


@query("op2_template_decontamination")
def _template_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_rid")


@query("op7_mixing_to_targets")
def _mixing_to_targets(spark, sf_dir):
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), mixing.dimensions(), budget=mixing.BUDGET)
    return out.select(
        "doc_id", F.col("_dim_source").alias("source"), F.col("_dim_lang").alias("lang"), F.col("_dim_topic").alias("topic"),
        F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_sampled").alias("sampled"), F.col("_copies").alias("copies"),
    )


@query("op1_sharding")
def _sharding(spark, sf_dir):
    out = sharding.shard_records(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_quality_rules")
def _quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels"), language.held_out("doc_id", 4, 2))


_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS sum FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY sum) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sum AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM l
"""


@query("op5_warc", _WARC_SQL)
def _warc(spark, sf_dir):
    folder = warc.archive_folder(spark)
    files = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(files, folder, payloads=False).drop("payload", "url")


_SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest([sha1(array_to_string(w[i:i + 34], ' ')) FOR i IN range(1, len(w) - 33)]) AS x FROM w WHERE len(w) >= 35),
again AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM win SEMI JOIN again USING (x)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS t FROM w),
kept AS (SELECT word.r, string_agg(t, ' ' ORDER BY k) AS kept, count(*) AS n FROM word ANTI JOIN gone ON gone.r = word.r AND gone.k = word.k GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.r = w.r
"""


@query("op10_substring_dedup", _SUBSTRING_SQL)
def _substring_dedup(spark, sf_dir):
    out = substring.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op8_exact_top_k", _TOPK_SQL)
def _exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS no, unnest(string_split(text, chr(10))) AS line FROM documents
), w AS (SELECT doc_id, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
s AS (
  SELECT doc_id, no, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM w WHERE len(w) > 0
), d AS (SELECT s, min((doc_id, no)) AS f, row_number() OVER () AS id FROM s GROUP BY s),
t AS (SELECT id, f, len(s) AS n, unnest(s) AS x FROM d),
p AS (
  SELECT a.id FROM t a JOIN t b ON a.x = b.x AND b.f < a.f GROUP BY a.id, b.id, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)
), m AS (SELECT DISTINCT id FROM p),
r AS (
  SELECT s.doc_id, s.no FROM s JOIN d ON s.s = d.s LEFT JOIN m ON m.id = d.id WHERE (s.doc_id, s.no) <> d.f OR m.id IS NOT NULL
)
SELECT documents.doc_id, CAST(count(no) AS BIGINT) AS n_removed, coalesce(array_to_string(list_sort(list(no) FILTER (no IS NOT NULL)), ','), '') AS removed_lines
FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id GROUP BY documents.doc_id
"""


@query("op9_line_dedup", _LINES_SQL)
def _line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    gone = lines.removed_lines(docs).groupBy("_rid").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("no")).alias("removed"))
    out = with_row_id(docs).select("_rid", "doc_id").join(gone, "_rid", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS vec_id, CAST(list_sum([a.v[i] * c.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.r <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op11_hard_negatives", _NEGATIVES_SQL)
def _hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op12_whitening")
def _whitening(spark, sf_dir):
    # A deviation beyond a long, as tables of many millions of rows can have, is null here and whole in the operator.
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def _license_sql() -> str:
    """Every rule on every text that holds a gate word; containment by comparing a text's detections in pairs."""
    rules = ", ".join(f"({k}, '{r.label}', {r.priority}, {licenses.SURE[r.priority]}, ['{"', '".join(r.gates)}'], '{licenses.over_words(r.pattern)}')" for k, r in enumerate(licenses.RULES))
    return rf"""
WITH rules(rule, label, priority, sure, gates, pattern) AS (VALUES {rules}),
d AS (SELECT doc_id, row_number() OVER () AS r, trim(regexp_replace(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS t FROM documents),
w AS (SELECT doc_id, r, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS t, CASE WHEN t = '' THEN [] ELSE string_split(t, '  ') END AS words FROM d),
m AS (
  SELECT r, rule, label, priority, sure, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS gaps FROM w JOIN rules ON list_has_any(words, gates)
  WHERE regexp_matches(t, pattern)
), p AS (
  SELECT * EXCLUDE (found, gaps), generate_subscripts(found, 1) AS i, unnest([(length(x) - length(replace(x, ' ', ''))) // 2 FOR x IN found]) AS len,
         unnest([(length(x) - length(replace(x, ' ', ''))) // 2 FOR x IN gaps[:len(found)]]) AS gap FROM m
), s AS (SELECT * EXCLUDE (gap, i), sum(gap + len) OVER (PARTITION BY r, rule ORDER BY i) - len AS start FROM p),
kept AS (
  SELECT * FROM s AS a WHERE priority = {licenses.BASE} OR NOT EXISTS (
    SELECT 1 FROM s AS b WHERE b.r = a.r AND b.start <= a.start AND b.start + b.len >= a.start + a.len AND b.priority <= a.priority
      AND (b.priority < a.priority OR b.len > a.len OR (b.len = a.len AND b.rule < a.rule)))
), k AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score FROM kept GROUP BY r),
b AS (SELECT r, count(*) AS n, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM s WHERE priority = {licenses.BASE} GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(k.labels, '') AS labels, CAST(coalesce(k.score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""


@query("op13_license_scan", _license_sql())
def _license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))
