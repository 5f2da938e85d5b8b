"""Registered queries: each applies one operator, with its production parameters, to its whole table."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import bagsearch, decontam, dedup, html_extract, jaccard, langid, licenses, linededup, mixing, prefixtrie, sharding, toxicity, warc
from .registry import ORACLES, QUERIES, query, table  # noqa: F401

#: Words of the document and benchmark tables as the SQL of the queries sees them.
ALNUM = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query()
def op1_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


PHRASES_SQL = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
NOTICES_SQL = ", ".join(f"({k}, '{label}', '{notice}')" for k, (label, notice) in enumerate(licenses.TEMPLATES))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM documents),
phrase(phrase, n, label) AS (VALUES {PHRASES_SQL}),
start AS (SELECT r, unnest(range(0, len(words))) AS k, words FROM d),
place AS (SELECT r, k, label FROM start JOIN phrase ON array_to_string(words[k + 1:k + n], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list_distinct(list(label)) AS labels FROM place GROUP BY r),
notice AS (SELECT template, label, list_distinct(regexp_extract_all(lower(notice), '{ALNUM}')) AS words FROM (VALUES {NOTICES_SQL}) v(template, label, notice)),
block AS (SELECT DISTINCT r, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}')) AS words
          FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
found AS (SELECT r, label, len(list_intersect(b.words, t.words)) / len(t.words) AS containment FROM block b, notice t
          WHERE len(list_intersect(b.words, t.words)) >= ceil(len(t.words) * 0.8 - 1e-9)),
more AS (SELECT r, list_distinct(list(label)) AS labels, max(containment) AS best FROM found GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)""")
def op2_license_scans(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op3_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query()
def op4_sampled_splitters(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (SELECT page_id, html, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM coded)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM r""")
def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / weight AS reach, sum(source_size) OVER () AS everything FROM s),
l AS (SELECT *, (everything - coalesce(sum(3 * source_size) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, (SELECT level FROM l WHERE reach > level ORDER BY reach LIMIT 1) AS free FROM l),
t AS (SELECT source, source_size, CAST(CASE WHEN reach <= level OR free IS NULL THEN 3 * source_size ELSE least(free * weight, 3 * source_size) END AS DOUBLE) AS target FROM f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       CAST(size * (passes + CASE WHEN size > 0 AND before + size / 2 <= target - passes * source_size AND passes < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""")
def op6_curriculum_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


@query()
def op7_toxicity(spark, sf_dir):
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query(rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n_shingles, hash(list_sort(shingles)) AS cls, shingles FROM s),
rep AS (SELECT cls, min(doc_id) AS rep, any_value(shingles) AS shingles, any_value(n_shingles) AS n FROM n WHERE n_shingles > 0 GROUP BY cls),
items AS (SELECT rep, n, hash(unnest(shingles)) AS h FROM rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
           FROM items a JOIN items b ON a.h = b.h AND a.rep < b.rep GROUP BY a.rep, b.rep),
edge AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)),
both_ways AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON reach.other = both_ways.a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
size AS (SELECT cls, count(*) AS size FROM n WHERE n_shingles > 0 GROUP BY cls),
linked AS (SELECT a AS node, sum(size) AS linked FROM both_ways JOIN rep ON rep.rep = b JOIN size USING (cls) GROUP BY a)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, coalesce(comp.component_id, rep.rep, n.doc_id) AS component_id,
       CAST(coalesce(size.size - 1, 0) + coalesce(linked.linked, 0) AS BIGINT) AS n_links
FROM n LEFT JOIN rep ON n.cls = rep.cls AND n.n_shingles > 0 LEFT JOIN comp ON comp.node = rep.rep
LEFT JOIN size ON n.cls = size.cls AND n.n_shingles > 0 LEFT JOIN linked ON linked.node = rep.rep""")
def op8_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("""
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text)""")
def op9_exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query(rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(13, len(words)) AS size, unnest([array_to_string(words[i:i + 12], ' ')
             FOR i IN range(1, greatest(1, len(words) - 12) + 1)]) AS phrase FROM b WHERE len(words) > 0),
size AS (SELECT DISTINCT size FROM phrase),
place AS (SELECT r, size, unnest(range(1, len(words) - size + 2)) AS pos, words FROM d, size WHERE len(words) >= size),
found AS (SELECT p.r, p.pos, p.size, phrase.item_id FROM (SELECT r, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase FROM place) p
          JOIN phrase ON phrase.size = p.size AND phrase.phrase = p.phrase),
hit AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS w FROM found) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)""")
def op10_decontamination(spark, sf_dir):
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
rep AS (SELECT key, max(doc_id) AS keep FROM (SELECT DISTINCT r, doc_id, key FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
stay AS (SELECT k.r, k.i, k.line FROM k LEFT JOIN rep USING (key) WHERE rep.key IS NULL OR k.doc_id IS NOT DISTINCT FROM rep.keep),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM stay GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""")
def op11_line_dedup(spark, sf_dir):
    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM documents),
size AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{ALNUM}')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
part AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // whole.terms)))) AS score
         FROM tf JOIN weight USING (term) JOIN size USING (r), whole),
total AS (SELECT item_id, r, CAST(sum(score) AS BIGINT) AS score FROM part JOIN item USING (term) GROUP BY item_id, r HAVING sum(score) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM total JOIN size USING (r))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op12_ranked_search(spark, sf_dir):
    return bagsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS pos,
        sha256(length(role) || ':' || role || text) AS sha, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name, 0 AS step, 4294967295::BIGINT AS c FROM (SELECT DISTINCT conv_id FROM t)
        UNION ALL SELECT conv_id, name, step + 1, CASE WHEN step % 9 = 0 THEN xor(c, ascii(substr(name, step // 9 + 1, 1))::BIGINT)
                                                  WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc WHERE step < 9 * length(name)),
h AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 4 AS h FROM crc WHERE step = 9 * length(name)),
b AS (SELECT h.conv_id, 0 AS part, pos, sha, words FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND pos < h
      UNION ALL SELECT h.conv_id, 1, pos, sha, words FROM h JOIN o USING (conv_id) WHERE pos >= h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(sha, '') OVER w AS key, words, count(*) OVER (PARTITION BY conv_id) AS long
      FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, depth, key, words, depth = long AS final FROM p
      UNION ALL SELECT conv_id, 0, '', 0, NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = h.conv_id) FROM h),
n AS (SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE final), '') AS ends FROM m GROUP BY key),
k AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
e AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
u AS (SELECT left(key, 64 * d) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM e) GROUP BY ALL)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(e.n_convs AS BIGINT) AS n_convs, CAST(e.n_children AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN u USING (key) LEFT JOIN n up ON e.depth > 0 AND up.key = left(e.key, 64 * (e.depth - 1))""")
def op13_prefix_trie(spark, sf_dir):
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))
