"""SQL that DuckDB answers like the queries of this package, where SQL can."""

from ..plans import sqltext

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_P1 = rf"""
r AS (SELECT id, split, text, min(regexp_replace(lower(trim(coalesce(source, split_part(id, '/', 1)), ' ')), '[\s-]+', '_', 'g')) AS source
      FROM corpus_records WHERE text IS NOT NULL AND split IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
w AS (SELECT id, split, source, md5(text) AS fp, {_WORDS} AS w FROM r),
s AS (SELECT id, split, source, fp, list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, greatest(len(w) - 1, 1)::BIGINT)]) AS s FROM w),
e AS (SELECT * FROM s WHERE split <> 'train'), t AS (SELECT * FROM s WHERE split = 'train'),
eg AS (SELECT id, fp, len(s) AS n, unnest(s) AS g FROM e), tg AS (SELECT id, fp, len(s) AS n, unnest(s) AS g FROM t),
both_ AS (SELECT eg.id AS ide, tg.id AS idt, eg.fp AS fe, tg.fp AS ft, eg.n AS ne, tg.n AS nt, count(*) AS c FROM eg JOIN tg USING (g) GROUP BY ALL),
p AS (SELECT ide, idt, fe, ft, c / (ne + nt - c) AS sim FROM both_ WHERE c >= 0.6 * (ne + nt - c) - 1e-9 AND fe <> ft
      UNION ALL SELECT e.id, t.id, fp, fp, 1.0 FROM e JOIN t USING (fp))
"""

P1_PAIRS = f"WITH {_P1} SELECT DISTINCT least(ide, idt) AS id_a, greatest(ide, idt) AS id_b FROM p WHERE ide <> idt"
P1_LINKS = f"""
WITH {_P1} SELECT ide AS id, any_value(e.split) AS split, fe AS class, count(*) FILTER (fe = ft) AS n_copies, count(*) FILTER (fe <> ft) AS n_near
FROM p JOIN e ON e.id = ide AND e.fp = fe GROUP BY ide, fe
"""
P1_REPORT = f"""
WITH {_P1} SELECT e.split, e.source AS source_eval, t.source AS source_train, count(*) AS n_pairs, count(DISTINCT ide) AS n_eval_records,
       count(*) FILTER (sim = 1) AS n_same_words
FROM p JOIN e ON e.id = ide AND e.fp = fe JOIN t ON t.id = idt AND t.fp = ft GROUP BY ALL
"""

P5_FOUND = """
SELECT DISTINCT conv_id, (i - 1)::INT AS msg_idx
FROM (SELECT conv_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM sft_toy)
WHERE strlen(messages[i].content) > 2000
"""

_RECORDS = r"""
r AS (SELECT id, min(regexp_replace(lower(trim(coalesce(source, split_part(id, '/', 1)), ' ')), '[\s-]+', '_', 'g')) AS source,
             min(strlen(text))::BIGINT AS n_bytes
      FROM corpus_records WHERE split = 'train' AND text IS NOT NULL AND strlen(text) > 0 GROUP BY id, md5(text)),
h AS (SELECT source, count(*) AS n_records, sum(n_bytes)::BIGINT AS n_bytes FROM r GROUP BY source),
j AS (SELECT t.source, target_share, max_repeats, coalesce(n_records, 0) AS n_records, coalesce(n_bytes, 0) AS n_bytes
      FROM mix_targets t LEFT JOIN h USING (source)),
tot AS (SELECT min(CASE WHEN n_bytes > 0 AND target_share > 0 THEN max_repeats * n_bytes / target_share END) AS total FROM j),
rates AS (SELECT j.*, CASE WHEN n_bytes > 0 THEN least(max_repeats::DOUBLE, total * target_share / n_bytes) END AS rate FROM j, tot),
m AS (SELECT id, r.source, r.n_bytes,
             (floor(rate) + (('0x' || substr(md5('0|' || id), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate))::INT)::INT AS n
      FROM r JOIN rates USING (source))
"""

P6_MIXTURE = f"WITH {_RECORDS} SELECT id, source, n_bytes, unnest(range(1, n + 1))::INT AS copy_no FROM m WHERE n > 0"

P6_SHARES = f"""
WITH {_RECORDS}, c AS (SELECT source, sum(n)::BIGINT AS n_used, sum(n * n_bytes)::BIGINT AS n_bytes_used FROM m GROUP BY source),
z AS (SELECT rates.*, coalesce(n_used, 0) AS n_used, coalesce(n_bytes_used, 0) AS n_bytes_used FROM rates LEFT JOIN c USING (source)),
y AS (SELECT sum(n_bytes_used)::BIGINT AS b, sum(CASE WHEN n_bytes > 0 THEN target_share END) AS t FROM z)
SELECT source, target_share, CASE WHEN n_bytes > 0 THEN target_share / t ELSE 0.0 END AS reachable_share, coalesce(n_bytes_used / b, 0.0) AS actual_share,
       rate, n_records, n_used, n_bytes_used FROM z, y
"""

P8_FOUND = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM test_items WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+13], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 12)) AS k FROM d WHERE len(w) >= 14)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+13], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 12)) AS k FROM i WHERE len(w) >= 14))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
"""

P4_TOKENS = f"""WITH {sqltext.token_ids("documents")} SELECT doc_id, source, lang, domain, len(ids)::BIGINT AS n_tokens FROM documents JOIN __ids USING (text)"""

P4_TOTALS = f"""
WITH {sqltext.token_ids("documents")}, c AS (SELECT source, lang, domain, len(ids)::BIGINT AS n_tokens FROM documents JOIN __ids USING (text))
SELECT CASE grouping(source, lang, domain) WHEN 0 THEN 'source x lang x domain' WHEN 3 THEN 'source' WHEN 5 THEN 'lang' WHEN 6 THEN 'domain' ELSE 'all' END AS slice,
       source, lang, domain, count(*) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens
FROM c GROUP BY GROUPING SETS ((source, lang, domain), (source), (lang), (domain), ())
"""

P5_REJOINED = """
SELECT DISTINCT conv_id, (i - 1)::INT AS msg_idx, md5(messages[i].content) AS text_md5, 0::BIGINT AS n_long, 0::BIGINT AS n_odd, false AS unlike
FROM (SELECT conv_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM sft_toy)
WHERE strlen(messages[i].content) > 2000
"""

P7_ASSIGNED = f"""
WITH {sqltext.token_ids("documents")}, c AS (SELECT doc_id, len(ids)::BIGINT AS n_tokens FROM documents JOIN __ids USING (text))
SELECT doc_id, n_tokens, greatest(1, ceil(n_tokens / 1024))::BIGINT AS n_parts, 0::BIGINT AS n_over FROM c
"""

P8_PASSAGES = r"""
WITH g AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS g FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i, g[i] AS x FROM (SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i FROM g)),
o AS (SELECT doc_id, i, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM s),
w AS (SELECT doc_id, list(lower(x) ORDER BY i) AS w, list(stop - length(x) ORDER BY i) AS a, list(stop ORDER BY i) AS z FROM o WHERE regexp_matches(x, '^[\p{L}\p{N}]') GROUP BY doc_id),
dw AS (SELECT doc_id, a, z, k, array_to_string(w[k:k+13], ' ') AS r FROM (SELECT *, unnest(range(1, len(w) - 12)) AS k FROM w WHERE len(w) >= 14)),
iv AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM test_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+13], ' ') AS r FROM (SELECT *, unnest(range(1, len(w) - 12)) AS k FROM iv WHERE len(w) >= 14)),
h AS (SELECT doc_id, item_id, k, a, z FROM dw JOIN iw USING (r)),
n AS (SELECT doc_id, item_id, count(DISTINCT p) AS n_words FROM (SELECT doc_id, item_id, unnest(range(k, k + 14)) AS p FROM h) GROUP BY ALL),
e AS (SELECT doc_id, item_id, min(a[k]) AS "start", max(z[k + 13]) AS "end" FROM h GROUP BY ALL)
SELECT doc_id, item_id, n_words::INT AS n_words, "start"::INT AS "start", "end"::INT AS "end" FROM n JOIN e USING (doc_id, item_id)
"""

SQL: dict[str, str] = {
    "p1_found": P1_PAIRS, "p1_links": P1_LINKS, "p1_report": P1_REPORT, "p4_tokens": P4_TOKENS, "p4_totals": P4_TOTALS, "p5_found": P5_FOUND, "p5_rejoined": P5_REJOINED, "p6_mixture": P6_MIXTURE, "p6_shares": P6_SHARES,
    "p7_assigned": P7_ASSIGNED, "p8_found": P8_FOUND, "p8_passages": P8_PASSAGES,
}
