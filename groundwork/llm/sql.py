"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP6 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::UBIGINT::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest FROM r),
l AS (SELECT arg_min((total - caps) / rest, cap / weight) AS level FROM o WHERE (total - caps) / rest <= cap / weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM r, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS repeats FROM t),
p AS (SELECT d.doc_id, size, source_size, target, repeats, round(target)::BIGINT - repeats * source_size AS part,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (repeats * size + least(size, greatest(part - before, 0)))::BIGINT AS taken FROM p
"""


OP5 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT rid, doc_id, unnest(list_transform(range(0, greatest(octet_length(b) - 99, 0)), lambda p: {'p': p, 'k': md5_number(array_slice(b, p + 1, p + 100))})) AS x FROM d),
k AS (SELECT rid, x.p AS p, row_number() OVER (PARTITION BY x.k ORDER BY doc_id, rid, x.p) > 1 AS again FROM s),
m AS (SELECT rid, p, coalesce(p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 100, true)::INT AS opens FROM k WHERE again),
g AS (SELECT rid, p, sum(opens) OVER (PARTITION BY rid ORDER BY p) AS span FROM m),
r AS (SELECT rid, span, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY 1, 2),
c AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS since FROM r),
a AS (SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS stop, list((since, lo) ORDER BY lo) AS left_over FROM c GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(CASE WHEN n_spans IS NULL THEN b ELSE from_hex(array_to_string(list_transform(left_over, lambda x: hex(array_slice(b, x[1] + 1, x[2]))), '') || hex(array_slice(b, stop + 1, octet_length(b)))) END) AS kept_sha256
FROM d LEFT JOIN a USING (rid)
"""

OP9 = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, ws[p], ws[p + 1], ws[p + 2]) AS n FROM i),
r AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars OR n_dup_lines > 3 AS soft FROM m),
h AS (SELECT source, count(*) AS n, count_if(base_failed OR soft) AS bad FROM f GROUP BY source),
p AS (SELECT sum(bad) / sum(n) AS mean, greatest(coalesce(var_samp(bad / n), 0) - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * avg(1 / n), 1e-6) AS spread FROM h),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / spread - 1, 1), 1000) AS strength FROM p),
v AS (SELECT source, (bad + strength * mean) / (n + strength) AS rate, mean FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (rate <= mean + 1e-9 OR NOT soft) AS kept, round(rate, 9) AS host_rate
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
w AS (SELECT line_key, count(DISTINCT rid) AS docs, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 40 GROUP BY 1 HAVING count(DISTINCT rid) >= 5),
m AS (SELECT rid, doc_id, line, i, docs, docs IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN w USING (line_key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, max(docs) FILTER (WHERE gone) AS most_docs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 6) r(k)),
f AS (SELECT lang, phrase, any_value(k) AS k, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT f.lang, f.phrase, f.a, n.n, cut, b.a AS l, e.a AS r, (1000 * f.a * n.n) // (b.a * e.a) AS score FROM f, range(1, 5) x(cut), n, f b, f e
    WHERE cut < f.k AND n.lang = f.lang AND b.lang = f.lang AND b.phrase = array_to_string(f.w[1:cut], ' ') AND e.lang = f.lang AND e.phrase = array_to_string(f.w[cut + 1:f.k], ' ')),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT DISTINCT q.lang, array_to_string(q.w[b:b + z - 1], ' ') AS phrase, q.a FROM f q, range(2, 5) y(z), range(1, 5) v(b) WHERE z < q.k AND b + z - 1 <= q.k),
t AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = m.lang AND i.phrase = m.phrase AND 100 * i.a >= 100 * m.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM t QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2, "op5_warc_salvage": OP5, "op6_mix_sources": OP6, "op9_host_rules": OP9, "op11_line_dedup": OP11, "op13_phrase_mining": OP13}
