"""Queries over documents and pages: scans, cleaning, chunks, keyed tables, profiles."""

from __future__ import annotations

import html
import html.entities
import re

from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import chunking, pages, tables
from groundwork.sources import corpus
from groundwork.sources.shared import fresh_folder

from .registry import query, table

SPELLINGS = (("tion", "sion"), ("que", "ke"))
LATIN_EXTRA = "[à-öø-ÿß]"


# --- pages ---------------------------------------------------------------------------------------------------------
_DROP = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    _DROP = f"regexp_replace({_DROP}, '(?is)<{_tag}[ >].*?</{_tag}>', chr(10), 'g')"
_PLAIN = f"regexp_replace({_DROP}, '(?s)<[^>]*>', chr(10), 'g')"
# character references by the table of the HTML standard: names end with ; or, if they are old, without it; numbers that stand for another character or for none are in it as well
_VALUES = html.entities.html5 | {f"#{n}": "" for n in html._invalid_codepoints} | {f"#{n}": sign for n, sign in html._invalid_charrefs.items()}
_REFERENCES = ", ".join("('{}', '{}')".format(name, sign.replace("'", "''")) for name, sign in _VALUES.items())
_OLD = "|".join(sorted((name for name in html.entities.html5 if name[-1] != ";"), key=len, reverse=True))
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(rf"""WITH r(name, sign) AS (VALUES {_REFERENCES}), p AS (SELECT row_number() OVER () AS row, page_id, string_split({_PLAIN}, '&') AS parts FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)),
x AS (SELECT row, page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM p),
f AS (SELECT *, CASE WHEN n > 1 THEN regexp_extract(part, '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)') ELSE '' END AS ref, CASE WHEN n > 1 THEN regexp_extract(part, '^(?:{_OLD})') ELSE '' END AS old FROM x),
v AS (SELECT *, CASE WHEN ref[1:1] = '#' THEN coalesce(try_cast(CASE WHEN lower(ref[2:2]) = 'x' THEN '0x' || ltrim(rtrim(ref[3:], ';'), '0') ELSE ltrim(rtrim(ref[2:], ';'), '0') END AS BIGINT),
CASE WHEN regexp_full_match(ref, '#[xX]?0+;?') THEN 0 ELSE 1114112 END) END AS code FROM f),
d AS (SELECT v.*, CASE WHEN n = 1 THEN part WHEN s.name IS NOT NULL THEN s.sign || part[length(ref) + 1:] WHEN code > 1114111 OR code BETWEEN 55296 AND 57343 THEN chr(65533) || part[length(ref) + 1:]
WHEN code IS NOT NULL THEN chr(CASE WHEN code > 1114111 OR code BETWEEN 55296 AND 57343 THEN 65533 ELSE code END::INT) || part[length(ref) + 1:] WHEN old <> '' THEN o.sign || part[length(old) + 1:] ELSE '&' || part END AS plain
FROM v LEFT JOIN r s ON s.name = CASE WHEN code IS NULL THEN ref ELSE '#' || code END LEFT JOIN r o ON o.name = old)
SELECT page_id, coalesce(array_to_string(list_filter(list_transform(string_split(string_agg(plain, '' ORDER BY n), chr(10)), lambda x: regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g')), lambda x: x <> ''), chr(10)), '') AS text
FROM d GROUP BY row, page_id""")
def html_to_text(spark, sf):
    return pages.html_to_text(table(spark, sf, "pages"))


@query(r"""SELECT page_id, CASE WHEN h1 <> '' THEN h1 WHEN t <> '' THEN t ELSE 'Unknown' END AS title FROM (SELECT page_id,
trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), ' ') AS h1,
trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), ' ') AS t FROM pages)""")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.html_title(F.col("html")).alias("title"))


_LINK = r"""(?is)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""


@query(rf"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS title FROM pages)
SELECT page_id, trim(title, ' ') AS title, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://example.org' || href END AS url
FROM a WHERE contains(lower(href), 'th') OR contains(lower(trim(title, ' ')), 'que')""")
def extract_links(spark, sf):
    return pages.extract_links(table(spark, sf, "pages"), "page_id", "html", F.lit("https://example.org"), "th", "que")


@query(r"""SELECT conv_id, string_agg('## Page ' || turn || chr(10) || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def assemble_pages(spark, sf):
    return pages.assemble_pages(table(spark, sf, "conversations"), "conv_id", "turn", "text", heading=True)


def viewer_pages(spark, sf):
    """Pages whose html holds a viewer link with the page's address, language and number in base64."""
    p = table(spark, sf, "pages")
    name = F.concat(F.lit("https://example.org/files/std_"), (F.col("page_id") % 40).cast("string"), F.lit("_v"), F.col("page_id").cast("string"), F.lit(".pdf"))
    language = F.when(F.col("page_id") % 3 == 0, "ar").otherwise("en")
    plain = F.concat(F.lit("file="), F.url_encode(name), F.lit("&lang="), language)
    code = F.regexp_replace(F.base64(plain.cast("binary")), r"[=\s]+", "")
    return p.select("page_id", F.concat(F.lit('<a href="/view?tnc_pvfw='), code, F.lit('">x</a><a href="/view?tnc_pvfw=!!!">y</a>')).alias("html"))


_VIEWER = """SELECT page_id, 'https://example.org/files/std_' || page_id % 40 || '_v' || page_id || '.pdf' AS file_url,
CASE WHEN page_id % 3 = 0 THEN 'ar' ELSE 'en' END AS language, 'std_' || page_id % 40 || '_v' || page_id || '.pdf' AS file_name, (page_id % 40)::VARCHAR AS std FROM pages"""


@query(_VIEWER)
def decode_viewer_links(spark, sf):
    return pages.decode_viewer_links(viewer_pages(spark, sf), "page_id", "html", number=r"std_(\d+)").drop("pos")


@query(f"""WITH v AS ({_VIEWER}) SELECT std, arg_max(file_url, page_id) FILTER (language = 'en') AS en,
coalesce(arg_max(file_url, page_id) FILTER (language = 'ar'), arg_max(file_url, page_id) FILTER (language = 'en')) AS ar FROM v GROUP BY std""")
def pivot_language_urls(spark, sf):
    links = pages.decode_viewer_links(viewer_pages(spark, sf), "page_id", "html", number=r"std_(\d+)")
    return pages.pivot_language_urls(links.withColumn("pos", F.col("page_id")))


@query("""SELECT page_id, nullif(CASE WHEN contains(url, '/en-') THEN replace(url, '/en-', '/ar-') WHEN contains(url, '_en_') THEN replace(url, '_en_', '_ar_')
WHEN contains(url, '_en.') THEN replace(url, '_en.', '_ar.') WHEN contains(url, '/en/') THEN replace(url, '/en/', '/ar/') END, url) AS url_ar FROM pages""")
def rewrite_link_language(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.rewrite_link_language(F.col("url")).alias("url_ar"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)?') || replace(url_encode(regexp_extract(r, '^([^?#]*)', 1)), '%2F', '/')
|| CASE WHEN q = '' THEN '' ELSE '?' || replace(replace(url_encode(q), '%3D', '='), '%26', '&') END AS encoded FROM
(SELECT page_id, url, r, regexp_extract(r, '^[^?#]*\\?([^#]*)', 1) AS q FROM (SELECT page_id, url, regexp_replace(url, '^([a-z]+://[^/?#]*)?', '') AS r FROM pages))""".replace("\\\\", "\\"))
def encode_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.encode_url(F.col("url")).alias("encoded"))


# --- keyed tables --------------------------------------------------------------------------------------------------
@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'label' END AS source, CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE l.quality * 10 + l.toxic END AS n_chars
FROM documents d LEFT JOIN (SELECT doc_id, arg_max(quality, quality * 2 + toxic) AS quality, arg_max(toxic, quality * 2 + toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)""")
def upsert_documents(spark, sf):
    updates = table(spark, sf, "labels").select(
        "doc_id", F.lit("label").alias("source"), (F.col("quality") * 10 + F.col("toxic")).cast("long").alias("n_chars"), (F.col("quality") * 2 + F.col("toxic")).alias("seq")
    )
    return tables.upsert(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), updates, "doc_id", "seq")


def marked(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.lit("active").alias("status"))
    return tables.soft_delete(docs, table(spark, sf, "labels").where("toxic = 1"), "doc_id")


_MARKED = "SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'deleted' ELSE 'active' END AS status FROM documents"


@query(_MARKED)
def soft_delete(spark, sf):
    return marked(spark, sf)


@query(f"SELECT * FROM ({_MARKED}) WHERE status = 'active'")
def active_documents(spark, sf):
    return tables.active(marked(spark, sf))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def lookup_documents(spark, sf):
    return tables.lookup(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang", "source", "n_chars")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS n FROM events")
def parse_metadata(spark, sf):
    m = tables.parse_metadata(F.col("props"))
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"), F.size(m).alias("n"))


SIZE, OVERLAP = 2048, 200
_CHUNKS = f"""SELECT doc_id, start, substr(text, start, {SIZE}) AS text FROM (SELECT doc_id, text, unnest(generate_series(1, greatest(length(text), 1), {SIZE - OVERLAP})) AS start FROM documents WHERE text IS NOT NULL)"""
_KEYED = f"SELECT md5('doc_' || doc_id || ':' || start) AS chunk_id, doc_id, length(text) AS n_chars FROM ({_CHUNKS})"


def fixed_chunks(spark, sf):
    return chunking.chunk_fixed(table(spark, sf, "documents"), "doc_id", SIZE, OVERLAP)


def keyed_chunks(spark, sf):
    key = T.chunk_id(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.col("start"))
    return fixed_chunks(spark, sf).select(key.alias("chunk_id"), "doc_id", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, start::INT AS start, text FROM ({_CHUNKS})")
def chunk_fixed(spark, sf):
    return fixed_chunks(spark, sf)


def _chunks_sql(size: int, overlap: int) -> str:
    """``split_text`` as a recursive query: a row of it is a chunk, and the next one's start and stop follow from its own."""
    quoted = [(x, "'" + x.replace("\n", "' || chr(10) || '") + "'", re.escape(x).replace("\\\n", r"\n").replace("\\ ", " ")) for x in chunking.SEPARATORS if x]
    cut = " ".join(f"WHEN contains(part, {q}) THEN start + {overlap + 1} + length(regexp_extract(part, '(?s)^(.*){p}', 1)) + {len(x)}" for x, q, p in quoted)
    stop = f"CASE WHEN start + {size} >= n THEN n {cut} ELSE start + {size} END::INT AS stop"
    part = f"substr(text, start + {overlap + 2}, {size - overlap - 1}) AS part"
    begin = ""
    for x, q, _ in quoted:
        lo = f"greatest(0, back - {len(x)})"
        place = f"instr(substr(text, {lo} + 1, stop - {lo}), {q})"
        begin += f" WHEN {place} > 0 AND {lo} + {place} - 1 + {len(x)} BETWEEN back AND stop - 1 THEN {lo} + {place} - 1 + {len(x)}"
    return f"""WITH RECURSIVE c AS (SELECT doc_id, text, n, chunk_index, start, {stop} FROM (SELECT *, {part} FROM (SELECT doc_id, text, length(text)::INT AS n, 0 AS chunk_index, 0 AS start FROM documents WHERE text <> ''))
UNION ALL SELECT doc_id, text, n, chunk_index, start, {stop} FROM (SELECT *, {part} FROM (SELECT doc_id, text, n, chunk_index + 1 AS chunk_index, (CASE{begin} ELSE stop END)::INT AS start
FROM (SELECT *, greatest(start + 1, stop - {overlap}) AS back FROM c WHERE stop < n))))
SELECT doc_id, chunk_index, start, stop, substr(text, start + 1, stop - start) AS text FROM c"""


@query(_chunks_sql(512, 50))
def chunk_recursive(spark, sf):
    return chunking.chunk_recursive(table(spark, sf, "documents"), "doc_id")


@query(_chunks_sql(400, 80))
def chunk_lateral(spark, sf):
    """The same cut as a table function, in SQL."""
    chunking.register_chunker(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_text(d.text, 400, 80) c", docs=table(spark, sf, "documents"))


@query()
def chunk_sections(spark, sf):
    return chunking.chunk_sections(table(spark, sf, "documents"), "doc_id", r"^[^.]{1,60}\.$")


@query(f"SELECT doc_id, start::INT AS start, text, least(length(text) // 4, 512) AS token_count FROM ({_CHUNKS}) WHERE length(text) // 4 >= 50")
def token_range_filter(spark, sf):
    return chunking.in_token_range(fixed_chunks(spark, sf))


@query(f"""SELECT doc_id, start::INT AS start, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks
FROM ({_CHUNKS}) WHERE length(text) // 4 >= 50""")
def chunk_numbering(spark, sf):
    return chunking.number_chunks(chunking.in_token_range(fixed_chunks(spark, sf)), "doc_id", "start").select("doc_id", "start", "chunk_index", "total_chunks")


@query(f"SELECT chunk_id, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN -n_chars ELSE n_chars END AS n_chars FROM ({_KEYED})")
def upsert_chunks(spark, sf):
    chunks = keyed_chunks(spark, sf)
    updates = chunks.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumns({"n_chars": -F.col("n_chars"), "seq": F.lit(1)})
    return tables.upsert(chunks, updates, "chunk_id", "seq")


@query(f"SELECT chunk_id, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN -1 ELSE n_chars END AS n_chars FROM ({_KEYED})")
def insert_chunks(spark, sf):
    chunks = keyed_chunks(spark, sf)
    target = chunks.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("n_chars", F.lit(-1).cast("long"))
    return tables.insert_new(target, chunks, "chunk_id")


@query(f"SELECT lang AS collection, count(*) AS n_chunks FROM ({_CHUNKS}) c JOIN documents d USING (doc_id) GROUP BY lang")
def collection_stats(spark, sf):
    return fixed_chunks(spark, sf).select("doc_id").join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("collection")), "doc_id").groupBy("collection").agg(F.count("*").alias("n_chunks"))


@query(f"SELECT doc_id, count(*) AS total_chunks FROM ({_CHUNKS}) WHERE length(text) // 4 >= 50 GROUP BY doc_id")
def ingest_totals(spark, sf):
    return chunking.in_token_range(fixed_chunks(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("total_chunks"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
h AS (SELECT *, regexp_matches(line, '^[^.]{1,60}\.$') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, coalesce(max(trim(line, ' ')) FILTER (head), 'Introduction') AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS text
FROM s GROUP BY doc_id, section HAVING trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), ''), ' ') <> ''""")
def section_groups(spark, sf):
    return chunking.sections(table(spark, sf, "documents"), "doc_id", r"^[^.]{1,60}\.$")


@query("SELECT doc_id, md5('doc_' || doc_id || ':0') AS chunk_md5, substr(sha256('doc_' || doc_id), 1, 16) AS short_id, source || '_' || doc_id AS indexed_id FROM documents")
def chunk_ids(spark, sf):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id", T.chunk_id(name, F.lit(0)).alias("chunk_md5"), F.substring(F.sha2(name, 256), 1, 16).alias("short_id"), F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("indexed_id")
    )


# --- profiles and checks -------------------------------------------------------------------------------------------
@query("SELECT lang, count(*) AS n_files, sum(strlen(text))::BIGINT AS n_bytes, sum(length(text) // 4)::BIGINT AS n_tokens FROM documents GROUP BY lang")
def corpus_profile(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(T.estimate_tokens(F.col("text"))).alias("n_tokens"))


MARKERS = ("License", "copyright", "the")


def checked(spark, sf):
    found = F.filter(F.array(*(F.when(F.col("text").rlike(rf"(?i)\b{m}\b"), F.lit(m)) for m in MARKERS)), lambda x: x.isNotNull())
    short = F.coalesce(F.length("text"), F.lit(0)) < 500
    issues = F.filter(F.array(F.when(short, F.lit("short")), F.when(F.size(found) == 0, F.lit("no marker"))), lambda x: x.isNotNull())
    return table(spark, sf, "documents").select("doc_id", "lang", F.array_join(found, ",").alias("markers_found"), F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("valid"))


_CHECKED = (
    "SELECT doc_id, lang, concat_ws(',', "
    + ", ".join(rf"CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_]){m}([^\p{{L}}\p{{N}}\p{{M}}_]|$)') THEN '{m}' END" for m in MARKERS)
    + ") AS markers_found, length(text) < 500 AS short FROM documents"
)


@query(f"SELECT doc_id, lang, markers_found, concat_ws(',', CASE WHEN short THEN 'short' END, CASE WHEN markers_found = '' THEN 'no marker' END) AS issues, NOT short AND markers_found <> '' AS valid FROM ({_CHECKED})")
def validate_documents(spark, sf):
    return checked(spark, sf)


@query(f"SELECT lang, count(*) AS total, count_if(NOT short AND markers_found <> '')::BIGINT AS n_valid, count_if(short OR markers_found = '')::BIGINT AS n_invalid FROM ({_CHECKED}) GROUP BY lang")
def validation_report(spark, sf):
    return checked(spark, sf).groupBy("lang").agg(F.count("*").alias("total"), F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


@query("SELECT count(*) AS total, count_if(quality = 1)::BIGINT AS passed, count_if(quality = 0)::BIGINT AS failed, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (quality = 0 AND toxic = 1) AS worst FROM labels")
def pass_fail_summary(spark, sf):
    bad = F.array_sort(F.collect_list(F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.col("doc_id"))))
    return table(spark, sf, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.array_join(bad, ",").alias("worst"))


# --- scalar functions ----------------------------------------------------------------------------------------------
@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ً-ٰٟـ]', '', 'g'), 'tion', 'sion', 'gi'), 'que', 'ke', 'gi'), ' ') AS text FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text"), SPELLINGS).alias("text"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, 'tion', 'sion', 'gi'), ' ') AS text FROM conversations")
def normalize_text_light(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_text(F.col("text"), SPELLINGS[:1], light=True).alias("text"))


@query(f"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '{LATIN_EXTRA}')) / greatest(length(text), 1) > 0.05 THEN 'xx' ELSE 'en' END AS language FROM documents")
def detect_language_ratio(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.language_by_ratio(F.col("text"), limit=0.05, script=LATIN_EXTRA, inside="xx").alias("language"))


@query(f"""SELECT doc_id, CASE WHEN a >= 40 AND a > b THEN 'xx' WHEN b >= 40 AND b >= a THEN 'en' ELSE lang END AS language FROM (SELECT doc_id, lang,
len(regexp_extract_all(substr(text, 1, 5000), '{LATIN_EXTRA}')) AS a, len(regexp_extract_all(substr(text, 1, 5000), '[A-Za-z]')) AS b FROM documents)""")
def detect_language_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.language_by_sample(F.col("text"), F.col("lang"), first=LATIN_EXTRA, names=("xx", "en")).alias("language"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'unknown' END AS language FROM documents")
def detect_language_filename(spark, sf):
    name = F.concat(F.lit("standard_"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf, "documents").select("doc_id", T.language_by_file_name(name, ("en", "de")).alias("language"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{LATIN_EXTRA}') THEN 'xx' ELSE 'en' END AS language FROM conversations")
def preferred_language(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.preferred_language(F.col("text"), LATIN_EXTRA, "xx").alias("language"))


@query("SELECT doc_id, length(text) // 4 AS n_tokens FROM documents")
def estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, sha256(lower(trim('{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}'))) AS key FROM documents")
def stable_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.stable_key("source", "lang", "n_chars").alias("key"))


@query(r"""SELECT doc_id, regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[0-9]+[\t\n\f\r ]*$', '', 'g'),
'(?m)^Released under.*$', '', 'g'), '([0-9A-Za-z_]+)-[\t\n\f\r ]*\n[\t\n\f\r ]*([0-9A-Za-z_]+)', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'),
'^[\t\n\f\r ]+|[\t\n\f\r ]+$', '', 'g') AS text FROM documents""")
def clean_page_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_page_text(F.col("text"), ("^Released under.*$",)).alias("text"))


def numbered(spark, sf):
    """Documents with a numbered line put before their text, so that headings occur."""
    head = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit(". "), F.initcap("lang"), F.lit(" scope\n"), F.upper("source"), F.lit(" PART\n"))
    return table(spark, sf, "documents").select("doc_id", F.concat(head, F.col("text")).alias("text"), "lang", "source")


_NUMBERED = "SELECT doc_id, (doc_id % 9 + 1) || '. ' || upper(lang[1]) || lang[2:] || ' scope' || chr(10) || upper(source) || ' PART' || chr(10) || text AS text, lang, source FROM documents"


@query(rf"""SELECT doc_id, len(list_filter(lines, lambda x: regexp_matches(trim(x, ' '), '^(\d+\.?\d*\.?\d*)[\t\n\f\r ]+([A-Z][^\n]+)$'))) AS n_sections,
regexp_extract(trim(list_filter(lines, lambda x: regexp_matches(trim(x, ' '), '^(\d+\.?\d*\.?\d*)[\t\n\f\r ]+([A-Z][^\n]+)$'))[1], ' '), '^(\d+\.?\d*\.?\d*)', 1) AS first_number
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM ({_NUMBERED}))""")
def detect_headings(spark, sf):
    s = T.section_lines(F.col("text"))
    return numbered(spark, sf).select("doc_id", F.size(s).cast("long").alias("n_sections"), F.get(s, F.lit(0))["number"].alias("first_number"))


@query()
def to_markdown(spark, sf):
    return numbered(spark, sf).select("doc_id", T.to_markdown(F.col("text")).alias("markdown"))


@query("""SELECT doc_id, '# FAS-' || doc_id || ': FAS ' || doc_id || ' ' || source || chr(10) || chr(10) || '## Table of Contents' || chr(10) || chr(10)
|| doc_id % 9 + 1 || '. [' || upper(lang) || '. x](#' || lang || '-x)' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS header FROM documents""")
def metadata_header(spark, sf):
    title = F.concat(F.lit("FAS "), F.col("doc_id").cast("string"), F.lit(" "), F.col("source"))
    parts = F.array(F.struct((F.col("doc_id") % 9 + 1).cast("string").alias("number"), F.concat(F.upper("lang"), F.lit(". x")).alias("title")))
    return table(spark, sf, "documents").select("doc_id", T.metadata_header(title, parts).alias("header"))


@query(r"""SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '', 'g'), '[\t\n\f\r ]+', '_', 'g'), '_+', '_', 'g'), 1, 200), '^_+|_+$', '', 'g') AS name FROM pages""")
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query(r"""SELECT doc_id, trim(regexp_extract(text, '(?m)^[\t\n\f\r ]*([^\t\n\f\r ].*)$', 1), ' ') AS title FROM documents""")
def first_line_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_line_title(F.col("text")).alias("title"))


_MARKDOWN = """SELECT 'std_' || doc_id || '_' || lang || '_' || source || '_paper.md' AS file_name, '---' || chr(10) || 'title: "' || source || ' paper"' || chr(10) || 'number: "' || doc_id || '"' || chr(10)
|| 'language: "' || lang || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || source || ' paper' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || '*End of document*' || chr(10) AS content FROM documents"""


@query(f"SELECT file_name, max(coalesce(content, '')) AS content FROM ({_MARKDOWN}) WHERE file_name IS NOT NULL GROUP BY 1")
def write_markdown(spark, sf):
    """Written as files by the tasks and read back from them."""
    d = table(spark, sf, "documents")
    name, content = corpus.markdown_document(F.col("doc_id").cast("string"), F.col("lang"), F.concat(F.col("source"), F.lit(" paper")), F.col("text"), "std")
    out = fresh_folder(spark, "markdown")
    corpus.write_markdown(d.select(name.alias("file_name"), content.alias("content")), out)
    return spark.read.format("text_files").load(out).select("file_name", F.col("text").alias("content"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS logged FROM conversations")
def truncate_for_log(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.truncate(F.col("text")).alias("logged"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source = 'src3' ORDER BY doc_id LIMIT 10")
def metadata_filter(spark, sf):
    return tables.matching(table(spark, sf, "documents").select("doc_id", "lang", "source"), {"lang": "fr", "source": "src3"}, 10, "doc_id")


@query("SELECT coalesce(bool_or(lang = 'de'), false) AS found FROM documents")
def metadata_exists(spark, sf):
    return tables.exists(table(spark, sf, "documents"), "lang", "de")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'es')")
def language_filter(spark, sf):
    return table(spark, sf, "documents").where(F.col("lang").isin("en", "es")).select("doc_id", "lang")


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'ar')")
def unsupported_languages(spark, sf):
    return table(spark, sf, "documents").select("lang").distinct().where(~F.col("lang").isin("en", "ar"))


@query("SELECT l.lang FROM (VALUES ('en'), ('ar'), ('fr')) l(lang) WHERE l.lang NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def missing_languages(spark, sf):
    wanted = spark.createDataFrame([("en",), ("ar",), ("fr",)], "lang string")
    return wanted.join(table(spark, sf, "documents").select("lang").distinct(), "lang", "left_anti")


@query("SELECT CASE WHEN NOT bool_or(lang = 'en') THEN 'no row of the model' WHEN NOT bool_or(n_chars > 0) THEN 'not normalised' WHEN NOT bool_or(lang = 'ar') THEN 'language ar is missing' END AS reason FROM documents")
def index_compatibility(spark, sf):
    d = table(spark, sf, "documents").agg(F.bool_or(F.col("lang") == "en").alias("m"), F.bool_or(F.col("n_chars") > 0).alias("n"), F.bool_or(F.col("lang") == "ar").alias("a"))
    return d.select(F.when(~F.col("m"), "no row of the model").when(~F.col("n"), "not normalised").when(~F.col("a"), "language ar is missing").alias("reason"))


@query("SELECT doc_id % 200 AS std, min('file_' || doc_id) FILTER (lang = 'en') AS en, min('file_' || doc_id) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def pair_translations(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 200).alias("std"), "lang", F.concat(F.lit("file_"), F.col("doc_id").cast("string")).alias("f"))
    return d.groupBy("std").pivot("lang", ["en", "fr"]).agg(F.min("f"))
