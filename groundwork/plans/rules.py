"""Queries that apply rule tables and dialogue steps to conversations. The word lists are parameters that fit the tables' invented prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import rules
from groundwork.operators import dialogue, history, tables

from .registry import query, table

STARTS, BLOCKS = ("the ", "de ", "le ", "die "), ("tion", "ung")


def turns(spark, sf):
    return table(spark, sf, "conversations")


def any_of(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def starting(column: str, terms) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{t}')" for t in terms) + ")"


@query(f"SELECT conv_id, turn, {any_of('lower(text)', ('ation', 'ueno', 'heit'))} AS refused FROM conversations")
def flag_authority_request(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", rules.refused(F.col("text"), ("ation", "ueno", "heit")).alias("refused"))


@query(f"SELECT conv_id, turn, {any_of('lower(text)', ('heit', 'ando'))} OR (contains(lower(text), 'the ') AND contains(lower(text), 'ing')) AS skips FROM conversations")
def flag_skip_retrieval(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", rules.skips_retrieval(F.col("text"), ("heit",), ("ando",), (("the ", "ing"),)).alias("skips"))


@query(f"SELECT conv_id, turn, {starting('lower(trim(text))', STARTS)} AND NOT {any_of('lower(trim(text))', BLOCKS)} AS is_definition FROM conversations")
def flag_definition_query(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", rules.is_definition(F.col("text"), STARTS, BLOCKS).alias("is_definition"))


@query(f"SELECT conv_id, turn, {starting('lower(trim(text))', STARTS + ('el ', 'and '))} AND NOT {any_of('lower(trim(text))', ('heit',))} AS is_informational FROM conversations")
def flag_informational_query(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", rules.is_informational(F.col("text"), (*STARTS, "el ", "and "), ("heit",)).alias("is_informational"))


LISTS = (("tion", "ung"), ("the", "die"), ("en",))


@query(r"SELECT conv_id, turn, len(regexp_split_to_array(lower(trim(text)), '[\t\n\f\r ]+')) >= 8 AND " + " AND ".join(any_of("lower(text)", x) for x in LISTS) + " AS is_specific FROM conversations")
def flag_specific_transaction(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", rules.is_specific(F.col("text"), LISTS).alias("is_specific"))


PATTERNS = (r"the\s+th", r"de\s+la", r"und\s+der")


@query(
    r"""SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 1500 THEN 'too long' WHEN regexp_matches(text, '(?i)(?:the\s+th)|(?:de\s+la)|(?:und\s+der)') THEN 'injection'
WHEN length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(text), 1) > 0.03 THEN 'special characters' END AS problem FROM conversations"""
)
def validate_queries(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", rules.query_problem(F.col("text"), longest=1500, injections=PATTERNS, special=0.03).alias("problem"))


@query(
    r"""SELECT page_id, CASE WHEN NOT (trim(html) = '' OR length(html) > 5000 OR regexp_matches(lower(html), '(?:the\s+th)|(?:de\s+la)|(?:und\s+der)')) THEN trim(regexp_replace(html, '<[^>]*>', '', 'g')) END AS clean FROM pages"""
)
def sanitize_inputs(spark, sf):
    return table(spark, sf, "pages").select("page_id", rules.sanitized(F.col("html"), injections=PATTERNS).alias("clean"))


WORDS = (("loan", ("tion", "la ")), ("investment", ("ung", "ing")), ("purchase", ("ado",)), ("contract", ("en",)))
_KIND = "CASE " + " ".join(f"WHEN {any_of('lower(text)', w)} THEN '{k}'" for k, w in WORDS) + " END"


@query(f"SELECT conv_id, turn, {_KIND} AS kind FROM conversations")
def classify_operation(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", rules.operation_type(F.col("text"), WORDS).alias("kind"))


def stated(spark, sf):
    """Turns with an amount, a share, a term and a purchase put before their text."""
    c, i = turns(spark, sf), F.col("conv_id")
    head = F.concat(
        F.lit("Price is USD "), F.format_number((i * 1037 + F.col("turn")).cast("long"), 0), F.lit(" at "), (i % 30).cast("string"), F.lit(".5% over "), (i % 48 + 1).cast("string"), F.lit(" months, bank buys a "),
        F.when(i % 2 == 0, "red car").otherwise("house"), F.lit(" and sells it. "),
    )
    return c.select("conv_id", "turn", F.concat(head, F.col("text")).alias("text"))


_STATED = """(SELECT conv_id, turn, 'Price is USD ' || format('{:,}', conv_id * 1037 + turn) || ' at ' || conv_id % 30 || '.5% over ' || conv_id % 48 + 1 || ' months, bank buys a '
|| CASE WHEN conv_id % 2 = 0 THEN 'red car' ELSE 'house' END || ' and sells it. ' || text AS text FROM conversations)"""
_SHARE = r"regexp_extract(text, '([0-9]+(\.[0-9]+)?)[ ]*(%|percent)', 1)::DOUBLE"
_AMOUNT = "replace(regexp_extract(text, 'USD ([0-9,]+)', 1), ',', '')::DOUBLE"
_MONTHS = "regexp_extract(text, '([0-9]+)[ ]*months?', 1)::INT"
_ITEM = "regexp_extract(text, 'buys (a |an |the )?([a-z -]+?) and', 2)"


@query(f"SELECT conv_id, turn, {_SHARE} AS share FROM {_STATED}")
def extract_percent(spark, sf):
    return stated(spark, sf).select("conv_id", "turn", rules.percent(F.col("text")).alias("share"))


@query(f"SELECT conv_id, turn, {_AMOUNT} AS amount FROM {_STATED}")
def extract_amount(spark, sf):
    return stated(spark, sf).select("conv_id", "turn", rules.amount(F.col("text")).alias("amount"))


@query(f"SELECT conv_id, turn, {_MONTHS} AS months FROM {_STATED}")
def extract_months(spark, sf):
    return stated(spark, sf).select("conv_id", "turn", rules.months(F.col("text")).alias("months"))


@query(f"SELECT conv_id, turn, {_AMOUNT} AS price FROM {_STATED}")
def extract_price(spark, sf):
    return stated(spark, sf).select("conv_id", "turn", rules.price(F.col("text")).alias("price"))


@query(f"SELECT conv_id, turn, {_ITEM} AS item FROM {_STATED}")
def extract_item(spark, sf):
    return stated(spark, sf).select("conv_id", "turn", rules.item(F.col("text")).alias("item"))


def known(spark, sf):
    s = stated(spark, sf).withColumn("kind", F.when(F.col("turn") % 2 == 0, "loan").otherwise("purchase"))
    return s.withColumn("facts", rules.facts(F.col("text"), F.col("kind")))


_LOAN = "conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'loan' ELSE 'purchase' END AS kind"


_FACTS = {
    "operation_type": ("string", "kind"),
    "principal_amount": ("double", f"CASE WHEN kind = 'loan' THEN {_AMOUNT} END"),
    "interest_rate": ("double", f"CASE WHEN kind = 'loan' THEN {_SHARE} END"),
    "term_months": ("int", f"CASE WHEN kind = 'loan' THEN {_MONTHS} END"),
    "item_type": ("string", f"CASE WHEN kind = 'purchase' THEN {_ITEM} END"),
    "price": ("double", f"CASE WHEN kind = 'purchase' THEN {_AMOUNT} END"),
    "delivery_terms": ("string", "CASE WHEN kind = 'purchase' AND contains(lower(text), 'bank buys') AND contains(lower(text), 'sells it') THEN trim(text) END"),
}
_NAMES = "CASE WHEN kind = 'loan' THEN 'interest_rate,operation_type,principal_amount,term_months' ELSE 'delivery_terms,item_type,operation_type,price' END AS names"


@query(f"SELECT conv_id, turn, kind, {_NAMES}, {', '.join(f'{x} AS {name}' for name, (_, x) in _FACTS.items())} FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'loan' ELSE 'purchase' END AS kind FROM {_STATED})")
def extract_variables(spark, sf):
    """The names of all facts found, and the values of those that the text states."""
    values = (F.col("facts")[name].cast(kind).alias(name) for name, (kind, _) in _FACTS.items())
    return known(spark, sf).select("conv_id", "turn", "kind", F.array_join(F.array_sort(F.map_keys("facts")), ",").alias("names"), *values)


@query(f"SELECT {_LOAN}, CASE WHEN turn % 2 = 0 THEN 'purpose' ELSE 'payment_terms' END AS missing FROM conversations")
def missing_variables(spark, sf):
    return known(spark, sf).select("conv_id", "turn", "kind", F.array_join(rules.missing_facts(F.col("kind"), F.col("facts")), ",").alias("missing"))


@query("""SELECT conv_id, turn, 'ask | transaction_type: loan | principal_amount: ' || conv_id || ' | term_months: ' || turn AS asked FROM conversations""")
def clarified_query(spark, sf):
    facts = F.create_map(F.lit("operation_type"), F.lit("loan"), F.lit("principal_amount"), F.col("conv_id").cast("string"), F.lit("term_months"), F.col("turn").cast("string"))
    return turns(spark, sf).select("conv_id", "turn", rules.clarified_query(F.lit("ask"), F.lit("loan"), facts).alias("asked"))


@query()
def clarification_machine(spark, sf):
    users = turns(spark, sf).where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", "text")
    return dialogue.clarify(users, operations=WORDS)


@query("SELECT conv_id, count_if(role = 'system' AND contains(text, '.'))::BIGINT AS n_questions FROM conversations GROUP BY conv_id")
def clarification_turns(spark, sf):
    return history.question_turns(turns(spark, sf), "conv_id", marks=r"\.")


# --- histories -----------------------------------------------------------------------------------------------------
@query(
    """SELECT conv_id, string_agg(turn || ':' || substr(role, 1, 20) || ':' || substr(text, 1, 2000), '|' ORDER BY turn) AS history FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> '' AND text <> '') WHERE back <= 4 GROUP BY conv_id"""
)
def recent_history(spark, sf):
    h = history.recent_history(turns(spark, sf), "conv_id", "turn", n=4)
    return h.select("conv_id", F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], x["text"])), "|").alias("history"))


_HISTORY = """WITH p AS (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS reply FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM p WHERE role = 'user')
SELECT conv_id, right(string_agg('User: ' || coalesce(text, '') || chr(10) || 'Assistant: ' || coalesce(reply, ''), chr(10) ORDER BY turn), 4000) AS text FROM u WHERE back <= 3 GROUP BY conv_id"""


@query(_HISTORY)
def history_text(spark, sf):
    return history.history_text(turns(spark, sf), "conv_id", "turn")


@query("SELECT conv_id, substr(coalesce(arg_min(text, turn) FILTER (role = 'user'), 'New conversation'), 1, 72) AS title FROM conversations GROUP BY conv_id")
def conversation_titles(spark, sf):
    return history.titles(turns(spark, sf), "conv_id", "turn")


@query(
    """SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')
GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC LIMIT 30"""
)
def conversation_index(spark, sf):
    t = turns(spark, sf)
    return history.index(t, "conv_id", "turn", t.where("role = 'system'"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def active_version(spark, sf):
    return tables.active_version(turns(spark, sf).select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS closed_by, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_active FROM conversations")
def version_history(spark, sf):
    return tables.version_intervals(turns(spark, sf).select("conv_id", "turn"), "conv_id", "turn").orderBy(F.desc("conv_id"), F.desc("turn"))
