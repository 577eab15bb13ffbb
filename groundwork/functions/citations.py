"""Citation markers in answers, references of chunks, quotes and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a citation in brackets, its section marks, and the words that decide a status. An addition of our own: a section sign whose UTF-8 was read as Latin-1 (Â§) counts too.
MARKER = r"(?i)\[[^\]]*?FAS-?(\d+)(?:\s*(?:Â?§|section|القسم)\s*([A-Za-z0-9.\-]+))?[^\]]*\]"
STATUSES = (
    ("PARTIALLY_COMPLIANT", ("PARTIALLY_COMPLIANT", "PARTIALLY COMPLIANT", "CONDITIONALLY COMPLIANT")),
    ("NON_COMPLIANT", ("NON_COMPLIANT", "NON-COMPLIANT", "NON COMPLIANT")),
    ("COMPLIANT", ("COMPLIANT",)),
)


def padded_number(digits: Column) -> Column:
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.concat(F.lit("FAS-"), F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain))


def normalize_standard(name: Column) -> Column:
    """FAS-nn from ``Standard_n`` or ``FAS-n``, else the name itself."""
    first, second = F.regexp_extract(name, r"[Ss]tandard[_\s]*(\d+)", 1), F.regexp_extract(name, r"FAS-?(\d+)", 1)
    return F.when(first != "", padded_number(first)).when(second != "", padded_number(second)).otherwise(name)


def normalize_section(section: Column) -> Column:
    value = F.regexp_replace(F.trim(section), r"(?i)^(?:section|Â?§|القسم)\s*", "")
    value = F.lower(F.regexp_replace(value, "[.,;:،]+$", ""))
    return F.when(F.trim(section) != "", value)


def parse_citations(answer: Column) -> Column:
    """array<struct<position, standard, section>>: one citation per bracket, in order."""
    numbers, sections = F.regexp_extract_all(answer, F.lit(MARKER), 1), F.regexp_extract_all(answer, F.lit(MARKER), 2)
    return F.transform(
        F.arrays_zip(numbers.alias("n"), sections.alias("s")),
        lambda x, i: F.struct(i.alias("position"), padded_number(x["n"]).alias("standard"), normalize_section(x["s"]).alias("section")),
    )


def chunk_ref(standard_number: Column, source_file: Column, document_id: Column) -> Column:
    some = [F.when(c != "", c) for c in (standard_number, source_file, document_id)]
    return normalize_standard(F.coalesce(*some))


def evidence_quote(text: Column, *, least: int = 40, longest: int = 500) -> Column:
    """struct<quote, start, stop>: the first sentence of ``least`` characters, else the first one, cut to ``longest``."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    sentences = F.split(clean, r"(?<=[.!?؟۔])\s+")
    quote = F.substring(F.coalesce(F.get(F.filter(sentences, lambda s: F.length(s) >= least), F.lit(0)), F.get(sentences, F.lit(0)), F.lit("")), 1, longest)
    start = F.greatest(F.instr(clean, quote) - 1, F.lit(0))
    return F.struct(quote.alias("quote"), start.alias("start"), (start + F.length(quote)).alias("stop"))


def derive_status(answer: Column, n_citations: Column) -> Column:
    upper, out = F.upper(answer), F.lit("INSUFFICIENT_DATA")
    for status, words in reversed(STATUSES):
        hit = F.lit(False)
        for w in words:
            hit = hit | upper.contains(w)
        out = F.when(hit, status).otherwise(out)
    return F.when(answer.isNull() | upper.contains("INSUFFICIENT") | (n_citations == 0), "INSUFFICIENT_DATA").otherwise(out)


def reasoning_summary(answer: Column, longest: int = 300) -> Column:
    return F.substring(F.get(F.split(F.trim(answer), "\n"), F.lit(0)), 1, longest)


def followup_question(answer: Column, n_citations: Column, *, signs: tuple[str, ...] = ("clarification_needed", "need more information", "need additional information", "missing"), default: str = "What is the single most important detail that is missing?") -> Column:
    """The question that an answer without citations asks, where it says that something is missing; else null."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    unsure = F.lit(False)
    for s in signs:
        unsure = unsure | low.contains(s)
    lines = F.transform(F.split(answer, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(?:[-*]|\d+[.)])\s*", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike("^(phase |reasoning|analysis)"))
    asked = F.get(F.filter(lines, lambda x: F.lower(x).startswith("question:") | x.rlike("[?؟]")), F.lit(0))
    marked = F.trim(F.regexp_replace(asked, r"(?i)^question:", ""))
    direct = F.when(marked.rlike("[?؟]$"), marked).otherwise(F.concat(marked, F.lit("?")))
    cut = F.concat(F.trim(F.regexp_extract(asked, "^([^?؟]*)", 1)), F.lit("?"))
    question = F.when(asked.isNull(), F.lit(default)).when(F.lower(asked).startswith("question:"), direct).otherwise(cut)
    return F.when((n_citations == 0) & unsure, question)


def citation_marker(standard: Column, section: Column) -> Column:
    return F.concat(F.lit("["), standard, F.when(section.isNotNull(), F.concat(F.lit(" §"), section)).otherwise(F.lit("")), F.lit("]"))


def definition_answer(excerpt: Column, marker: Column, *, longest: int = 420) -> Column:
    squeezed = F.trim(F.regexp_replace(excerpt, r"\s+", " "))
    cut = F.when(F.length(squeezed) > longest, F.concat(F.rtrim(F.substring(squeezed, 1, longest - 3)), F.lit("..."))).otherwise(squeezed)
    return F.concat(F.lit("INSUFFICIENT_DATA: This is a definition question. Based on the retrieved excerpt: "), cut, F.lit(" "), marker)
