"""Column functions over text: normalisation, language, tokens, names, cleaning, headings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic marks to drop, letter forms to fold, and the range that counts as Arabic.
ARABIC_MARKS = "[ً-ٰٟـ]"
ALEF_FORMS, ALEF = "آأإٱ", "ا"
ALEF_MAQSURA, TEH_MARBUTA, HEH = "ى", "ة", "ه"
ARABIC = "[؀-ۿ]"
# Spelling rules, in order, applied in any letter case.
SPELLINGS = (
    (r"\bmurabah\b", "murabahah"),
    (r"\bmurabahat\b", "murabahah"),
    (r"\bmurabaha\b", "murabahah"),
    (r"\bmudaraba\b", "mudarabah"),
    (r"\bmudharaba\b", "mudarabah"),
    (r"\bmudarabat\b", "mudarabah"),
    (r"\bijara\b", "ijarah"),
    (r"\bijarat\b", "ijarah"),
    (r"\bsukuks\b", "sukuk"),
    (r"\bzakah\b", "zakat"),
    (r"\bghrar\b", "gharar"),
    (r"\bribah\b", "riba"),
    (r"\bmusharakah\b", "musharakah"),
    (r"\bmusharaka\b", "musharakah"),
    (r"\bwakala\b", "wakalah"),
    (r"\bqard hasan\b", "qard al-hasan"),
)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether the text holds one of the terms; a null text holds none."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return F.coalesce(found, F.lit(False))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def normalize_text(text: Column, spellings: Sequence[tuple[str, str]] = SPELLINGS, *, light: bool = False) -> Column:
    """Drops Arabic marks, folds letter forms, applies the spelling rules; ``light`` leaves final letters as they are."""
    out = F.regexp_replace(text, ARABIC_MARKS, "")
    forms, plain = ALEF_FORMS, ALEF * len(ALEF_FORMS)
    if not light:
        forms, plain = forms + ALEF_MAQSURA + TEH_MARBUTA, plain + ALEF + HEH
    out = F.translate(out, forms, plain)
    for pattern, good in spellings:
        out = F.regexp_replace(out, f"(?iu){pattern}", good)
    return F.trim(out)


def script_ratio(text: Column, script: str = ARABIC) -> Column:
    """Share of characters of the script; 0 for an empty text."""
    return F.coalesce(count_matches(text, script) / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def language_by_ratio(text: Column, *, limit: float = 0.5, script: str = ARABIC, inside: str = "ar", outside: str = "en") -> Column:
    return F.when(script_ratio(text, script) > limit, inside).otherwise(outside)


def language_by_sample(text: Column, fallback: Column, *, first: str = ARABIC, second: str = "[A-Za-z]", names: tuple[str, str] = ("ar", "en"), least: int = 40, sample: int = 5000) -> Column:
    """The script with at least ``least`` characters among the first ``sample`` that leads; the first script must lead strictly."""
    part = F.substring(text, 1, sample)
    a, b = count_matches(part, first), count_matches(part, second)
    return F.when((a >= least) & (a > b), names[0]).when((b >= least) & (b >= a), names[1]).otherwise(fallback)


def language_by_file_name(name: Column, languages: Sequence[str] = ("ar", "en")) -> Column:
    out = F.lit("unknown")
    for code in reversed(languages):
        out = F.when(name.contains(f"_{code}_") | name.contains(f"_{code}."), code).otherwise(out)
    return out


def preferred_language(text: Column, script: str = ARABIC, inside: str = "ar", outside: str = "en") -> Column:
    return F.when(text.rlike(script), inside).otherwise(outside)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def clean_page_text(text: Column, headers: Sequence[str] = (r"^Financial Accounting Standard.*$",)) -> Column:
    """Drops page-number and header lines, joins words broken by a hyphen, squeezes blank lines and spaces, opens ligatures."""
    out = F.regexp_replace(text, r"(?m)^\d+\s*$", "")
    for header in headers:
        out = F.regexp_replace(out, f"(?m){header}", "")
    out = F.regexp_replace(out, r"(?<!\w)(\w++)-(?=[^\S\n]*+\n)\s++(\w+)", "$1$2")  # a word is tried at its start only, so long ones take linear time
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), " {2,}", " ")
    out = F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.regexp_replace(out, r"^\s+|(?<!\s)\s++$", "")


SECTION_LINE = r"^(\d+\.?\d*\.?\d*)\s+([A-Z][^\n]+)$"


def section_lines(text: Column) -> Column:
    """array<struct<number, title>> of the lines that look like numbered headings."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(SECTION_LINE))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, SECTION_LINE, 1).alias("number"), F.trim(F.regexp_extract(x, SECTION_LINE, 2)).alias("title")))


def title_line(text: Column, lines: int = 10) -> Column:
    """The first of the first ``lines`` lines over 10 characters that is all upper case or in title case, else empty."""
    fits = F.filter(F.slice(F.split(text, "\n"), 1, lines), lambda x: (F.length(x) > 10) & x.rlike("[A-Za-z]") & ((F.upper(x) == x) | (F.initcap(x) == x)))
    return F.coalesce(F.trim(F.get(fits, F.lit(0))), F.lit(""))


def to_markdown(text: Column, *, shortest: int = 5, longest: int = 100) -> Column:
    """Marks numbered lines as headings by depth and upper-case lines as headings in title case; squeezes four and more newlines to two."""

    def line(x: Column) -> Column:
        x = F.trim(x)
        upper = x.rlike("[A-Z]") & (F.upper(x) == x) & (F.length(x) > shortest) & (F.length(x) < longest)
        return (
            F.when(x.rlike(r"^\d+\.\s+[A-Z]"), F.concat(F.lit("\n## "), x, F.lit("\n")))
            .when(x.rlike(r"^\d+\.\d+\s+[A-Z]"), F.concat(F.lit("\n### "), x, F.lit("\n")))
            .when(x.rlike(r"^\d+\.\d+\.\d+\s+[A-Z]"), F.concat(F.lit("\n#### "), x, F.lit("\n")))
            .when(upper, F.concat(F.lit("\n## "), F.initcap(x), F.lit("\n")))
            .otherwise(x)
        )

    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), line), "\n"), r"\n{4,}", "\n\n")


def metadata_header(title: Column, sections: Column, *, number_pattern: str = r"(?i)FAS[-\s]?(\d+)", prefix: str = "FAS-", most: int = 10) -> Column:
    """Title, number (XX if the title has none) and a table of contents of the first ``most`` sections with anchors."""
    found = F.regexp_extract(title, number_pattern, 1)
    number = F.when(found == "", F.lit("XX")).otherwise(found)
    entry = lambda s: F.concat(s["number"], F.lit(". ["), s["title"], F.lit("](#"), F.replace(F.replace(F.lower(s["title"]), F.lit(" "), F.lit("-")), F.lit("."), F.lit("")), F.lit(")"))
    contents = F.array_join(F.transform(F.slice(sections, 1, most), entry), "\n")
    return F.concat(F.lit(f"# {prefix}"), number, F.lit(": "), title, F.lit("\n\n## Table of Contents\n\n"), contents, F.lit("\n\n---\n\n"))


def safe_filename(name: Column, *, longest: int = 200) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', ""), r"\s+", "_")
    out = F.substring(F.regexp_replace(out, "_+", "_"), 1, longest)
    return F.regexp_replace(out, "^_+|_+$", "")


def output_filename(stem: Column, prefix: str) -> Column:
    """Squeezes blanks and underscores, unifies and adds the prefix, adds .md."""
    out = F.regexp_replace(F.regexp_replace(stem, r"[_\s]+", "_"), f"(?i){prefix}[_\\s]*", f"{prefix}_")
    out = F.when(out.startswith(f"{prefix}_"), out).otherwise(F.concat(F.lit(f"{prefix}_"), out))
    return F.when(out.endswith(".md"), out).otherwise(F.concat(out, F.lit(".md")))


def first_line_title(text: Column, prefixes: str = r"(?:Shari.?ah Standard|Standard No\.?)") -> Column:
    """The first line that isn't blank, without a known prefix."""
    line = F.trim(F.regexp_extract(text, r"(?m)^\s*(\S.*)$", 1))
    return F.trim(F.regexp_replace(line, f"(?i)^{prefixes}\\s*:?\\s*", ""))


def encode_url(url: Column) -> Column:
    """Percent-encodes path and query, keeping / in the one and = and & in the other."""
    keep = lambda c, safe: _restored(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), safe)
    head = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)?", 0)
    rest = F.regexp_replace(url, r"^([a-z]+://[^/?#]*)?", "")
    path, query = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return F.concat(head, keep(path, "/"), F.when(query == "", "").otherwise(F.concat(F.lit("?"), keep(query, "=&"))))


def _restored(encoded: Column, safe: str) -> Column:
    for c in safe:
        encoded = F.replace(encoded, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return encoded


def truncate(text: Column, longest: int = 200) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def stable_key(*columns: str) -> Column:
    """SHA-256 of the trimmed, lower-cased JSON of the columns in name order."""
    return F.sha2(F.lower(F.trim(F.to_json(F.struct(*sorted(columns))))), 256)


def chunk_id(file_name: Column, index: Column) -> Column:
    return F.md5(F.concat(file_name, F.lit(":"), index.cast("string")))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID: SHA-1 of namespace and name with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("long").bitwiseAND(0x3F).bitwiseOR(0x80)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def client_key(forwarded: Column, host: Column) -> Column:
    hop = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.when(hop != "", hop), F.when(host != "", host), F.lit("unknown-client"))
