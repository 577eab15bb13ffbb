"""Host-level quality rules: failures by domain, shrunk rates, verdicts back on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, written

WHITE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: empty)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly x20 and x09-x0D
    chars = len(text or "") - sum(map(data.count, (WHITE[i : i + 1] for i in range(6))))
    symbols = sum(map(data.count, (SYMBOLS[i : i + 1] for i in range(8))))
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated, counts = 0, set(windows)
    if len(counts) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        last = -1
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 2 - max(last, i - 1)
                last = i + 2
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _measured(texts: list[str | None]) -> dict[str, list]:
    rows = [measure(t) for t in texts]
    return {m.split()[0]: [r[i] for r in rows] for i, m in enumerate(MEASURES.split(", "))}


def measure_documents(docs: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    """Key, host and the five measures of every whole text."""
    return appended(docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), "text"), "text", _measured, MEASURES)


def host_verdicts(docs: DataFrame, *, max_rate: float | None = None) -> DataFrame:
    """Per host: documents, failures, the failure rate shrunk to the mean of all hosts, and whether it passes.

    ``docs`` has _host and _failed. The beta prior comes from the hosts' own rates by moments: mean m and variance v (over
    what binomial noise explains) give a strength m(1-m)/v - 1, so that hosts with few documents lean on the prior
    and large ones on their own rate. Null hosts form a host of their own. A host passes up to ``max_rate``, by default the rate of all documents, with 1e-9 for rounding.
    """
    hosts = docs.groupBy("_host").agg(F.count("*").alias("host_docs"), F.sum(F.col("_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("_mean"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("_var"), F.avg(1 / F.col("host_docs")).alias("_noise")
    )
    spread = F.greatest(F.col("_var") - F.col("_mean") * (1 - F.col("_mean")) * F.col("_noise"), F.lit(1e-6))
    strength = F.least(F.greatest(F.col("_mean") * (1 - F.col("_mean")) / spread - 1, F.lit(1.0)), F.lit(1000.0))
    prior = prior.select("_mean", strength.alias("_strength"))
    shrunk = (F.col("host_failed") + F.col("_strength") * F.col("_mean")) / (F.col("host_docs") + F.col("_strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("_host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= (F.col("_mean") if max_rate is None else F.lit(max_rate)) + 1e-9).alias("host_passes"))


def apply_host_rules(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_symbols_percent: int = 10,
    max_dup_lines: int = 3,
    max_rate: float | None = None,
) -> DataFrame:
    """Measures, base rule, host verdict and ``kept`` for every document.

    A document fails its own rules if it is short or repeats itself (the base rule), has over ``max_symbols_percent``
    symbols per 100 word characters, or more than ``max_dup_lines`` repeated lines. Failures are counted by host and
    the rates shrunk (``host_verdicts``). A base failure is never kept. Where the host passes, every other document is kept; where it
    fails (its rate is over ``max_rate``, by default that of all documents), only those that pass all rules themselves: a doubtful document is dropped with a bad host and kept with a good one, a clean one never lost.

    The prior is one row, so its broadcast is bounded; the host table is joined as Spark's measured sizes allow. Null text: no
    words, hence a base failure. Null or repeated keys and other columns change nothing. No rows: no rows.
    """
    m = written(measure_documents(docs, key, host), "measures")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > max_symbols_percent * F.col("word_chars")) | (F.col("n_dup_lines") > max_dup_lines)
    m = m.withColumns({"base_failed": base, "_failed": base | soft})
    verdicts = host_verdicts(m, max_rate=max_rate).withColumnRenamed("_host", "_judged")
    return m.join(verdicts, F.col("_host").eqNullSafe(F.col("_judged")), "left").select(
        F.col("_key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("host_passes") | ~F.col("_failed"))).alias("kept"),
        F.round("host_rate", 9).alias("host_rate"),
    )
