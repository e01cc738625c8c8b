"""Quality rules with host-level verdicts (built-in column functions only).

Each document is held against simple rules. Failures are counted by host, and the
rates of hosts are shrunk towards the corpus by an empirical beta prior (fitted by
moments over all hosts): a host of two bad pages is not judged like one of two million.
Host verdicts come back to documents in two ways:

* a host's limit for symbols in a text is stricter the more often its documents fail
  by symbols, and laxer the less often (by at most half and double);
* a host whose posterior rate of some rule is surely above ``HOST_LIMIT`` (by two
  standard deviations) loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.staging import staged
from pixelweave.llm.text import SPACES, let, words

#: Symbols that mark junk when they crowd a text.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols to a hundred word characters that a document of an ordinary host may have, and the ends of what a host's verdict makes of it.
SYMBOL_PERCENT, LEAST_SYMBOL_PERCENT, MOST_SYMBOL_PERCENT = 10.0, 5.0, 20.0
#: A host is dropped when its rate of failing some rule is above this, but for two standard deviations.
HOST_LIMIT, SURE = 0.5, 2.0


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by a 64-bit hash, so equal ones are neighbours; the union
    of the marked windows is then a running sum over their starts.
    """
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.array_sort(
        F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    )
    marked = let(
        windows,
        lambda s: F.filter(
            F.transform(
                s,
                lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]),
            ),
            lambda i: i.isNotNull(),
        ),
    )
    return F.aggregate(
        F.array_sort(marked),
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total"), i.alias("last")),
        lambda acc: acc["total"],
    )


def _lines(text: Column) -> Column:
    """Struct of the number of lines with a word, and of those equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def text_metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long) and base_failed."""
    text = F.coalesce(text, F.lit(""))
    counts = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    return let(
        F.struct(counts.alias("w"), _lines(text).alias("l")),
        lambda c: F.struct(
            c["w"]["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            c["l"]["n"].alias("n_lines"),
            c["l"]["dup"].alias("n_dup_lines"),
            c["w"]["n_repeat_words"].alias("n_repeat_words"),
            ((c["w"]["n_words"] < MIN_WORDS) | (100 * c["w"]["n_repeat_words"] > MAX_REPEAT_PERCENT * c["w"]["n_words"])).alias("base_failed"),
        ),
    )


def rule_failures(m: Column) -> dict[str, Column]:
    """The rules whose failures are counted by host, over a struct of ``text_metrics``."""
    return {
        "short": m["n_words"] < MIN_WORDS,
        "repeats": 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"],
        "symbols": 100 * m["n_symbols"] > SYMBOL_PERCENT * m["word_chars"],
        "lines": 2 * m["n_dup_lines"] > m["n_lines"],
    }


def host_verdicts(checked: DataFrame, host: str, metrics: str, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_docs, host_rate, symbol_percent, host_ok) from rows with a ``text_metrics`` struct.

    host_rate is the largest shrunk rate over the rules. The prior of a rule has
    the mean and variance of the hosts' raw rates; without variance (one host, or
    all alike) it weighs as much as one document. symbol_percent is the host's own
    limit: the ordinary one times the prior's mean over the host's shrunk rate.
    """
    rules = rule_failures(F.col(metrics))
    hosts = checked.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), *(F.sum(x.cast("long")).alias(f"k_{r}") for r, x in rules.items())
    )
    hosts = staged(hosts, "hosts")
    rate = {r: F.col(f"k_{r}") / F.col("host_docs") for r in rules}
    moments = hosts.agg(*(x for r in rules for x in (F.avg(rate[r]).alias(f"m_{r}"), F.var_pop(rate[r]).alias(f"v_{r}")))).first()
    shrunk, low = {}, []
    for r in rules:
        mean, var = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        weight = min(1e9, max(1.0, mean * (1 - mean) / var - 1)) if var > 1e-12 else 1.0
        p = (F.col(f"k_{r}") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
        shrunk[r] = p
        low.append(p - F.lit(SURE) * F.sqrt(p * (1 - p) / (F.col("host_docs") + F.lit(weight + 1))))
    mean = moments["m_symbols"] or 0.0
    own = F.when(shrunk["symbols"] > 0, SYMBOL_PERCENT * mean / shrunk["symbols"]).otherwise(SYMBOL_PERCENT)
    percent = F.least(F.lit(MOST_SYMBOL_PERCENT), F.greatest(F.lit(LEAST_SYMBOL_PERCENT), own))
    return hosts.select("host", "host_docs", F.greatest(*shrunk.values()).alias("host_rate"), percent.alias("symbol_percent"), (F.greatest(*low) <= limit).alias("host_ok"))


def _passes(m: Column) -> Column:
    """The verdict on a document with its host's columns."""
    return ~m["base_failed"] & F.col("host_ok") & (100 * m["n_symbols"] <= F.col("symbol_percent") * m["word_chars"])


def quality_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Per document: doc_id, host, the metrics, base_failed, host_docs, host_rate, symbol_percent, host_ok, kept.

    Null text is empty and so fails (no words). A null host is the host ''.
    Repeated rows are judged one by one. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    checked = staged(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), text_metrics(F.col(text)).alias("m")),
        "metrics",
    )
    verdicts = host_verdicts(checked, "host", "m", limit)
    return checked.join(verdicts, "host").select("doc_id", "host", "m.*", "host_docs", "host_rate", "symbol_percent", "host_ok", _passes(F.col("m")).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they were.

    Texts are measured once. Rows that no host's verdict could save are counted
    for their host and not carried further. Nulls, empty tables and repeated rows
    as in ``quality_table``; columns may have any names.
    """
    m = text_metrics(F.col(text))
    measured = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(host), F.lit("")).alias("host"), m.alias("m"))
    hopeless = F.col("m.base_failed") | (100 * F.col("m.n_symbols") > MOST_SYMBOL_PERCENT * F.col("m.word_chars"))
    checked = staged(measured.select(F.when(~hopeless, F.col("row")).alias("row"), "host", "m"), "metrics")
    verdicts = host_verdicts(checked, "host", "m", limit)
    return checked.where("row IS NOT NULL").join(verdicts, "host").where(_passes(F.col("m"))).select("row.*")


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_table(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", F.round("host_rate", 6).alias("host_rate"), F.round("symbol_percent", 6).alias("symbol_percent")
    )


_SPACE = r"[\x20\x09-\x0D]+"
_METRICS_SQL = rf"""
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM {{docs}}),
w AS (SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
lines AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
m AS (SELECT w.rid, doc_id, host, len(w) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dl.lines, 0) AS n_lines, coalesce(dl.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN dl USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m),
r AS (SELECT host, rule, count(*) AS n, sum(bad::BIGINT) AS k FROM (
        SELECT host, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule,
               unnest([n_words < {MIN_WORDS}, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words, 100 * n_symbols > {SYMBOL_PERCENT} * word_chars, 2 * n_dup_lines > n_lines]) AS bad
        FROM f) GROUP BY host, rule),
p AS (SELECT rule, avg(k / n) AS mean, var_pop(k / n) AS var FROM r GROUP BY rule),
q AS (SELECT rule, mean, CASE WHEN var > 1e-12 THEN least(1e9, greatest(1.0, mean * (1 - mean) / var - 1)) ELSE 1.0 END AS weight FROM p),
s AS (SELECT host, rule, n, mean, (k + mean * weight) / (n + weight) AS rate, n + weight + 1 AS size FROM r JOIN q USING (rule)),
h AS (SELECT host, max(n) AS host_docs, max(rate) AS host_rate, max(rate - {SURE} * sqrt(rate * (1 - rate) / size)) <= {HOST_LIMIT} AS host_ok,
             least({MOST_SYMBOL_PERCENT}, greatest({LEAST_SYMBOL_PERCENT}, max(CASE WHEN rule <> 'symbols' THEN NULL WHEN rate > 0 THEN {SYMBOL_PERCENT} * mean / rate ELSE {SYMBOL_PERCENT} END))) AS symbol_percent
      FROM s GROUP BY host)
"""


def metrics_sql(docs: str) -> str:
    """The WITH list of the SQL form, over the relation ``docs``."""
    return _METRICS_SQL.replace("{docs}", docs)


QUERIES = {"op4_host_quality": op4_host_quality}
SQL = {
    "op4_host_quality": f"""WITH {metrics_sql("documents")}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND host_ok AND 100 * n_symbols <= symbol_percent * word_chars) AS kept, host_docs, round(host_rate, 6) AS host_rate,
       round(symbol_percent, 6) AS symbol_percent
FROM f JOIN h USING (host)"""
}
