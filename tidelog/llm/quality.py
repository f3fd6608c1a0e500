"""Quality rules by host: rule failures are counted for each host, rates shrink to an empirical beta prior, and verdicts join back to documents.

DataFrame functions only. One pass over the texts makes five numbers a document; these are written once, so that counting hosts and joining verdicts
read no text again. A document fails a rule by its base, by more than one symbol in ten words, or by repeated lines beyond a third of its lines.
The prior Beta(a, b) has the mean and, where hosts differ by more than chance, the variance of the hosts' failure rates (method of moments).
A host is bad if its shrunken rate (failures + a) / (documents + a + b) exceeds MAX_RATE. Hot hosts are summed before the shuffle; verdicts are broadcast
where they are few bytes; otherwise those of hot hosts are, and all others are joined by a shuffle.

Results: null text has no words, so its base fails. A null host is a host of its own. Repeated rows count as often as they come. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import saved, spread_join

MIN_WORDS = 50
MAX_RATE = 0.5
GRAM = 3
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside windows of GRAM words that are found at least twice."""

    def of(h: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            def twin(p: Column, i: Column) -> Column:
                near = lambda j: F.coalesce(F.get(s, j)["h"] == p["h"], F.lit(False))
                return F.when(near(i - 1) | near(i + 1), p["at"])

            places = F.sort_array(F.filter(F.transform(s, twin), lambda x: x.isNotNull()))
            return let(places, lambda d: F.aggregate(F.transform(d, lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get(d, i + 1) - p, F.lit(GRAM)))), F.lit(0), lambda a, x: a + x))

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), from_sorted))

    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (GRAM - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, GRAM))))
    return let(windows, of)


def base(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    parts = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("t")).select(
        "id",
        "host",
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.size(x).alias("n"))).alias("line"),
        let(F.regexp_extract_all("t", F.lit(WORD), 0), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeat"))).alias("word"),
    )
    long = lambda c, name: F.col(c).cast("long").alias(name)
    out = parts.select("id", "host", long("word.n", "n_words"), long("word.chars", "word_chars"), long("n_symbols", "n_symbols"), long("line.dup", "n_dup_lines"), long("word.repeat", "n_repeat_words"), long("line.n", "n_lines"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(counted: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host, n, failures, rate (shrunken) and bad, from rows with host and failed."""
    hosts = counted.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    raw = F.col("failures") / F.col("n")
    sums = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("k"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * raw * raw).alias("square"))
    mean = F.col("k") / F.col("n")
    # spread between hosts beyond what hosts of their size differ by chance
    spread = F.col("square") / F.col("n") - mean * mean - mean * (1 - mean) * F.col("hosts") / F.col("n")
    least = F.greatest(spread, mean * (1 - mean) / 1000, F.lit(1e-9))
    weight = F.greatest(mean * (1 - mean) / least - 1, F.lit(1e-3))
    prior = sums.select((mean * weight).alias("a"), ((1 - mean) * weight).alias("b")).first()
    a, b = (prior["a"] or 0.0, prior["b"] or 0.0) if prior else (0.0, 0.0)
    rate = (F.col("failures") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("rate", rate).withColumn("bad", F.col("rate") > max_rate)


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """For each document: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    facts = saved(base(docs, id_col, text_col, host_col), "quality")
    failed = F.col("base_failed") | (10 * F.col("n_symbols") > F.col("n_words")) | (3 * F.col("n_dup_lines") > F.col("n_lines"))
    key = [F.col("host").isNull().alias("no_host"), F.coalesce("host", F.lit("")).alias("host")]
    hosts = saved(host_verdicts(facts.select("host", failed.alias("failed")), max_rate).select(*key, "bad", "n"), "hosts")
    joined = spread_join(facts.select(*key, *(c for c in facts.columns if c != "host")), hosts, ["no_host", "host"], "n", "inner")
    kept = ~F.col("base_failed") & ~F.col("bad")
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


ORACLE_SQL = r"""
with w as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
line as (select r, len(x) as n_lines, len(x) - len(list_distinct(x)) as n_dup_lines
  from (select r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as x from w)),
gram as (select r, i, (words[i], words[i + 1], words[i + 2]) as g from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from gram) where c > 1),
hit as (select r, count(distinct i + j) as n from twice, (values (0), (1), (2)) as o(j) group by r),
facts as (select w.r, doc_id, source, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, n_dup_lines, n_lines, coalesce(hit.n, 0) as n_repeat_words
  from w join line using (r) left join hit using (r)),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from facts),
host as (select source, count(*) as n, sum((base_failed or 10 * n_symbols > n_words or 3 * n_dup_lines > n_lines)::int) as k from base group by source),
total as (select sum(n) as n, sum(k)::double / sum(n) as m, count(*) as hosts, sum(n * (k / n) * (k / n)) / sum(n) as square from host),
prior as (select m, greatest(m * (1 - m) / greatest(square - m * m - m * (1 - m) * hosts / n, m * (1 - m) / 1000, 1e-9) - 1, 1e-3) as s from total),
verdict as (select source, (k + m * s) / (n + s) > 0.5 as bad from host, prior)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not bad as kept
from base left join verdict on base.source is not distinct from verdict.source
"""
