"""Quality rules judged per document and per host.

Every document is tested against simple rules.  Failures are summed per host
(``source``), each host's failure rate is shrunk towards all hosts' by an
empirical beta prior, and hosts whose shrunk rate exceeds the prior's mean by
more than HOST_MARGIN, or HOST_LIMIT, lose all their documents.  A host with few
documents stays near the common rate, so it isn't rejected on little evidence;
where hosts differ no more than chance makes them, none is rejected.

Signals are found in one pass over whole texts and stored; the sum per host is
partial before its shuffle, so a hot host sends one row per task, and the join
back carries no text.  Up to BROADCAST_HOSTS hosts are broadcast; beyond, both
sides are salted, so a host's documents are dealt over SALTS tasks.

Defined results: a null text has no words and fails for shortness.  A null
source is no host: such documents are judged by the document rules alone.
Repeated rows count as documents.  Extra columns are ignored.  Texts may be of any
length: windows are counted as numbers, some 100 bytes a word.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import dropped, stored, text_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Shortest document in words, and the largest share of words in repeated three-word windows, in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected for a rule when its shrunk failure rate is above that of all hosts by more than the margin, or above the limit.
HOST_MARGIN, HOST_LIMIT = 0.2, 0.5
#: Hosts (under 100 bytes each) that are broadcast at most, and tasks that a host's documents are dealt to beyond that.
BROADCAST_HOSTS, SALTS = 200_000, 16
#: Host-level rules, as SQL conditions on the counts.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "5 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
}


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    duplicates = lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        numbers: dict[str, int] = {}
        code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        pairs = np.unique(code[:-2] * len(numbers) + code[1:-1], return_inverse=True)[1]
        _, window, times = np.unique(pairs * len(numbers) + code[2:], return_inverse=True, return_counts=True)
        if len(times) < len(window):
            often, covered = times[window] > 1, np.zeros(len(words), bool)
            for k in range(3):
                covered[k : len(words) - 2 + k] |= often
            repeated = int(covered.sum())
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicates, repeated, lines


def signals(docs: DataFrame) -> DataFrame:
    """(doc_id, source, COUNTS) of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(x.as_py()) for x in batch.column(2)]
            columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "source", *COUNTS])

    return docs.select("doc_id", "source", "text").mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def host_verdicts(measured: DataFrame, margin: float = HOST_MARGIN, limit: float = HOST_LIMIT) -> DataFrame:
    """(source, host_docs, rate_<rule>, host_ok): shrunk failure rates of every host.

    For each rule, hosts' rates are taken as draws from a beta distribution
    whose mean m is the overall rate and whose variance is what the hosts'
    spread exceeds binomial noise by (method of moments).  With strength
    k = m(1-m)/variance - 1, the shrunk rate is (failures + m k) / (docs + k).
    """
    fails = {r: F.sum(F.expr(f"int({sql})")).cast("double").alias(f"f_{r}") for r, sql in RULES.items()}
    hosts = measured.where("source is not null").groupBy("source").agg(F.count("*").cast("double").alias("host_docs"), *fails.values())
    whole = hosts.agg(F.sum("host_docs").alias("all_docs"), F.count("*").cast("double").alias("n_hosts"), *(F.sum(f"f_{r}").alias(f"all_{r}") for r in RULES), *(F.sum(F.expr(f"f_{r} * f_{r} / host_docs")).alias(f"sq_{r}") for r in RULES))
    prior = whole.select("*", *(F.expr(f"all_{r} / all_docs").alias(f"m_{r}") for r in RULES))
    prior = prior.select(*(f"m_{r}" for r in RULES), *(F.expr(f"greatest((sq_{r} - all_docs * m_{r} * m_{r} - (n_hosts - 1) * m_{r} * (1 - m_{r})) / all_docs, 1e-6)").alias(f"v_{r}") for r in RULES))
    prior = prior.select(*(f"m_{r}" for r in RULES), *(F.expr(f"greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0)").alias(f"k_{r}") for r in RULES))
    joined = hosts.crossJoin(F.broadcast(prior))  # prior is one row
    rates = joined.select("source", "host_docs", *(f"m_{r}" for r in RULES), *(F.expr(f"(f_{r} + m_{r} * k_{r}) / (host_docs + k_{r})").alias(f"rate_{r}") for r in RULES))
    sound = [F.col(f"rate_{r}") <= F.least(F.col(f"m_{r}") + margin, F.lit(limit)) for r in RULES]
    return rates.withColumn("host_ok", functools.reduce(lambda x, y: x & y, sound)).drop(*(f"m_{r}" for r in RULES))


def with_hosts(measured: DataFrame, hosts: DataFrame, most: int = BROADCAST_HOSTS) -> DataFrame:
    """Documents with their host's verdict; null without a host."""
    if hosts.count() <= most:
        return measured.join(F.broadcast(hosts), "source", "left")
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["source", "salt"], "left").drop("salt")


def judged(docs: DataFrame, margin: float = HOST_MARGIN, limit: float = HOST_LIMIT) -> DataFrame:
    """Signals, base_failed, host_ok and kept of every document."""
    with text_batches(docs.sparkSession):
        measured = stored(signals(docs), "quality_signals")
    hosts = stored(host_verdicts(measured, margin, limit).select("source", "host_ok"), "quality_hosts")
    failed = F.expr(f"{RULES['short']} or {RULES['repeats']}")
    told = with_hosts(measured, hosts).select(*measured.columns, failed.alias("base_failed"), F.coalesce("host_ok", F.lit(True)).alias("host_ok"))
    result = stored(told.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")), "quality_judged")
    dropped(measured, hosts)
    return result


#: DuckDB SQL for ``judged`` over ``documents``.
SQL = f"""
with base as (
  select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (
  select doc_id, i, {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}} as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from base)),
often as (select *, count(*) over (partition by doc_id, g) as n from windows),
covered as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from often where n > 1) group by doc_id),
lines as (select doc_id, l, count(*) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from base) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id, l),
line_counts as (select doc_id, sum(n - 1) as n_dup_lines, sum(n) as n_lines from lines group by doc_id),
measured as (
  select doc_id, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
  from base left join covered using (doc_id) left join line_counts using (doc_id)),
hosts as (select source, count(*)::double as host_docs, {', '.join(f'sum(({sql})::int)::double as f_{r}' for r, sql in RULES.items())} from measured where source is not null group by source),
whole as (select sum(host_docs) as all_docs, count(*)::double as n_hosts, {', '.join(f'sum(f_{r}) as all_{r}, sum(f_{r} * f_{r} / host_docs) as sq_{r}' for r in RULES)} from hosts),
prior as (select {', '.join(f'all_{r} / all_docs as m_{r}, greatest((sq_{r} - all_{r} * all_{r} / all_docs - (n_hosts - 1) * all_{r} / all_docs * (1 - all_{r} / all_docs)) / all_docs, 1e-6) as v_{r}' for r in RULES)} from whole),
strength as (select *, {', '.join(f'greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0) as k_{r}' for r in RULES)} from prior),
verdicts as (select source, {' and '.join(f'(f_{r} + m_{r} * k_{r}) / (host_docs + k_{r}) <= least(m_{r} + {HOST_MARGIN}, {HOST_LIMIT})' for r in RULES)} as host_ok from hosts, strength)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES['short']} or {RULES['repeats']}) as base_failed,
  not ({RULES['short']} or {RULES['repeats']}) and coalesce(host_ok, true) as kept
from measured left join verdicts using (source)
"""
