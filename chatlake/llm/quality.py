"""Quality rules by document and by host.

Text rules are counted per document. Failures are added up by host; a host's failure rate is shrunk towards all hosts by a beta
prior fitted to the hosts' own rates, and hosts whose shrunk rate is too high lose all their documents.

Null text counts as empty: no words, so it fails. A null host is a host of its own. Repeated rows are judged one by one. An empty
table gives an empty result. Other columns of the input are kept by ``filtered`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.binding import let
from chatlake.llm.common import SPACES, WORD, computed, read, words
from chatlake.llm.registry import query
from chatlake.session import materialise

MIN_WORDS = 20
#: Percent of words in repeated windows beyond which a document fails.
MAX_REPEAT = 30
WINDOW = 8
#: Shrunk failure rate beyond which a host is blocked.
MAX_HOST_RATE = 0.5
BROADCAST_HOSTS = 200_000
#: Parts into which the rows of a host are dealt beyond that.
PARTS = 16


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window whose hash occurs twice or more; ``hashes`` must be a column, as it is used for every window."""
    def covered(grams: Column) -> Column:
        def by_place(pairs: Column) -> Column:
            twins = F.filter(pairs, lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]).eqNullSafe(True)
                             | (F.get(pairs, i + 1)["h"] == x["h"]).eqNullSafe(True))
            def total(places: Column) -> Column:
                gaps = F.zip_with(F.slice(places, 2, F.size(places)), places,
                                  lambda after, at: F.least(F.coalesce(after, at + window) - at, F.lit(window)))
                return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
            return let(F.array_sort(F.transform(twins, lambda x: x["i"])), total)
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), by_place))

    starts = F.sequence(F.lit(0), F.size(hashes) - window)
    return F.when(F.size(hashes) < window, F.lit(0).cast("long")).otherwise(
        let(F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])), covered))


def measured(docs: DataFrame) -> DataFrame:
    """The rows with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    spaceless = F.length(F.regexp_replace(text, SPACES, "")).cast("long")
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")
    raw = computed(docs, _hashes=F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), word_chars=spaceless, n_symbols=symbols,
                   _lines=lines)
    counts = computed(raw, n_words=F.size("_hashes").cast("long"), n_repeat_words=repeated_words(F.col("_hashes")),
                      n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_hashes", "_lines")
    return counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                             | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def host_verdicts(rows: DataFrame, host: str = "source", failed: str = "base_failed",
                  limit: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate, and whether the host is blocked.

    The beta prior is fitted to the hosts by moments. With m the mean rate of the hosts and v their variance, it weighs
    m (1 - m) / v - 1 documents; where that is not above zero, or all rates are equal, it weighs one document.
    """
    hosts = rows.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).select(
        "m", F.when(F.col("v") > 1e-12, F.greatest(F.col("m") * (1 - F.col("m")) / F.when(F.col("v") > 1e-12, F.col("v")) - 1,
                                                   F.lit(1.0))).otherwise(1.0).alias("w"))
    joined = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(prior.withColumn("_one", F.lit(1))), "_one")
    shrunk = (F.col("n_failed") + F.col("m") * F.col("w")) / (F.col("n_docs") + F.col("w"))
    return joined.select("host", "n_docs", "n_failed", shrunk.alias("host_rate")).withColumn("blocked", F.col("host_rate") > limit)


def joined_verdicts(rows: DataFrame, hosts: DataFrame, host: str, bound: int = BROADCAST_HOSTS) -> DataFrame:
    """``rows`` with ``kept``. Only blocked hosts are sent to the rows: up to ``bound`` by broadcast; beyond, both sides are dealt out
    by host and part of the rows, so that a large host is not one task's."""
    hosts = materialise(hosts.filter("blocked"), "hosts")
    side = hosts.select(F.coalesce("host", F.lit("")).alias("_host"), F.col("host").isNull().alias("_no_host"), "blocked")
    keyed = rows.withColumns({"_host": F.coalesce(F.col(host), F.lit("")), "_no_host": F.col(host).isNull()})
    if hosts.limit(bound + 1).count() <= bound:
        out = keyed.join(F.broadcast(side), ["_host", "_no_host"], "left")
    else:
        parts = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        dealt = keyed.withColumn("_part", (F.rand(7) * PARTS).cast("int"))
        out = dealt.join(parts, ["_host", "_no_host", "_part"], "left").drop("_part")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("blocked", F.lit(False))).drop("_host", "_no_host", "blocked")


def judged(docs: DataFrame, host: str = "source", limit: float = MAX_HOST_RATE) -> DataFrame:
    """``doc_id``, the host, the counts, ``base_failed`` and ``kept`` of every row. Each text is read once: the counts are
    written to the shared folder before hosts are added up."""
    rows = materialise(measured(docs.select("doc_id", host, "text")).drop("text"), "quality")
    return joined_verdicts(rows, host_verdicts(rows, host, limit=limit), host)


def filtered(docs: DataFrame, host: str = "source", limit: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that are kept, with the columns they came with. Each text is counted once: documents that pass their own
    rules are written beside the hosts of all before hosts are added up, which moves no text between tasks."""
    rows = measured(docs.select(F.struct("*").alias("_doc"), F.col(host), F.col("text")))
    passed = F.when(~F.col("base_failed"), F.col("_doc"))
    rows = materialise(rows.select(host, "base_failed", passed.alias("_doc")), "quality-rows")
    return joined_verdicts(rows, host_verdicts(rows, host, limit=limit), host).filter("kept").select("_doc.*")


@query(r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM spots),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS c FROM twice),
rep AS (SELECT doc_id, sum(c)::BIGINT AS n FROM gaps GROUP BY doc_id),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
flag AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM flag GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
verdict AS (SELECT source, (f + m * k) / (n + k) > 0.5 AS blocked FROM hosts,
  (SELECT m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 1) ELSE 1 END AS k FROM prior))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT blocked AS kept
FROM flag JOIN verdict ON flag.source IS NOT DISTINCT FROM verdict.source
""")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(read(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
