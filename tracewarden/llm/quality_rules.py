"""Quality rules, native: document rules, and host verdicts from shrunken failure rates.

Everything is DataFrame functions. A document's figures come from array functions over its own
words; they are written once to the shared folder, since both the host totals and the verdicts
read them. Each rule gives every document a failure or not: too few words, repeated windows, symbols
per word, repeated lines, and words of unusual length. Failures are summed per host and rule
(partial sums before the shuffle, so a host with a third of the rows costs no more). For each rule
a beta prior is fitted to the hosts' rates by moments; every host counts once, so that a large
bad host does not make bad rates usual. A host's rate is shrunk towards the prior, (failures + a) /
(documents + a + b), and the host is rejected, with all its documents, if for some rule the
lower end of the posterior (its mean less ``CAUTION`` deviations) is above ``EXCESS`` times the
prior's mean and above ``HOST_LEAST``. Verdicts are joined back on the host; both sides are shuffled
or, where the hosts are measured to be few, broadcast, as adaptive execution decides.

Null texts have no words and fail. A null host is a host of its own; a host that is the only one
has no others to be compared with and is not rejected. Words that a window repeats are found by 64-bit
hashes of the windows. Very long texts are whole arrays of one row. Repeated rows are judged
alike; empty tables give empty results; other columns are ignored, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID, written

# fixed values: the rules
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 50, 3, 50
#: Failures that only hosts are judged by: symbols per word, share of repeated lines, and mean length of words.
MOST_SYMBOLS, MOST_DUP_LINES, SHORTEST_MEAN, LONGEST_MEAN = 0.1, 0.3, 3.0, 12.0
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")
#: When a host is rejected: deviations below the posterior's mean, times the prior's mean, and the least rate.
CAUTION, EXCESS, HOST_LEAST = 2.0, 3.0, 0.25


WHITE = " \t\n\x0b\f\r"


def _pairs(a: Column, b: Column, by: int) -> Column:
    """Hashes of each element of ``a`` with the one of ``b`` that is ``by`` places later; longer by ``by`` than it should be."""
    return F.zip_with(a, F.slice(b, F.lit(by + 1), F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, k2 (a hash of the text, which tells rows that share an id apart), host and the rules' figures of each document.

    Each select makes one array that later ones read more than once, so none is made twice.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k2"), F.col(f"`{host}`").cast("string").alias("host"), text.alias("text"))
    plain = F.col("text")
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    words = base.select(
        "doc_id",
        "k2",
        "host",
        F.array_remove(F.split("text", SPACES), "").alias("words"),
        (F.length("text") - F.length(plain)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"),
    )
    hashed = words.select(
        "doc_id",
        "k2",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("one"),
    )
    names = ["doc_id", "k2", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    n = F.greatest(F.size("one") - (WINDOW - 1), F.lit(0))
    windows = hashed.select(*names, F.slice(_pairs(_pairs(F.col("one"), F.col("one"), 1), F.col("one"), 2), F.lit(1), n).alias("windows"))
    return windows.select(*names, F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_covered()).alias("n_repeat_words"))


def _covered() -> Column:
    """Words in windows found twice: sorted by hash, windows equal to a neighbour keep their place; each place covers up to the next one."""
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h: bigint, i: int>"))
    pairs = F.zip_with(F.concat(none, placed), placed, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    return F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )


def failures(figures: DataFrame) -> DataFrame:
    """``figures`` with a boolean for each of ``RULES``, and base_failed."""
    words = F.col("n_words")
    tests = {
        "few_words": words < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * words,
        "symbols": F.col("n_symbols") > MOST_SYMBOLS * words,
        "dup_lines": F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
        "word_length": (F.col("word_chars") < SHORTEST_MEAN * words) | (F.col("word_chars") > LONGEST_MEAN * words),
    }
    return figures.withColumns(tests | {"base_failed": tests["few_words"] | tests["repeats"]})


def host_verdicts(judged: DataFrame, caution: float = CAUTION, excess: float = EXCESS, least: float = HOST_LEAST) -> DataFrame:
    """host, host_docs, host_rate (the largest of its shrunken rates), host_rule (the first that rejects it, or null) and host_rejected.

    ``judged`` has host and the booleans of ``failures``.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(rule).alias(rule) for rule in RULES))
    listed = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(rule).alias("rule"), F.col(rule).alias("failed")) for i, rule in enumerate(RULES)))
    # twice the rows of the hosts' table: once for the priors, once for the verdicts
    each = hosts.select("host", "n", F.explode(listed).alias("r")).select("host", "n", "r.*").withColumn("rate", F.col("failed") / F.col("n"))
    mean, noise = F.avg("rate"), F.avg(1 / F.col("n"))
    # what the spread of rates leaves after binomial noise; its moments give the prior's weight, kept between 1 and 1000
    spare = F.greatest(F.lit(1e-9), F.coalesce(F.var_samp("rate"), F.lit(0.0)) - mean * (1 - mean) * noise)
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), mean * (1 - mean) / spare - 1))
    prior = each.groupBy("rule").agg(mean.alias("mean"), weight.alias("weight"), F.count("*").alias("hosts"))
    total = F.col("n") + F.col("weight")
    shrunk = each.join(prior, "rule").withColumn("shrunk", (F.col("failed") + F.col("mean") * F.col("weight")) / total)
    low = F.col("shrunk") - caution * F.sqrt(F.col("shrunk") * (1 - F.col("shrunk")) / (total + 1))
    bad = (F.col("hosts") > 1) & (low > excess * F.col("mean")) & (low > least)
    by_host = shrunk.withColumn("bad", bad).groupBy("host").agg(F.max("n").alias("host_docs"), F.max("shrunk").alias("host_rate"), F.min(F.when(F.col("bad"), F.struct("place", "rule"))).alias("first"))
    return by_host.select("host", "host_docs", "host_rate", F.col("first.rule").alias("host_rule"), F.col("first").isNotNull().alias("host_rejected"))


def _judged(docs: DataFrame, host: str, **how: float) -> DataFrame:
    own = written(failures(figures(docs, host)), "figures")
    hosts = host_verdicts(own, **how)
    joined = own.join(hosts, own["host"].eqNullSafe(hosts["host"]), "left").drop(hosts["host"])
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def verdicts(docs: DataFrame, host: str = "source", **how: float) -> DataFrame:
    """Each document's figures with base_failed, kept, the largest of its host's rates, and the rule that rejects the host."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _judged(docs, host, **how).select(*names, F.round("host_rate", 6).alias("host_rate"), "host_rule")


def filtered(docs: DataFrame, host: str = "source", **how: float) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Of rows that share an id each is judged by its own text and host."""
    keys = {"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "k2": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), "k3": F.col(f"`{host}`").cast("string")}
    kept = _judged(docs, host, **how).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), "k2", F.col("host").alias("k3")).distinct()
    return docs.join(kept, (keys["k1"] == kept["k1"]) & (keys["k2"] == kept["k2"]) & keys["k3"].eqNullSafe(kept["k3"]), "left_semi")


def oracle_sql() -> str:
    """The same as DuckDB SQL."""
    return rf"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
    g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
    f AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
    b AS (SELECT *, n_words < {LEAST_WORDS} AS few_words, 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS repeats, n_symbols > {MOST_SYMBOLS}::DOUBLE * n_words AS symbols,
      n_dup_lines > {MOST_DUP_LINES}::DOUBLE * n_lines AS dup_lines, word_chars < {SHORTEST_MEAN}::DOUBLE * n_words OR word_chars > {LONGEST_MEAN}::DOUBLE * n_words AS word_length FROM f),
    h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS x FROM (UNPIVOT (SELECT source, {', '.join(RULES)} FROM b) ON {', '.join(RULES)} INTO NAME rule VALUE bad) GROUP BY 1, 2),
    m AS (SELECT rule, avg(x / n) AS p, coalesce(var_samp(x / n), 0) AS v, avg(1 / n) AS noise, count(*) AS hosts FROM h GROUP BY 1),
    k AS (SELECT rule, p, hosts, greatest(1.0::DOUBLE, least(1000.0::DOUBLE, p * (1 - p) / greatest(1e-9::DOUBLE, v - p * (1 - p) * noise) - 1)) AS c FROM m),
    s AS (SELECT source, rule, n + c AS total, (x + p * c) / (n + c) AS q, p, hosts FROM h JOIN k USING (rule)),
    l AS (SELECT source, q, rule, q - {CAUTION}::DOUBLE * sqrt(q * (1 - q) / (total + 1)) AS low, p, hosts FROM s),
    j AS (SELECT source, max(q) AS rate, arg_min(rule, list_position({list(RULES)}, rule)) FILTER (hosts > 1 AND low > {EXCESS}::DOUBLE * p AND low > {HOST_LEAST}::DOUBLE) AS host_rule FROM l GROUP BY 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed, NOT (few_words OR repeats) AND host_rule IS NULL AS kept, round(rate, 6) AS host_rate, host_rule
    FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source"""
