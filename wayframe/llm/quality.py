"""Document quality rules whose thresholds follow the data: one set per language and source.

Each metric is an integer ratio.  Its distribution is kept in a log-linear histogram (values below 64
exactly, above that 32 bins per doubling, so a quantile is right to 1 part in 32): a quantile sketch
that merges by adding counts, does not depend on the order of rows, and is an ordinary grouped count.
The quartiles of a group's sketch give its outlier fence; documents beyond a fence are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayframe.llm.common import let, packed, settle, unpacked, words

#: Base rules: fewer words than this, or a larger share (in %) of words in repeated 3-word windows, fail.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Fences are this many spreads beyond the outer quartile.
REACH = 3
#: Lines added to a document's lines before the share of repeated ones is taken: one repeat in a short text says little.
FEW_LINES = 10
#: A group's quartiles are its own sketch's, pulled towards its language's as if by so many documents of that; a language's likewise
#: towards the whole corpus's.  So each group has a threshold of its own, and one of few documents is not judged by a few alone.
PRIOR = 20
#: metric -> smallest spread; a group whose documents all agree still tolerates this much per REACH.
METRICS = {"symbol_rate": 100, "dup_line_rate": 1000, "repeat_rate": 500, "word_length": 100}
#: Metrics that are rejected on the low side too.
TWO_SIDED = ("word_length",)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(w: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the array.

    The windows' hashes are sorted with their positions, so equal ones become neighbours; then each
    marked window adds the words that the one before has not covered.  n log n for any length.
    """

    def marked(s: Column) -> Column:
        return F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(positions, start, step, lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    hits = let(F.sort_array(windows), lambda s: F.sort_array(F.transform(marked(s), lambda x: x["i"])))
    return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(covered(hits))


def base_counts(text: Column) -> Column:
    """The counts of one text as a struct; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return F.struct(
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        of_lines.alias("l"),
        of_words.alias("w"),
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts and metrics per row, with the columns of ``keep`` carried along."""
    c = docs.select(*keep, base_counts(F.col("text")).alias("_c"))
    flat = c.select(*keep, "_c.word_chars", "_c.n_symbols", "_c.l.n_lines", "_c.l.n_dup_lines", "_c.w.n_words", "_c.w.n_repeat_words")
    return flat.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words")).withColumns(
        {
            "symbol_rate": F.expr("n_symbols * 10000 div greatest(word_chars, 1)"),
            "dup_line_rate": F.expr(f"n_dup_lines * 10000 div (n_lines + {FEW_LINES})"),
            "repeat_rate": F.expr("n_repeat_words * 10000 div greatest(n_words, 1)"),
            "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
        }
    )


def bin_of(v: str, div: str = "div") -> str:
    """SQL text of a value's bin, named by the smallest value in it; ``div`` is the engine's integer division."""
    step = f"CAST(pow(2, length(bin({v})) - 6) AS BIGINT)"
    return f"CASE WHEN {v} < 64 THEN {v} ELSE ({v} {div} {step}) * {step} END"


def blend(own: str, docs: str, wider: str, div: str) -> str:
    """SQL text of a group's quartile, pulled towards the wider group's."""
    return f"(({docs} * {own} + {PRIOR} * ({wider})) {div} ({docs} + {PRIOR}))"


def fences(m: DataFrame) -> DataFrame:
    """One row per (lang, source) in the data with the bounds lo_<metric> and hi_<metric>.

    Documents without words do not count.  Levels of merging: source, language, all; each is blended with the next by PRIOR.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(bin_of(k)).alias("bin")) for k in METRICS]))
    long = m.where("n_words > 0").select("lang", "source", each.alias("x"))
    sketch = settle(long.groupBy("lang", "source", "x.metric", "x.bin").agg(F.count(F.lit(1)).alias("n")), "sketch")

    def quartiles(keys: list[str], tag: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*keys, "metric")
        part = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
        q = part.groupBy(*keys, "metric").agg(
            F.max("all").alias(f"docs_{tag}"),
            F.min(F.when(F.expr("4 * upto >= all"), F.col("bin"))).alias(f"q1_{tag}"),
            F.min(F.when(F.expr("4 * upto >= 3 * all"), F.col("bin"))).alias(f"q3_{tag}"),
        )
        return q.withColumnsRenamed({c: f"{tag}_{c}" for c in [*keys, "metric"]} if tag != "s" else {})

    j = quartiles(["lang", "source"], "s")
    j = j.join(quartiles(["lang"], "l"), (F.col("metric") == F.col("l_metric")) & F.col("lang").eqNullSafe(F.col("l_lang")))
    j = j.join(quartiles([], "a"), F.col("metric") == F.col("a_metric"))
    pick = lambda c: F.expr(blend(f"{c}_s", "docs_s", blend(f"{c}_l", "docs_l", f"{c}_a", "div"), "div"))
    floor = F.expr("CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in METRICS.items()) + " END")
    j = j.select("lang", "source", "metric", pick("q1").alias("q1"), pick("q3").alias("q3")).withColumn("reach", REACH * F.greatest(F.col("q3") - F.col("q1"), floor))
    sides = {"hi": F.col("q3") + F.col("reach"), "lo": F.col("q1") - F.col("reach")}
    return j.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, v)).alias(f"{side}_{k}") for k in METRICS for side, v in sides.items()])


def judged(m: DataFrame) -> DataFrame:
    """Measured rows with ``kept``: the base rules passed and no metric beyond its fence."""
    f = fences(m).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    j = m.join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = " AND ".join([f"{k} <= hi_{k}" for k in METRICS] + [f"{k} >= lo_{k}" for k in TWO_SIDED])
    return j.withColumn("kept", F.expr(f"NOT base_failed AND coalesce({inside}, true)"))


def quality(docs: DataFrame) -> DataFrame:
    """Verdict per row of documents (doc_id, text, lang, source).

    Null or empty text: no words, so base_failed.  Null lang or source: a group of its own.  Repeated
    rows are judged one by one alike.  An empty table gives an empty result; other columns are ignored.
    The counts are written once to the shared folder, since the sketches and the verdict both need them.
    """
    m = settle(measured(docs, ["doc_id", "lang", "source"]), "quality")
    return judged(m).select("doc_id", *COUNTS, "base_failed", "kept", *METRICS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of documents that pass, with their columns.  Rows keep their text in place: only counts travel.

    Nulls, long texts and repeated rows are judged as in quality(); columns may have any names; an empty table gives none.
    """
    keys = {"doc_id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source"), "h": F.xxhash64("doc_id", "text")}
    m = settle(measured(docs.select(*[v.alias(k) for k, v in keys.items()], "text"), list(keys)), "quality")
    # Rows that agree in all keys get the same verdict, so keys may repeat on the left only.
    good = judged(m).where("kept").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return unpacked(packed(docs, **keys).join(good, on, "left_semi"), docs.columns)


def sql(counts: str) -> str:
    """DuckDB SQL of quality(); ``counts`` gives the rows of measured() without the metrics."""

    def quartiles(name: str, keys: str) -> str:
        return f"""{name} AS (SELECT {keys} metric, max(al) AS docs, min(bin) FILTER (4 * upto >= al) AS q1, min(bin) FILTER (4 * upto >= 3 * al) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys} metric) AS al
        FROM (SELECT {keys} metric, bin, count(*) AS n FROM longm GROUP BY ALL)) GROUP BY ALL)"""

    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {bin_of(k, '//')} AS bin FROM m WHERE n_words > 0" for k in METRICS)
    floor = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in METRICS.items()) + " END"
    pick = lambda c: blend(f"g.{c}", "g.docs", blend(f"l.{c}", "l.docs", f"a.{c}", "//"), "//") + f" AS {c}"
    inside = " AND ".join([f"{k} <= hi_{k}" for k in METRICS] + [f"{k} >= lo_{k}" for k in TWO_SIDED])
    sides = ", ".join(f"max(q3 + reach) FILTER (metric = '{k}') AS hi_{k}, max(q1 - reach) FILTER (metric = '{k}') AS lo_{k}" for k in METRICS)
    return f"""WITH counts AS ({counts}),
m AS MATERIALIZED (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AS base_failed,
  n_symbols * 10000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 10000 // (n_lines + {FEW_LINES}) AS dup_line_rate,
  n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_length FROM counts),
longm AS ({long}), {quartiles("g", "lang, source,")}, {quartiles("l", "lang,")}, {quartiles("a", "")},
f AS MATERIALIZED (SELECT lang, source, {sides} FROM (SELECT *, {REACH} * greatest(q3 - q1, {floor}) AS reach
  FROM (SELECT g.lang, g.source, g.metric, {pick("q1")}, {pick("q3")}
        FROM g JOIN l ON l.metric = g.metric AND l.lang IS NOT DISTINCT FROM g.lang JOIN a ON a.metric = g.metric)) GROUP BY ALL)
SELECT m.doc_id, {", ".join(f"m.{c}" for c in COUNTS)}, base_failed, (NOT base_failed AND coalesce({inside}, true)) AS kept, {", ".join(METRICS)}
FROM m LEFT JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source"""


BASE_COUNTS_SQL = r"""SELECT d.doc_id, d.lang, d.source, d.n_words, d.word_chars, d.n_symbols, d.n_lines, d.n_dup_lines,
  coalesce((SELECT count(DISTINCT i + o) FROM (SELECT i, count(*) OVER (PARTITION BY a, b, c) AS n FROM
     (SELECT i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT unnest(range(1, d.n_words - 1)) AS i, d.w AS w))) AS q, (SELECT unnest([0, 1, 2]) AS o) WHERE q.n > 1), 0) AS n_repeat_words
FROM (SELECT doc_id, lang, source, w, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines
 FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents)) AS d"""
