"""Quality rules whose thresholds follow the data: quantile sketches per language and source, each with a fixed share of coarser ones.

The statistics are array expressions on each row. The sketch of a group is a count per bin of an integer statistic: bins are exact below 128
and have 64 steps per power of two above (relative error under 1/64). Sketches merge by adding counts, in any order and with the same result
after a retry. To the sketch of a group that of its language and that of all documents are added, each weighing ``PRIOR`` documents, so a small group leans
on them and a large one on itself, without a step at any size. DataFrame functions only.

Null text: no words, so the base rule rejects it. Null language or source: a group of its own. Repeated rows: each is judged. No documents: no rows. Extra columns
are passed on; the columns added here replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: Weight, in documents, of the sketch of the language and of that of all documents in the sketch of each group.
PRIOR = 100
#: Distance from the quartiles in interquartile ranges, and the least distance from the median (per thousand words or lines; thousandths of a character).
#: Repeats: 99 of 100 documents that pass the base rule stay within 150 (sf0.01), half of what that rule leaves (300). Lines: 99 of 100 within 200; one double in four lines is 250.
RANGES = 3
RULES = {"symbols": (100, False), "dup_lines": (250, False), "repeats": (150, False), "mean_length": (2000, True)}
_EXACT = "decimal(38, 0)"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: Column) -> Column:
    """Words covered by windows of eight words that occur twice or more. Linear but for one sort, and that only in texts with a repeat."""
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(_covered(keys)).cast("long")


def _covered(keys: Column) -> Column:
    def count(k: Column) -> Column:
        ranked = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return _bind(ranked, lambda r: _bind(_at_repeats(r), _union_length))

    return _bind(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(count(k)))


def _at_repeats(ranked: Column) -> Column:
    n = F.size(ranked)
    same = lambda x, j: F.when((j >= 0) & (j < n), F.get(ranked, j)["k"] == x["k"]).otherwise(False)
    return F.sort_array(F.transform(F.filter(ranked, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))


def _union_length(at: Column) -> Column:
    """Length of the union of [p, p + WINDOW) over sorted positions."""
    gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def statistics(text: Column) -> Column:
    """One struct of integer statistics for a text."""
    full = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(full, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _bind(
        F.struct(full.alias("t"), words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            (F.length(x["t"]) - F.regexp_count(x["t"], F.lit(SPACE))).cast("long").alias("word_chars"),
            F.regexp_count(x["t"], F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            repeat_words(x["w"]).alias("n_repeat_words"),
            F.size(x["l"]).cast("long").alias("n_lines"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _scores() -> list[Column]:
    per = lambda x, n: F.expr(f"coalesce({x} * 1000 div nullif({n}, 0), 0L)")
    return [
        per("n_symbols", "n_words").alias("symbols"), per("n_dup_lines", "n_lines").alias("dup_lines"),
        per("n_repeat_words", "n_words").alias("repeats"), per("word_chars", "n_words").alias("mean_length"),
    ]


def sketch_bin(value: Column) -> Column:
    """Lower end of the bin of a non-negative integer."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    unit = F.pow(F.lit(2), shift).cast("long")
    return (value - value % unit).cast("long")


def sketches(scored: DataFrame) -> DataFrame:
    """Rows (lang, source, rule, bin, n): the mergeable sketch of each group and score."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), sketch_bin(F.col(r)).alias("bin")) for r in RULES]))
    return (scored.where(~F.col("base_failed")).select("lang", "source", pairs.alias("x"))
            .groupBy("lang", "source", "x.rule", "x.bin").agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches added up to coarser groups."""
    return sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))


def _folded(sketch: DataFrame, name: str, *keys: str) -> DataFrame:
    """Bins of each group in one row; there are at most some thousand, whatever the size of the group."""
    return sketch.groupBy(*keys, "rule").agg(F.collect_list(F.struct("bin", "n")).alias(f"{name}_bins"), F.sum("n").cast(_EXACT).alias(f"{name}_n"))


def _quantile(bins: Column, total: Column, quarter: int) -> Column:
    """Lowest bin up to which a number of quarters of the weight lies."""
    zero = F.struct(F.lit(0).cast(_EXACT).alias("seen"), F.lit(None).cast("long").alias("at"))

    def step(a: Column, x: Column) -> Column:
        seen = a["seen"] + x["w"]
        return F.struct(seen.alias("seen"), F.coalesce(a["at"], F.when(4 * seen >= quarter * total, x["bin"])).alias("at"))

    return F.aggregate(bins, zero, step)["at"]


def quartiles(fine: DataFrame) -> DataFrame:
    """Per language, source and rule: quartiles of its sketch with those of the language and of all documents. Weights are whole numbers: shares are brought to one denominator."""
    lang = _folded(merged(fine, "lang"), "l", "lang").withColumnsRenamed({"lang": "l_lang", "rule": "l_rule"})
    whole = _folded(merged(fine), "a").withColumnRenamed("rule", "a_rule")
    rows = _folded(fine, "g", "lang", "source").join(lang, F.expr("lang <=> l_lang AND rule = l_rule")).join(whole, F.expr("rule = a_rule"))

    def weighed(bins: str, factor: Column) -> Column:
        return F.transform(bins, lambda x: F.struct(x["bin"].alias("bin"), (x["n"] * factor).alias("w")))

    g_n, l_n, a_n = (F.col(f"{x}_n") for x in "gla")
    shares = F.concat(weighed("g_bins", l_n * a_n), weighed("l_bins", PRIOR * a_n), weighed("a_bins", PRIOR * l_n))
    rows = rows.withColumn("bins", F.sort_array(shares)).withColumn("total", (g_n + 2 * PRIOR) * l_n * a_n)
    return rows.select("lang", "source", "rule", *[_quantile(F.col("bins"), F.col("total"), k).alias(f"q{k}") for k in (1, 2, 3)])


def thresholds(scored: DataFrame) -> DataFrame:
    """Per language and source: lowest and highest score of each rule that is kept. Stored once, so that all later reads agree."""
    picked = quartiles(stored(sketches(scored), "sketch"))
    spread = RANGES * (F.col("q3") - F.col("q1"))
    margin = F.create_map(*[F.lit(x) for r, (m, _) in RULES.items() for x in (r, m)])[F.col("rule")]
    limits = picked.select("lang", "source", "rule", F.least(F.col("q1") - spread, F.col("q2") - margin).alias("low"), F.greatest(F.col("q3") + spread, F.col("q2") + margin).alias("high"))
    one = lambda r, c: F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{c}_{r}")
    return stored(limits.groupBy("lang", "source").agg(*[one(r, c) for r in RULES for c in ("low", "high")]), "thresholds")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, statistics, ``base_failed`` and ``kept``; ``carry`` names further columns to pass on."""
    columns = dict.fromkeys((key, *carry, "lang", "source"))
    scored = (docs.select(*columns, statistics(F.col(text)).alias("_s")).select(*columns, *[F.col(f"_s.{s}").alias(s) for s in STATS])
              .withColumn("base_failed", base_failed()).select("*", *_scores()))
    scored = stored(scored, "scored")
    limits = thresholds(scored).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    fits = F.lit(True)
    for rule, (_, both) in RULES.items():
        fits = fits & F.coalesce(F.col(rule) <= F.col(f"high_{rule}"), F.lit(True))
        if both:
            fits = fits & F.coalesce(F.col(rule) >= F.col(f"low_{rule}"), F.lit(True))
    judged = scored.join(limits, F.expr("lang <=> _lang AND source <=> _source"), "left")
    return judged.select(*dict.fromkeys((key, *carry)), *STATS, "base_failed", (~F.col("base_failed") & fits).alias("kept"))


def filter_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with their columns."""
    good = judge(docs.withColumn("_same", F.xxhash64(text)), key, text, ("_same",)).where("kept").select(F.col(key).alias("_key"), "_same").distinct()
    left = docs.withColumn("_h", F.xxhash64(text))
    return left.join(good, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_same")), "left_semi").drop("_h")
