"""Word index over documents: building, prefix search, ranked text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlor.plans.skew import paginate, top_in_groups
from parlor.session import written

DOC = ["hub_id", "nid"]

# Fixed values of the scoring rule.
EXACT, PER_BYTE, KEEP_ABOVE = 100, 10, 25
QUERY_SPLIT = r"[ ,.;:!%@/=+\-_#]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, whole."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def index_build(documents: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """``(hub_id, nid, word, occurrence)``; documents already in ``indexed`` are left out.

    Texts are dealt by document before they are split into words, as a text is several times smaller than its postings; what follows per document
    needs no further shuffle.
    """
    todo = documents if indexed is None else documents.join(indexed.select(*DOC).distinct(), DOC, "left_anti")
    return todo.select(*DOC, "text").repartition(*DOC).select(*DOC, F.explode(words_of(F.col("text"))).alias("word")).groupBy(*DOC, "word").agg(
        F.count(F.lit(1)).alias("occurrence"))


def query_words(queries: DataFrame) -> DataFrame:
    """``queries(query_id, string)`` split on the listed punctuation."""
    parts = F.filter(F.split(F.lower("string"), QUERY_SPLIT), lambda w: w != "")
    return queries.select("query_id", F.explode(parts).alias("q")).distinct()


def _prefixes(word: Column) -> Column:
    """Prefixes of a word long enough to pass the threshold, and the whole word."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.left(word, n))
    return F.filter(prefixes, lambda p: (F.octet_length(p) * PER_BYTE > KEEP_ABOVE) | (p == word))


def word_search(queries: DataFrame, index: DataFrame, page: int | None = 1, rows: int = 45) -> DataFrame:
    """Best word per query and document, best documents first; the highest score wins, then the smallest word.

    A document first keeps its best word per query word, of which the queries that hold it then choose: all within the document, so a posting
    meets no query that another word of the document with the same prefix has met. For a page, each query word sends on the first ``page * rows``
    documents of a score only: whoever of them comes before a document in the order scores at least as much, so the cut leaves the page exact.
    """
    asked = query_words(queries).where("query_id IS NOT NULL")
    other = F.col("q") != F.col("word")
    score = F.octet_length("q") * PER_BYTE + F.when(F.col("other"), F.lit(0)).otherwise(F.lit(EXACT))
    per_word = (
        index.select(*DOC, "word", F.explode(_prefixes(F.col("word"))).alias("q")).join(asked.select("q").distinct(), "q")
        .groupBy(*DOC, "q").agg(F.min(F.struct(other.alias("other"), "word")).alias("m"))
        .select(*DOC, "q", "m.other", "m.word").withColumn("score", score).where(F.col("score") > KEEP_ABOVE).drop("other")
    )
    if page is not None:
        per_word = top_in_groups(per_word, ["q", "score"], [F.col(c).asc() for c in DOC], max(int(page), 1) * rows, "_first").drop("_first")
    best = (
        per_word.join(asked, "q").groupBy(*DOC, "query_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "word")).alias("m"))
        .select("query_id", *DOC, (-F.col("m.less")).alias("score"), "m.word")
    )
    if page is None:
        return best
    return paginate(best, ["query_id"], [F.col("score").desc(), F.col("hub_id").asc(), F.col("nid").asc()], page, rows)


def term_weights(index: DataFrame) -> DataFrame:
    """``(word, weight)``: log10(N / df) squared, in millionths, so that sums are exact whole numbers."""
    n = index.select(*DOC).distinct().agg(F.count(F.lit(1))).scalar()
    df = index.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.select("word", F.round(F.pow(F.log10(n / F.col("df")), F.lit(2)) * 1_000_000).cast("bigint").alias("weight"))


def _scores(terms: DataFrame, index: DataFrame, weights: DataFrame) -> DataFrame:
    weighed = written(terms.join(weights, "word"))  # of the size of the queries, whatever the index
    return weighed.join(index, "word").groupBy("query_id", *DOC).agg(F.sum(F.col("occurrence") * F.col("weight")).alias("score"))


def text_search(
    queries: DataFrame, index: DataFrame, tags: DataFrame, top_documents: int = 3, top_terms: int = 5, page: int | None = 1, rows: int = 45,
) -> DataFrame:
    """Ranked search with query expansion, plus hits on the hashtag of ``tags(hub_id, nid, hashtag)``.

    A first pass ranks by term weight; the strongest new terms of its best documents join the query for the
    second pass.  Hashtag hits rank before content hits.  The index is read five times, so it is written first.
    """
    index = written(index)
    weights = term_weights(index)
    asked = queries.select("query_id", F.explode(words_of(F.col("string"))).alias("word")).distinct()
    first = _scores(asked, index, weights)
    best = top_in_groups(first, ["query_id"], [F.col("score").desc(), *[F.col(c).asc() for c in DOC]], top_documents)
    terms = (
        written(best.select("query_id", *DOC)).join(index, DOC).join(weights, "word").join(asked, ["query_id", "word"], "left_anti")
        .groupBy("query_id", "word").agg(F.sum(F.col("occurrence") * F.col("weight")).alias("gain"))
    )
    added = top_in_groups(terms, ["query_id"], [F.col("gain").desc(), F.col("word").asc()], top_terms).select("query_id", "word")
    content = _scores(asked.unionByName(added), index, weights)
    names = tags.select(*DOC, F.explode(words_of(F.col("hashtag"))).alias("word"))
    name_prefix = names.select(*DOC, F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.left(F.col("word"), n))).alias("word"))
    by_name = asked.join(name_prefix, "word").groupBy("query_id", *DOC).agg(F.count_distinct("word").alias("s2"))
    found = content.join(by_name, ["query_id", *DOC], "full").select(
        "query_id", *DOC, F.coalesce("score", F.lit(0)).alias("s1"), F.coalesce("s2", F.lit(0)).alias("s2")).where("s1 > 0 OR s2 > 0")
    if page is None:
        return found
    return paginate(found, ["query_id"], [F.col("s2").desc(), F.col("s1").desc(), *[F.col(c).asc() for c in DOC]], page, rows)


def prefix_lookup(requests: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``requests(key, …)`` against the prefixes of a small name table, as an equi-join; an empty key matches all."""
    folded = F.lower(F.col(column))
    prefixes = names.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.length(column)), lambda n: F.left(folded, n))).alias("_p"))
    return requests.withColumn("_p", F.lower(F.trim("key"))).join(prefixes, "_p").drop("_p")
