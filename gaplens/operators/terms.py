"""Terms and their TF-IDF weights; character n-grams come from expressions, not from a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaplens.sources.shared import settled


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def padded_words(text: Column) -> Column:
    """Each word with one space at both ends."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return F.transform(tokens, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))  # once a word, not once a gram


def word_grams(word: Column, least: int = 3, most: int = 5) -> Column:
    """All substrings of the given lengths of a padded word."""

    def grams(n: int) -> Column:
        starts = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: word.substr(i, F.lit(n)))

    return F.concat(*[grams(n) for n in range(least, most + 1)])


def char_terms(text: Column, least: int = 3, most: int = 5) -> Column:
    """All substrings of the given lengths of each word with one space at both ends."""
    return F.flatten(F.transform(padded_words(text), lambda w: word_grams(w, least, most)))


# Words that a keyword fallback leaves out; a longer list of common English words for terms, which is a parameter.
FALLBACK_STOPS = ("the", "and", "for", "that", "this", "with", "you", "are", "but", "not", "have", "app", "just")
ENGLISH_STOPS = (
    "a about after all also am an and any are as at be because been before being both but by can could did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def word_tokens(text: Column, stops: tuple[str, ...] | list[str] = ENGLISH_STOPS) -> Column:
    """Words of two letters or more that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(list(stops)))


def _pairs(tokens: Column, pair) -> Column:
    """What `pair` makes of each two neighbours; null for fewer than two tokens."""
    return F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), pair))


def _with_pairs(tokens: Column) -> Column:
    return F.concat(tokens, F.coalesce(_pairs(tokens, lambda a, b: F.concat(a, F.lit(" "), b)), F.array().cast("array<string>")))


def word_terms(text: Column, stops: tuple[str, ...] | list[str] = ENGLISH_STOPS) -> Column:
    """Words of two letters or more that are no stop words, and the pairs of neighbours among them."""
    return _with_pairs(word_tokens(text, stops))


def vocabulary(df: DataFrame, key: str, terms: Column, n: int, features: int) -> DataFrame:
    """(term, idf) of the terms of greatest count, the first in the alphabet on ties: ln((1 + N) / (1 + df)) + 1."""
    counts = df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    best = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("docs")).orderBy(F.desc("total"), "term").limit(features)
    return best.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("docs"))) + 1).alias("idf"))


def weighed(df: DataFrame, key: str, terms: Column, vocabulary: DataFrame, sublinear: bool = True) -> DataFrame:
    """(key, term, weight): term frequency (1 + its logarithm if sublinear) times idf, over the row's norm."""
    counts = df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counts.join(F.broadcast(vocabulary), "term").select(key, "term", (tf * F.col("idf")).alias("w"))  # at most `features` rows
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def union_tfidf(df: DataFrame, key: str, text: str, words: int = 12_000, chars: int = 30_000) -> DataFrame:
    """Word and character terms side by side, each block over its own norm."""
    n = df.count()
    parts = []
    for name, found, most in (("word", word_terms(F.col(text)), words), ("char", char_terms(F.col(text)), chars)):
        parts.append(weighed(df, key, found, vocabulary(df, key, found, n, most)).select(key, F.lit(name).alias("block"), "term", F.round("weight", 6).alias("weight")))
    return parts[0].unionByName(parts[1])


def keywords(df: DataFrame, group: str, key: str, text: str, top: int = 8, features: int = 500) -> DataFrame:
    """(group, place, term): the terms of greatest mean TF-IDF over a group's texts, each group a corpus of its own; the first in the alphabet on ties."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    tokens = settled(df.select(group, key, word_tokens(F.col(text)).alias("tokens")))
    words_ = tokens.select(group, F.explode("tokens").alias("term")).groupBy(group, "term").agg(F.count("*").alias("total"))
    # A pair is no commoner than its words: one among the first `features` terms has two of the first `features` words or their ties.
    common = settled(words_.withColumn("p", F.rank().over(Window.partitionBy(group).orderBy(F.desc("total")))).where(F.col("p") <= features).select(group, "term", "total"))
    pair = tokens.select(group, F.explode(_pairs(F.col("tokens"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("t")).select(group, "t.a", "t.b")
    for side in ("a", "b"):
        pair = pair.join(common.select(group, F.col("term").alias(side)), [group, side])
    pairs = pair.groupBy(group, "a", "b").agg(F.count("*").alias("total")).select(group, F.concat("a", F.lit(" "), "b").alias("term"), "total")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total"), "term"))
    known = settled(common.unionByName(pairs).withColumn("p", place).where(F.col("p") <= features).select(group, "term"))
    found = tokens.select(group, key, F.explode(_with_pairs(F.col("tokens"))).alias("term")).join(known, [group, "term"])
    counts = settled(found.groupBy(group, key, "term").agg(F.count("*").alias("tf")))
    idf = counts.groupBy(group, "term").agg(F.count("*").alias("docs")).join(n, group).select(group, "term", "n", (F.log((1.0 + F.col("n")) / (1 + F.col("docs"))) + 1).alias("idf"))
    raw = counts.join(idf, [group, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    rows = raw.groupBy(group, key).agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("row"))  # `features` terms at most
    mean = rows.select(group, "n", "norm", F.explode("row").alias("r")).groupBy(group, "r.term").agg((F.sum(F.col("r.w") / F.col("norm")) / F.max("n")).alias("score"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "term"))
    return mean.withColumn("place", best).where(F.col("place") <= top).select(group, "place", "term")


def fallback_keywords(df: DataFrame, group: str, text: str, top: int = 8) -> DataFrame:
    """(group, place, term): the commonest words of three letters a-z or more that are no FALLBACK_STOPS."""
    words_ = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*FALLBACK_STOPS))
    counts = df.select(group, F.explode(words_).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    return counts.withColumn("place", best).where(F.col("place") <= top).select(group, "place", "term")


def document_frequency(df: DataFrame, terms: Column) -> DataFrame:
    """(term, docs); each document counts a term once before the shuffle."""
    return df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


def tfidf(df: DataFrame, key: str, terms: Column, features: int = 40_000) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) over its norm, for the terms of greatest count."""
    found = weighed(df, key, terms, vocabulary(df, key, terms, df.count(), features))
    return found.select(key, "term", F.round("weight", 6).alias("weight"))
