"""Query understanding: spelling against the corpus vocabulary, synonyms, fresh intent."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import fold, folded_tokens, fresh_intent, normalize, tokens

# Folded aliases of the news trade; keys of several words never match a single token.
SYNONYMS = {
    "covid": ["corona", "sars cov 2", "dich covid"], "corona": ["covid"], "tphcm": ["tp hcm", "ho chi minh", "sai gon"], "hcm": ["ho chi minh", "sai gon", "tphcm"],
    "ha noi": ["hn", "thu do"], "oto": ["xe hoi", "o to"], "bds": ["bat dong san", "nha dat"], "ntd": ["nguoi tieu dung"], "usd": ["do la", "dong bac xanh"], "lai suat": ["lai vay"],
}


#: Tokens of so many letters at most are compared by deletion variants.
SHORT = 40


def parse(queries: DataFrame) -> DataFrame:
    """queries(query_id, text): normalised and folded forms, tokens, fresh intent; without a token the query finds nothing."""
    text = F.col("text")
    return queries.select("query_id", normalize(text).alias("normalized"), fold(normalize(text)).alias("folded"), tokens(text).alias("tokens"), fresh_intent(text).alias("fresh_intent"))


def correct(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """words(word), vocabulary(token, freq): word, corrected. A known word stays; else the most frequent token one edit
    away, else two away (an adjacent swap is one edit); ties by token. Candidates meet on their deletion variants (all
    strings with up to two letters less), so this is an equi-join. Longer tokens than SHORT would have too many: they meet on
    fifths. Two edits, swaps too, touch four of five parts of a token at most; the fifth stands in the word, moved by two
    letters at most."""
    lesser = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    once = lambda c: lesser(c)
    variants = lambda c: F.array_distinct(F.concat(F.array(c), once(c), F.flatten(F.transform(once(c), lesser))))
    w = words.select("word").distinct()
    known = w.join(vocabulary, F.col("word") == F.col("token"), "left_semi").select("word", F.col("word").alias("corrected"))
    unknown = w.join(vocabulary, F.col("word") == F.col("token"), "left_anti")
    lengths = unknown.select(F.explode(F.sequence(F.length("word") - 2, F.length("word") + 2)).alias("length")).distinct()
    near_by = vocabulary.join(lengths, F.length("token") == F.col("length"), "left_semi")
    left = unknown.filter(F.length("word") <= SHORT + 2).select("word", F.explode(variants(F.col("word"))).alias("v"))
    right = near_by.filter(F.length("token") <= SHORT).select("token", "freq", F.explode(variants(F.col("token"))).alias("v")).join(left.select("v").distinct(), "v", "left_semi")
    part = lambda text, n, at, shift: F.substring(text, (at * n / 5).cast("int") + shift + 1, ((at + 1) * n / 5).cast("int") - (at * n / 5).cast("int"))
    fifths = F.explode(F.sequence(F.lit(0), F.lit(4)))
    long_left = unknown.filter(F.length("word") > SHORT - 2).select("word", F.explode(F.sequence(F.length("word") - 2, F.length("word") + 2)).alias("n")).select("word", "n", fifths.alias("at"))
    long_left = long_left.select("word", "n", "at", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("shift")).filter((F.col("at") * F.col("n") / 5).cast("int") + F.col("shift") >= 0)
    long_left = long_left.select("word", "n", "at", part(F.col("word"), F.col("n"), F.col("at"), F.col("shift")).alias("v")).distinct()
    long_right = near_by.filter(F.length("token") > SHORT).select("token", "freq", F.length("token").alias("n"), fifths.alias("at"))
    long_right = long_right.select("token", "freq", "n", "at", part(F.col("token"), F.col("n"), F.col("at"), F.lit(0)).alias("v"))
    pairs = left.join(right, "v").select("word", "token", "freq").union(long_left.join(long_right, ["n", "at", "v"]).select("word", "token", "freq")).distinct()
    swaps = F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.lit(1)), F.substring("word", i, F.lit(1)), F.substring("word", i + 2, F.length("word"))))
    distance = F.when(F.array_contains(swaps, F.col("token")), 1).otherwise(F.levenshtein("word", "token"))
    near = pairs.withColumn("d", F.least(distance, F.array_min(F.transform(swaps, lambda s: F.levenshtein(s, F.col("token")) + 1)))).filter("d <= 2")
    best = near.groupBy("word").agg(F.min_by("token", F.struct("d", -F.col("freq"), "token")).alias("corrected"))
    return known.union(unknown.join(best, "word", "left").select("word", F.coalesce("corrected", "word")))


def read_synonyms(path: str) -> dict[str, list[str]]:
    """Synonyms from a JSON object of words and lists of words."""
    with open(path, encoding="utf-8") as f:
        return {str(k): [str(x) for x in v] for k, v in json.load(f).items()}


def expand(queries: DataFrame, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """query_id, expanded: the tokens followed by the synonyms of each single folded token."""
    known = F.create_map(*(x for k, v in (SYNONYMS | (synonyms or {})).items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    more = F.flatten(F.filter(F.transform(folded_tokens(F.col("text")), lambda t: known[t]), lambda a: a.isNotNull()))
    return queries.select("query_id", F.array_join(F.concat(tokens(F.col("text")), more), " ").alias("expanded"))
