"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit per failed rule. A
policy is a versioned set of rules: a document passes if none of the policy's bits is set, so policies are changed
and compared without touching the texts again. Ablations (what each rule alone rejects, what the policy would keep
without it) come from counts by masked bits.

All of it is DataFrame functions: words and windows live in arrays inside the row, so that nothing is shuffled. The
5-word windows of a text are hashed to 64 bits; only texts in which some hash repeats are sorted to find where.

Defined results: null and empty texts have no words and all measurements 0 (they fail too_few_words); an empty table
gives an empty ledger; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.patterns import SPACE, WORD, whole_text

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
#: Name and failure condition of each rule; the bit is the position. Append only: bits in stored ledgers keep their meaning.
RULES: list[tuple[str, Column | Callable[[], Column]]] = [
    ("too_few_words", lambda: F.col("n_words") < 10),
    ("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    ("repeated_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    ("capitals", lambda: 10 * F.col("n_upper") > 4 * F.col("n_letters")),
    ("few_letters", lambda: 2 * F.col("n_letters") < F.col("word_chars")),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = ("too_few_words", "repeated_windows")
#: Versions of the policy: the rules that reject.
POLICIES = {
    1: BASE,
    2: (*BASE, "short_words", "long_words", "symbols", "repeated_lines", "capitals", "few_letters"),
}
CURRENT = 2


def policy_mask(version: int = CURRENT) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for the row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words within windows that are found twice or more in the text."""

    def covered(at: Column) -> Column:
        step = lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, b: a + b)

    def places(pairs: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(pairs, k)["h"] == e["h"], F.lit(False))
        twice = F.filter(pairs, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return F.sort_array(F.transform(twice, lambda e: e["at"]))

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, let(let(pairs, places), covered)).otherwise(F.lit(0))

    def hashes(codes: Column) -> Column:
        return F.transform(F.slice(codes, 1, F.size(codes) - (WINDOW - 1)), lambda c, k: F.xxhash64(c, *(F.get(codes, k + j) for j in range(1, WINDOW))))

    enough = F.size(words) >= WINDOW
    return F.when(enough, let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes), of)).otherwise(F.lit(0))


def _lines(text: Column) -> Column:
    """Lines with a word, and how many of them equal an earlier one."""
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the MEASURES (long) and fail_bits (long)."""
    text = F.col("text")
    words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")),
    )
    spaces = F.length(text) - F.length(F.regexp_replace(text, SPACE, ""))
    measured = docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id",
        words.alias("words"),
        (F.length(text) - spaces).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        _lines(text).alias("lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("n_letters"),
    )
    flat = measured.withColumns({"n_words": F.col("words.n"), "n_repeat_words": F.col("words.repeat"), "n_lines": F.col("lines.n"), "n_dup_lines": F.col("lines.dup")})
    flat = flat.select("doc_id", *(F.col(m).cast("long").alias(m) for m in MEASURES))
    bits = sum((F.when(rule(), 1 << k).otherwise(0) for k, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))
    return flat.withColumn("fail_bits", bits.cast("long"))


def apply_policy(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of the policy: rule, failed, failed_alone, kept_without, from counts by masked bits."""
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version)))
    counts = entries.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[version])))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("failed_alone"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask(1))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_upper", "n_letters", "fail_bits")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
nrep AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(nrep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_upper,
             length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters FROM w LEFT JOIN nrep USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)
             + (CASE WHEN 10 * n_upper > 4 * n_letters THEN 64 ELSE 0 END) + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, fail_bits = 0 AS kept,
       n_lines::BIGINT AS n_lines, n_upper::BIGINT AS n_upper, n_letters::BIGINT AS n_letters, fail_bits::BIGINT AS fail_bits FROM b
"""
