"""Fixed patterns shared by the operators of this subpackage."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.storage import stash

# A word: a run of anything but ASCII white space. Possessive, as a run never needs to be given back.
WORD = r"[^\x20\x09-\x0D]++"
SPACE = r"[\x20\x09-\x0D]"


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def new_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def first_of_each(rows: DataFrame, group: str, most: int) -> DataFrame:
    """rows(group, h long, ...) -> at most `most` rows of different h for each group, those with the smallest hash h. Rows
    that are far behind go before anything is shuffled, so no task sees more than a few times `most` rows of a group."""
    counts = stash(rows.groupBy(group).agg(F.count("*").alias("group_rows")), "group-rows")
    others = [c for c in rows.columns if c not in (group, "h")]
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    near = rows.join(counts, group).filter(share * F.col("group_rows") <= 2 * most + 100)
    once = near.groupBy(group, "h").agg(*(F.min(c).alias(c) for c in others)) if others else near.select(group, "h").distinct()
    order = Window.partitionBy(group).orderBy(F.shiftrightunsigned("h", 11), "h")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")
