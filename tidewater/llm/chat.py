"""Chat formatting by quotation linking.

Leading > marks give each line its quote level. Runs of lines of one level are passages; passages, and the
paragraphs and lines of unquoted text, are normalised (case, punctuation and white space do not matter) and hashed.
A quoted passage is joined on its hash to the message that wrote it: the latest earlier message of the same
conversation, else the earliest message of any other (not for short passages); where the whole passage is not found its
lines are tried. A message replies to what its least nested quotation links to, and stands without the quotes.

Replies make threads, which may run through several conversations. Where messages of different conversations quote each
other in a circle, the first of the circle replies to none. Each message knows the root of its thread, its depth below it
and its place in the thread, in which every message comes after the one that it replies to.

Nothing is collected for a conversation or a thread: places are row numbers within cells, on top of the counts of the
cells before; passages meet through windows over cells of (conversation, hash) and minima by hash, without pairs; roots
and depths are found by doubling the links of messages that quote (those that only follow the message before them
need none).

Defined results: null text counts as empty and has no quotes; a null turn comes first; messages that share a turn are
ordered by a hash of role and text; a message that quotes nothing known replies to the message before it (the first one to
none); repeated rows are messages of their own; rows without a conversation are one conversation; a text of any length is
parsed whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.storage import release, stash

CELL, SALTS = 4096, 64
_NONE = "\0none"
#: Passages have so many letters or digits at least to link to other conversations, so that "ok" links none. The last
#: bit of a hash is 1 for shorter ones.
LEAST_LETTERS = 8
_MARKS = re.compile(r"[ \t]*>[> \t]*")
_OTHER = re.compile(r"[\W_]+")


def level_of(line: str) -> tuple[int, str]:
    """Quote level and the line without its marks."""
    marks = _MARKS.match(line)
    return (marks.group().count(">"), line[marks.end() :]) if marks else (0, line)


def passage_hash(text: str) -> int | None:
    plain = _OTHER.sub(" ", text.lower()).strip()
    if not plain:
        return None
    short = len(plain.replace(" ", "")) < LEAST_LETTERS
    return (xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) & ~1 | short) - (1 << 63)


def parse(text: str | None) -> tuple[str, list[tuple[int, list[int]]], set[int]]:
    """The text without quotes; each quoted passage's level and hashes (the whole first, then its lines); the hashes
    of what the message itself says: all of it, its paragraphs, its lines."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        level, rest = level_of(line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    quotes, own = [], set()
    body = "\n".join("\n".join(lines).strip("\n") for level, lines in runs if not level).strip()
    for level, lines in runs:
        hashes = [h for h in (passage_hash("\n".join(lines)), *(passage_hash(x) for x in lines if len(lines) > 1)) if h is not None]
        if level and hashes:
            quotes.append((level, list(dict.fromkeys(hashes))))
        elif not level:
            own.update(hashes)
            own.update(h for p in re.split(r"\n[ \t]*\n", "\n".join(lines)) if (h := passage_hash(p)) is not None)
    if (h := passage_hash(body)) is not None:
        own.add(h)
    return body, quotes, own


def _parsed(batches):
    for batch in batches:
        found = [parse(x.as_py()) for x in batch.column("text")]
        names = [n for n in batch.schema.names if n != "text"]
        columns = [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([max((q[0] for q in f[1]), default=0) for f in found], pa.int32()),
            pa.array([[h for _, h in sorted(f[1], key=lambda q: q[0])] for f in found], pa.list_(pa.list_(pa.int64()))),
            pa.array([sorted(f[2]) for f in found], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, "body", "max_level", "quotes", "own"])


def _numbered(rows: DataFrame, keys: list[str], major: str, minor: list[str], order: list, name: str) -> DataFrame:
    """rows with their number from 0 in the order of major, minor and order within equal keys; no window holds more than
    the cells of one key, or of one major cell, or the rows of one minor cell."""
    over = lambda by, upto: Window.partitionBy(*by).orderBy(*upto).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    cells = rows.groupBy(*keys, major, *minor).agg(F.count("*").alias("n"))
    majors = cells.groupBy(*keys, major).agg(F.sum("n").alias("n")).withColumn("before", ahead("n", over(keys, [major]))).drop("n")
    cells = cells.withColumn("within", ahead("n", over([*keys, major], minor))).join(majors, [*keys, major])
    cells = cells.select(*keys, major, *minor, (F.col("before") + F.col("within")).alias("base"))
    nth = F.row_number().over(Window.partitionBy(*keys, major, *minor).orderBy(*order))
    return rows.withColumn("nth", nth).join(cells, [*keys, major, *minor]).withColumn(name, F.col("base") + F.col("nth") - 1).drop("nth", "base")


def _latest(points: DataFrame, asks: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """asks(keys, position, ...) with `found`: the last position of points(keys, position) before it (or at it, unless
    strict); by cells of positions."""
    both = points.select(*keys, "position", F.col("position").alias("point")).distinct().unionByName(asks.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    both = both.withColumn("span", F.floor(F.col("position") / CELL))
    inside = Window.partitionBy(*keys, "span").orderBy("position").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy(*keys, "span").agg(F.max("point").alias("last")).select(*keys, "span", F.max("last").over(before).alias("earlier"))
    seen = both.withColumn("here", F.max("point").over(inside)).filter("asks").join(spans, [*keys, "span"])
    return seen.withColumn("found", F.coalesce("here", "earlier")).drop("point", "asks", "span", "here", "earlier")


def _placed(messages: DataFrame) -> DataFrame:
    """Parsed messages with conv (a text, never null) and their position in the conversation."""
    kind = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}
    head = ", ".join(f"{c} {t}" for c, t in kind.items())
    named = messages.select(*kind, "text").withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(_NONE)), "tie": F.xxhash64("role", "text")})
    parsed = stash(named.mapInArrow(_parsed, f"{head}, conv string, tie long, body string, max_level int, quotes array<array<long>>, own array<long>"), "messages")
    turn = F.coalesce("turn", F.lit(-1))
    celled = parsed.withColumns({"cell": F.floor(turn / CELL), "at": turn, "salt": F.shiftrightunsigned("tie", 58)})
    return stash(_numbered(celled, ["conv"], "cell", ["at", "salt"], [F.shiftrightunsigned("tie", 1), "tie"], "position").drop("cell", "at", "salt"), "messages-placed")


def _replies(placed: DataFrame) -> DataFrame:
    """conv_id, conv, position, n_linked, to_conv, to_position of the messages that quote something known."""
    # Quoted hashes: their whole passage first (piece 0), then its lines.
    quoted = placed.select("conv_id", "conv", "position", F.posexplode("quotes").alias("quote", "hashes")).select("conv_id", "conv", "position", "quote", F.posexplode("hashes").alias("piece", "h"))
    quoted = stash(quoted, "quoted")
    wanted = quoted.select("h").distinct()
    said = stash(placed.select("conv_id", "conv", "position", F.explode("own").alias("h")).join(wanted, "h", "left_semi"), "said")
    # In the same conversation: the latest that said it before.
    here = _latest(said, quoted, ["conv", "h"], strict=True)
    # Elsewhere: the first that said it, or for that one's own conversation the first of the others.
    # Short passages, such as "ok", are found within their conversation only.
    by_conv = said.filter(F.col("h").bitwiseAND(F.lit(1)) == 0).groupBy("h", "conv").agg(F.first("conv_id").alias("conv_id"), F.min("position").alias("position")).select("h", F.struct("conv_id", "conv", "position").alias("origin"))
    first = stash(by_conv.groupBy("h").agg(F.min("origin").alias("origin")), "said-first")
    others = by_conv.join(first.select("h", F.col("origin.conv").alias("first_conv")), "h").filter(F.col("origin.conv") != F.col("first_conv"))
    first = first.join(others.groupBy("h").agg(F.min("origin").alias("other")), "h", "left")
    elsewhere = F.when(F.col("origin.conv") == F.col("conv"), F.col("other")).otherwise(F.col("origin"))
    found = here.join(first, "h", "left").withColumn("source", F.when(F.col("found").isNotNull(), F.struct("conv", F.col("found").alias("position"))).otherwise(F.struct(elsewhere["conv"].alias("conv"), elsewhere["position"].alias("position"))))
    known = F.col("source.position").isNotNull()
    best = found.groupBy("conv", "position", "quote").agg(F.first("conv_id").alias("conv_id"), F.min_by("source", F.when(known, F.col("piece"))).alias("source"))
    replies = best.groupBy("conv", "position").agg(F.first("conv_id").alias("conv_id"), F.count_if(known).alias("n_linked"), F.min_by("source", F.when(known, F.col("quote"))).alias("source")).filter("n_linked > 0")
    return stash(replies.select("conv_id", "conv", "position", "n_linked", F.col("source.conv").alias("to_conv"), F.col("source.position").alias("to_position")), "replies")


def _doubled(steps: DataFrame, least_rounds: int = 0) -> DataFrame:
    """steps(conv, position, to_conv, to_position (null: known), depth, root_conv, root_position, first) with their links
    doubled until no more become known, and least_rounds times. first: the smallest message on the way."""
    left, rounds = None, 0
    while True:
        goal = steps.select(
            F.col("conv").alias("to_conv"), F.col("position").alias("to_position"), F.col("to_conv").alias("next_conv"), F.col("to_position").alias("next_position"),
            F.col("depth").alias("more"), F.col("root_conv").alias("far_conv"), F.col("root_position").alias("far_position"), F.col("first").alias("far_first"),
        )
        went = steps.filter("to_conv is not null").join(goal, ["to_conv", "to_position"]).select(
            "conv", "position", F.col("next_conv").alias("to_conv"), F.col("next_position").alias("to_position"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("far_conv").alias("root_conv"), F.col("far_position").alias("root_position"), F.least("first", "far_first").alias("first"),
        )
        used, steps = steps, stash(steps.filter("to_conv is null").unionByName(went), "thread-steps")
        release(steps.sparkSession, used)
        before, left, rounds = left, steps.filter("to_conv is not null").count(), rounds + 1
        if rounds >= least_rounds and (not left or left == before):
            return steps


def _threads(placed: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all messages: conv, position, root_conv, root_position, depth; the replies that close a circle: conv, position)."""
    # A chain of messages that follow one another ends at one that quotes, or at the first of the conversation.
    asks = replies.select(F.col("to_conv").alias("conv"), F.col("to_position").alias("position"), F.struct("conv_id", "conv", "position").alias("by"))
    ends = _latest(replies, asks, ["conv"], strict=False)
    start = F.col("found").isNull()
    steps = stash(ends.select(
        F.col("by.conv").alias("conv"), F.col("by.position").alias("position"), F.when(~start, F.col("conv")).alias("to_conv"), F.col("found").alias("to_position"),
        (1 + F.col("position") - F.coalesce("found", F.lit(0))).alias("depth"), F.when(start, F.col("conv")).alias("root_conv"), F.when(start, F.lit(0).cast("long")).alias("root_position"), F.col("by").alias("first"),
    ), "thread-steps")
    kept = stash(steps, "thread-steps")
    known = _doubled(steps)
    around = known.filter("to_conv is not null")
    n = around.count()
    cut = around.select("conv", "position").limit(0)
    if n:
        ringed = _doubled(stash(kept.join(around.select("conv", "position"), ["conv", "position"], "left_semi"), "thread-steps"), n.bit_length() + 1)
        ring = ringed.select(F.col("to_conv").alias("conv"), F.col("to_position").alias("position")).distinct()
        cut = stash(ringed.join(ring, ["conv", "position"]).filter("first.conv = conv and first.position = position").select("conv", "position"), "thread-cuts")
        again = kept.join(cut.withColumn("cut", F.lit(True)), ["conv", "position"], "left").join(around.select("conv", "position"), ["conv", "position"], "left_semi")
        own = lambda c, value: F.when(F.col("cut").isNull(), F.col(c)).otherwise(value).alias(c)
        again = again.select("conv", "position", own("to_conv", F.lit(None)), own("to_position", F.lit(None)), own("depth", F.lit(0).cast("long")), own("root_conv", F.col("conv")), own("root_position", F.col("position")), "first")
        known = known.filter("to_conv is null").unionByName(_doubled(stash(again.unionByName(known.filter("to_conv is null")), "thread-steps")).join(around.select("conv", "position"), ["conv", "position"], "left_semi"))
    near = _latest(replies, placed.select("conv", "position"), ["conv"], strict=False)
    ends = known.select("conv", F.col("position").alias("found"), "root_conv", "root_position", "depth")
    whole = near.join(ends, ["conv", "found"], "left")
    depth = F.coalesce("depth", F.lit(0)) + F.col("position") - F.coalesce("found", F.lit(0))
    return whole.select("conv", "position", F.coalesce("root_conv", "conv").alias("root_conv"), F.coalesce("root_position", F.lit(0)).cast("long").alias("root_position"), depth.cast("long").alias("depth")), cut


def link_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, parent_conv, parent_position, thread_conv, thread_position, depth, place, n_quotes,
    n_linked, max_level, text (unquoted), formatted. position: place in the conversation, from 0; the parent: the message
    replied to; the thread is named by its root; place: in the thread, from 0, after the parent's."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    placed = _placed(messages)
    replies = _replies(placed)
    threads, cut = _threads(placed, replies)
    salted = threads.withColumns({"tie": F.xxhash64("conv", "position"), "cell": F.floor(F.col("depth") / CELL)}).withColumn("salt", F.shiftrightunsigned("tie", 58))
    ordered = _numbered(salted, ["root_conv", "root_position"], "cell", ["depth", "salt"], [F.shiftrightunsigned("tie", 1), "conv", "position"], "place").drop("tie", "cell", "salt")
    links = replies.drop("conv_id").join(cut.withColumn("cut", F.lit(True)), ["conv", "position"], "left")
    out = placed.join(links, ["conv", "position"], "left").join(ordered, ["conv", "position"])
    linked = F.col("to_conv").isNotNull()
    follows = (F.col("position") > 0) & ~linked
    parent_conv = F.when(F.col("cut").isNull(), F.when(linked, F.col("to_conv")).when(follows, F.col("conv")))
    parent_position = F.when(F.col("cut").isNull(), F.when(linked, F.col("to_position")).when(follows, F.col("position") - 1))
    named = lambda c: F.when(c != _NONE, c).cast(kind)
    return out.select(
        "conv_id", "turn", "role", "position", named(parent_conv).alias("parent_conv"), parent_position.alias("parent_position"), named(F.col("root_conv")).alias("thread_conv"), F.col("root_position").alias("thread_position"),
        "depth", "place", F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "max_level", F.col("body").alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n<|end|>\n")).alias("formatted"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
