"""Quotation linking: replies joined to what they quote, and conversations without quotes in reply order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import carry, scratch, text
from sparkrecon.llm.ranking import ranked

_MARKS = r"^(?:[ \t]?>)++"
#: Lines that announce a quotation in mail; they count only right before one.
ANNOUNCES = r"(?i)^[ \t]*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)[ \t]*:[ \t]*$"


def _level(line: Column) -> Column:
    """Quote marks before a line: > once for each level, spaces between them or not."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _body(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def _units(messages: DataFrame) -> DataFrame:
    """What can be quoted or original: each line with a word, each run of lines of one level, and each paragraph of it.

    A paragraph ends at a line without a word.

    Rows (conv_id, _pos, level, hash, words).
    """
    numbered = F.transform(F.col("_parts"), lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), i.alias("i")))
    before = lambda x: F.get(F.col("_parts"), x["i"] - 1)
    first = lambda x: F.coalesce(before(x)["level"] != x["level"], F.lit(True))
    broken = lambda x: first(x) | (x["line"].rlike(text.WORD) != before(x)["line"].rlike(text.WORD))
    starts = messages.withColumn("_starts", F.transform(F.filter(numbered, first), lambda x: x["i"]))
    starts = starts.withColumn("_breaks", F.transform(F.filter(numbered, broken), lambda x: x["i"]))
    passages = lambda at: F.transform(
        F.col(at),
        lambda a, k: F.struct(
            F.get(F.col("_parts"), a)["level"].alias("level"),
            F.array_join(
                F.transform(F.slice(F.col("_parts"), a + 1, F.coalesce(F.get(F.col(at), k + 1), F.size("_parts")) - a), lambda y: y["line"]), "\n"
            ).alias("line"),
        ),
    )
    units = starts.select("conv_id", "_pos", F.explode(F.array_union(F.array_union(F.col("_parts"), passages("_starts")), passages("_breaks"))).alias("unit"))
    units = units.select("conv_id", "_pos", F.col("unit.level").alias("level"), text.normal_line(F.col("unit.line")).alias("passage")).filter("passage <> ''")
    return units.select("conv_id", "_pos", "level", F.xxhash64("passage").alias("hash"), text.n_words(F.col("passage")).alias("words"))


def link(messages: DataFrame) -> DataFrame:
    """Messages in turn order, their quotations taken out and joined to what they quote.

    messages: conv_id, turn, role, text; other columns are kept. Lines that begin with quote marks (>, >> or > >)
    are quoted, a mark a level. Each quoted line, paragraph and passage as a whole is normalised, hashed and joined
    to the first message of the conversation that has it unquoted, if that is an earlier one. A message replies to
    the message from which most words of its first-level quotations come (the later one of two), and without
    such to the message before it.

    Adds position (from 1, by turn, then role and text), reply_to (a position; null for the first), n_quotes (quoted
    lines, paragraphs and passages), n_linked (those found); text is left without quotations and the lines that announce them.
    reply_to is always lower than position. A null conv_id is a conversation; null turns come last; a null text stays
    null and quotes nothing; repeated rows are messages of their own. An added column takes the place of an input
    column of its name; other columns are carried whatever their names.
    """
    given, needed = messages, ["conv_id", "turn", "role", "text"]
    messages = carry.packed(messages, needed)
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    placed = ranked(messages, ["conv_id"], order, "_pos")
    parts = placed.withColumn("_split", F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.struct(_level(x).alias("level"), _body(x).alias("line"))))
    announced = F.filter(
        F.col("_split"), lambda x, i: ~(x["line"].rlike(ANNOUNCES) & F.coalesce(F.get(F.col("_split"), i + 1)["level"] > x["level"], F.lit(False)))
    )
    placed = scratch.table(parts.withColumn("_parts", announced).drop("_split"), "messages")
    units = scratch.table(_units(placed.select("conv_id", "_pos", "_parts")), "units")
    own = units.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("_pos").alias("_origin"))
    own = scratch.table(own.select(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash"), "_origin"), "originals")
    quoted = units.filter("level > 0").join(own, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("hash") == F.col("_hash")), "left")
    found = F.col("_origin") < F.col("_pos")
    votes = quoted.groupBy("conv_id", "_pos", F.when(found, F.col("_origin")).alias("_origin")).agg(
        F.sum(F.when(F.col("level") == 1, F.col("words")).otherwise(0)).alias("_words"), F.count(F.lit(1)).alias("_n")
    )
    vote = F.when(F.col("_origin").isNotNull() & (F.col("_words") > 0), F.struct("_words", "_origin"))
    links = votes.groupBy("conv_id", "_pos").agg(
        F.max(vote)["_origin"].alias("_reply"), F.sum("_n").alias("_quotes"), F.sum(F.when(F.col("_origin").isNotNull(), F.col("_n")).otherwise(0)).alias("_linked")
    )
    links = scratch.table(links.select(F.col("conv_id").alias("_conv"), F.col("_pos").alias("_at"), "_reply", "_quotes", "_linked"), "replies")
    out = placed.join(links, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_pos") == F.col("_at")), "left")
    rest = F.array_join(F.transform(F.filter(F.col("_parts"), lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    rest = F.regexp_replace(rest, r"^[\x20\x09-\x0D]*\n|[\x20\x09-\x0D]+$", "")
    changed = F.exists(F.col("_parts"), lambda x: x["level"] > 0)
    out = out.withColumns({
        "text": F.when(changed & F.col("text").isNotNull(), rest).otherwise(F.col("text")),
        "position": F.col("_pos").cast("long"),
        "reply_to": F.when(F.col("_pos") > 1, F.coalesce("_reply", F.col("_pos") - 1)).cast("long"),
        "n_quotes": F.coalesce("_quotes", F.lit(0)).cast("long"),
        "n_linked": F.coalesce("_linked", F.lit(0)).cast("long"),
    })
    return carry.unpacked(out, given, needed, ["position", "reply_to", "n_quotes", "n_linked"])
