"""Quality rules: counts within a document, and lines that recur across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import carry, filters, scratch, text

SYMBOL = r"[#*$%&|<>]"


def _word_lines(column: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), "\n"), lambda x: x.rlike(text.WORD))


def base_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document's text.

    Windows of five words are compared by 64-bit hash. Only texts with some window twice sort their windows; what
    they cover is then summed from left to right, so the work on a text of n words is n log n.
    """
    words, found = F.col("_words"), F.col("_windows")
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)])
    )
    none = F.array().cast("array<bigint>")
    step = (
        docs.withColumn("_words", text.words(F.col("text")))
        .withColumn("_lines", _word_lines(F.col("text")))
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(SYMBOL)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_windows", F.when(F.size(words) >= window, hashes).otherwise(none))
        .drop("_words", "_lines")
    )
    sorted_windows = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    order = F.col("_order")
    step = step.withColumn("_order", F.when(F.size(F.array_distinct(found)) < F.size(found), sorted_windows))
    twice = F.filter(
        order,
        lambda x, k: F.coalesce(F.get(order, k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(order, k + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + window - F.greatest(p, acc["end"])).alias("n"), (p + window).alias("end")),
        lambda acc: acc["n"],
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    found = F.struct(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # a generator: no later filter on a count is moved below it, where it would sort the windows again for each window
    return step.select(*docs.columns, F.explode(F.array(found)).alias("_counts")).select(*docs.columns, "_counts.*")


def hashed_lines(docs: DataFrame, host: str) -> DataFrame:
    """One row for each different normalised line with a word of each document: host, document, line hash."""
    lines = F.array_distinct(F.transform(_word_lines(F.col("text")), lambda x: F.xxhash64(text.normal_line(x))))
    return docs.select(
        F.col(host).alias("_host"), F.xxhash64(F.col("text")).alias("_body"), F.explode(lines).alias("_line")
    )


def frequent_lines(docs: DataFrame, host: str, least: int) -> DataFrame:
    """Lines (_host, _line) in over least different documents of a host, a count that does not grow with the host.

    Copies of a text on a host are one document. Counts are summed before and after the shuffle, so a line that
    a third of all documents holds is a few rows.
    """
    seen = hashed_lines(docs, host).groupBy("_host", "_line", "_body").count()
    counts = seen.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"))
    return counts.filter(F.col("_docs") > least).select("_host", "_line")


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words", "base_failed", "kept"]


def rules(
    docs: DataFrame,
    host: str = "source",
    least: int = 20,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    remove: bool = False,
) -> DataFrame:
    """Judge each row of docs (text, host, ...); all rows and columns come back.

    Adds the base counts, n_frequent_words (words in lines that over least texts of the host hold), base_failed (under
    min_words words, or over max_repeat_percent % of them in repeated five-word windows) and kept: not base_failed and
    not depleted. A document is depleted if removing its frequent lines leaves under min_words words. With remove, the
    text of each document is what is left of it.

    Null or empty text has no words: it fails. A null host is a host of its own. Rows may repeat, with or without
    an id: a verdict belongs to a host and text. An added column takes the place of an input column of its name; other
    columns are carried whatever their names. Only rows that may hold a frequent line are shuffled (filters.flagged).
    Texts and lines are compared by 64-bit hash: among 10^10 different lines, about three pairs are taken for one line.
    """
    needed = ["text", host]
    slim = carry.packed(docs, needed)
    frequent = scratch.table(frequent_lines(slim, host, least), "frequent-lines")
    held = slim.select(
        F.col(host).alias("_of"),
        F.xxhash64(F.col("text")).alias("_body"),
        F.posexplode(_word_lines(F.col("text"))).alias("_at", "_text"),
    ).select("_of", "_body", "_at", F.xxhash64(text.normal_line(F.col("_text"))).alias("_key"), text.n_words(F.col("_text")).alias("_n"))
    held = held.join(frequent, F.col("_of").eqNullSafe(F.col("_host")) & (F.col("_key") == F.col("_line")), "left_semi")
    held = held.groupBy("_of", "_body", "_at").agg(F.first("_key").alias("_key"), F.first("_n").alias("_n"))
    lost = held.groupBy("_of", "_body").agg(F.sum("_n").alias("_lost"), F.collect_set("_key").alias("_keys"))
    lost = lost.withColumn("_pair", F.xxhash64("_of", "_body")).withColumnRenamed("_body", "_lost_body")
    lost = scratch.table(lost, "lost-lines")
    rows = slim.withColumn("_own_body", F.xxhash64(F.col("text")))
    rows = filters.flagged(rows, F.xxhash64(host, "_own_body"), lost.select("_pair"), "_maybe")
    found = ["_lost", "_keys"] if remove else ["_lost"]
    touched = (
        base_counts(rows.filter("_maybe"))
        .join(lost.select("_of", "_lost_body", *found), F.col(host).eqNullSafe(F.col("_of")) & (F.col("_own_body") == F.col("_lost_body")), "left")
        .drop("_of", "_lost_body")
    )
    judged = touched.unionByName(base_counts(rows.filter("not _maybe")), allowMissingColumns=True)
    judged = judged.withColumn("n_frequent_words", F.coalesce(F.col("_lost"), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (F.col("n_frequent_words") > 0) & (F.col("n_words") - F.col("n_frequent_words") < min_words)
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    if remove:
        rest = F.filter(
            F.split(F.col("text"), "\n"),
            lambda x: ~x.rlike(text.WORD) | ~F.array_contains(F.col("_keys"), F.xxhash64(text.normal_line(x))),
        )
        judged = judged.withColumn("text", F.when(F.col("_keys").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")))
    return carry.unpacked(judged, docs, needed, ADDED)
