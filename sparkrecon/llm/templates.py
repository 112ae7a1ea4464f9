"""Line deduplication by a log-template tree: lines of one shape that recur across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import carry, filters, scratch, text

ANY = "<*>"
#: A word with a digit. It begins at a word's beginning and never backtracks, so long words cost their length.
_NUMBERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _shape(line: Column) -> Column:
    """The line's words, one space between them, those with digits as <*>. Plain lines are only looked through."""
    line = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _NUMBERED, ANY)).otherwise(line)
    return F.trim(F.when(line.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(line, text.SPACE, " ")).otherwise(line))


def _lines(docs: DataFrame) -> DataFrame:
    """One row a line with a word: the text's hash and the line's shape."""
    found = docs.select(F.xxhash64("text").alias("body"), F.explode(F.split(F.col("text"), "\n")).alias("line"))
    # a generator, so that the shape is worked out once a line
    found = found.select("body", F.explode(F.array(_shape(F.col("line")))).alias("shape"))
    return found.filter("shape <> ''")


def _n_tokens() -> Column:
    shape = F.col("shape")
    return F.length(shape) - F.length(F.replace(shape, F.lit(" "), F.lit(""))) + 1


def _leaf(depth: int) -> Column:
    """The leaf a line comes to: its number of tokens, then its leading tokens."""
    return F.xxhash64(_n_tokens() - 1, F.substring_index("shape", " ", depth))


def recurring(
    docs: DataFrame, least: int, depth: int = 2, fixed: float = 0.7, long_words: int | None = None, variable: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Lines (leaf, shape, body; shape and body hashed) and the shapes (shape, template, single) whose template recurs.

    A line goes down the tree by its number of tokens and its first depth tokens. In the leaf, a token at a place
    is fixed if lines in over the limit of documents have it there, and any other is generalised to <*>. Lines with
    the same fixed tokens are of one template; it recurs if at least the fixed share of its tokens is fixed
    and over the limit of documents hold it. The limit is a count of documents, the same at any size of the table.
    With long_words, a line of so many words or more recurs, too, if two
    documents hold its shape; it is single if nothing else makes it recur. With variable, templates of many fields count, too: two fixed tokens or
    more that are the fixed share of the tokens without digits, or eight that are half of all tokens. Leaves that no
    recurring template can be in are left out first: a template has no more documents than its leaf. A leaf's
    fixed tokens are a short list (each takes over the limit of documents), so they meet a shape in one row.
    """
    limit = F.lit(least)
    long = _n_tokens() >= long_words if long_words else F.lit(False)
    seen = scratch.table(
        _lines(docs).select("body", _leaf(depth).alias("leaf"), F.xxhash64("shape").alias("shape"), long.alias("long")).groupBy("leaf", "shape", "body", "long").count().select("leaf", "shape", "body", "long"), "lines"
    )
    leaves = seen.groupBy("leaf", "body").count().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > limit)
    leaves = scratch.broadcast_if_small(scratch.table(leaves.select(F.col("leaf").alias("wanted")), "leaves"))
    counts = seen.join(leaves, F.col("leaf") == F.col("wanted"), "left_semi").groupBy("leaf", "shape").agg(F.count(F.lit(1)).alias("docs"))
    texts = _lines(docs).select(_leaf(depth).alias("leaf"), F.xxhash64("shape").alias("_shape"), "shape").join(leaves, F.col("leaf") == F.col("wanted"), "left_semi")
    texts = texts.groupBy("_shape").agg(F.first("shape").alias("words"))
    shapes = scratch.table(counts.join(texts, F.col("shape") == F.col("_shape")).select("leaf", "shape", "docs", F.split("words", " ").alias("tokens")), "shapes")
    placed = F.transform("tokens", lambda x, i: F.when(x != ANY, F.concat(i.cast("string"), F.lit(" "), x)))
    lead = shapes.groupBy("leaf").agg(F.max_by("tokens", F.struct("docs", "shape")).alias("_lead"), F.sum("docs").alias("_all"))
    lead = scratch.table(lead.withColumnRenamed("leaf", "_leaf"), "leads")
    # Only what differs from the leaf's most frequent line is taken apart; what agrees with it is the rest of the leaf.
    others = F.filter(
        F.transform("tokens", lambda x, i: F.when(x != F.get(F.col("_lead"), i), F.struct(i.alias("place"), x.alias("token")))), lambda x: x.isNotNull()
    )
    apart = shapes.join(lead, F.col("leaf") == F.col("_leaf")).select("leaf", "docs", F.explode(others).alias("x"))
    apart = scratch.table(apart.groupBy("leaf", "x.place", "x.token").agg(F.sum("docs").alias("held")), "other-tokens")
    known = apart.filter((F.col("token") != ANY) & (F.col("held") > limit)).select("leaf", "place", "token")
    away = apart.groupBy(F.col("leaf").alias("_l"), F.col("place").alias("_p")).agg(F.sum("held").alias("_away"))
    own = lead.select(F.col("_leaf").alias("leaf"), "_all", F.posexplode("_lead").alias("place", "token"))
    own = own.join(away, (F.col("leaf") == F.col("_l")) & (F.col("place") == F.col("_p")), "left")
    own = own.filter((F.col("token") != ANY) & (F.col("_all") - F.coalesce("_away", F.lit(0)) > limit)).select("leaf", "place", "token")
    known = known.unionByName(own).groupBy(F.col("leaf").alias("_leaf")).agg(F.collect_list(F.concat(F.col("place").cast("string"), F.lit(" "), "token")).alias("_fixed"))
    known = scratch.table(known, "fixed-tokens")
    plain = F.size(F.filter("tokens", lambda x: x != ANY)).alias("plain")
    kept = shapes.join(known, F.col("leaf") == F.col("_leaf")).select("leaf", "shape", F.size("tokens").alias("n"), plain, F.array_intersect(placed, F.col("_fixed")).alias("parts"))
    parts = F.size("parts")
    enough = parts >= fixed * F.col("n")
    if variable:
        enough = enough | ((parts >= 2) & (parts >= fixed * F.col("plain"))) | ((parts >= 8) & (parts >= 0.5 * F.col("n")))
    generalised = kept.filter(enough).select(F.col("shape").alias("_of"), F.xxhash64("leaf", "parts").alias("template"))
    generalised = scratch.table(generalised, "templates")
    held = seen.join(generalised, F.col("shape") == F.col("_of")).select("template", "body")
    often = held.groupBy("template", "body").count().groupBy("template").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > limit)
    found = generalised.join(often, "template", "left_semi").select(F.col("_of").alias("shape"), "template", F.lit(False).alias("single"))
    if long_words:
        twice = seen.filter("long").groupBy("shape").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1")
        found = found.unionByName(twice.select("shape", F.col("shape").alias("template"), F.lit(True).alias("single")))
        found = found.groupBy("shape").agg(F.min_by("template", "single").alias("template"), F.min("single").alias("single"))
    return seen.drop("long"), found


def _keepers(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """For each template that may not go altogether, the document (_t, _b) with the least id that holds it.

    ids: _id, _at (body) and _little (little of it would be left) of the documents that are touched. A single line
    stays once, any other once if it is in a document of which little would be left.
    """
    ids = ids.groupBy("_at").agg(F.min("_id").alias("_id"), F.first("_little").alias("_little"))
    held = lines.join(ids.hint("merge"), F.col("body") == F.col("_at")).filter(F.col("single") | F.col("_little"))
    least = held.groupBy("template").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "body")).alias("_least"))
    return least.select(F.col("template").alias("_t"), F.col("_least.body").alias("_b"))


def drop_templates(
    docs: DataFrame, least: int = 20, depth: int = 2, fixed: float = 0.7, long_words: int | None = None, variable: bool = False,
    hollow: float | None = None, doc_id: str = "doc_id",
) -> DataFrame:
    """Take the lines of recurring templates out of the texts of docs (text, ...); all rows and columns come back.

    Adds n_lines (lines with a word) and n_dropped. Copies of a text count as one document. Null and wordless texts have
    no lines and stay; a text that is all templates becomes empty. With hollow, of the documents that would lose over
    that share of their words, a template's lines stay in that of the least doc_id. A line of long_words (which needs
    hollow) goes if only two documents hold it, but stays in that of the least doc_id. An added column takes
    the place of an input column of its name; other columns are carried whatever their names. Only rows that may hold
    a recurring line are shuffled (filters.flagged). Texts, shapes and leaves are compared by 64-bit hash: among 10^10
    different ones, about three pairs are taken for one.
    """
    assert hollow is not None or not long_words
    needed = ["text"] if hollow is None else ["text", doc_id]
    slim = carry.packed(docs, needed)
    seen, found = recurring(slim, least, depth, fixed, long_words, variable)
    found = scratch.table(found.withColumnRenamed("shape", "_recurs"), "recurring")
    lines = scratch.table(seen.join(found, F.col("shape") == F.col("_recurs")).select("shape", "body", "template", "single"), "recurring-lines")
    held = scratch.table(lines.groupBy("body").agg(F.collect_set("shape").alias("_shapes")).withColumnRenamed("body", "_at"), "held")
    own = filters.flagged(slim.withColumn("_own", F.xxhash64("text")), F.col("_own"), held.select("_at"), "_maybe")
    rest = F.filter(
        F.split(F.col("text"), "\n"),
        lambda x: ~(x.rlike(text.WORD)) | ~F.array_contains(F.col("_shapes"), F.xxhash64(_shape(x))),
    )
    if hollow is not None:
        ids = own.filter("_maybe").select(F.col(doc_id).alias("_id"), "text", "_own").join(held.hint("merge"), F.col("_own") == F.col("_at"))
        little = text.n_words(F.array_join(rest, "\n")) < (1 - hollow) * text.n_words(F.col("text"))
        keepers = _keepers(ids.select("_id", "_at", little.alias("_little")), lines)
        lines = lines.join(keepers.hint("merge"), (F.col("template") == F.col("_t")) & (F.col("body") == F.col("_b")), "left_anti")
        held = scratch.table(lines.groupBy("body").agg(F.collect_set("shape").alias("_shapes")).withColumnRenamed("body", "_at"), "touched")
    # merged at any size: what shares lines grows with the documents
    touched = own.filter("_maybe").join(held.hint("merge"), F.col("_own") == F.col("_at"), "left").drop("_at")
    joined = touched.unionByName(own.filter("not _maybe"), allowMissingColumns=True)
    worded = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(text.WORD)))
    out = joined.withColumn("_rest", F.when(F.col("_shapes").isNotNull(), F.array_join(rest, "\n")))
    left = F.size(F.filter(F.split(F.col("_rest"), "\n"), lambda x: x.rlike(text.WORD)))
    out = out.withColumn("_n_lines", worded.cast("long")).withColumn("_n_dropped", F.when(F.col("_rest").isNotNull(), worded - left).otherwise(0).cast("long"))
    out = out.withColumn("text", F.coalesce("_rest", "text")).withColumnRenamed("_n_lines", "n_lines").withColumnRenamed("_n_dropped", "n_dropped")
    return carry.unpacked(out, docs, needed, ["n_lines", "n_dropped"])
