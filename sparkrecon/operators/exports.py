"""Output files of a run: names that never clash, files and pages to their targets, and what has to be looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecon.functions import documents as D
from sparkrecon.functions import text as T
from sparkrecon.operators import ladders, matching, rulings, tables
from sparkrecon.operators.outputs import numbered
from sparkrecon.operators.store import shuffled, written

# Parts of the names of files that have to be looked at, and the marks of the kinds of output.
LOOK, SEEN, UNMATCHED, UNREAD, BY = "需人工核查", "识别到", "未匹配台账", "未识别到责令号", "匹配方式"
MISSING, NO_COMPANY = "台账缺失", "未识别到公司名"
NOTICE, APPLICATION = "责催", "申请书pdf"


def _split(name: str) -> tuple[Column, Column]:
    ending = F.regexp_extract(name, r"[^./](\.[^./]*)$", 1)
    return F.left(F.col(name), F.length(name) - F.length(ending)), ending


def unique_names(rows: DataFrame, name: str, order: Sequence[Column], taken: DataFrame | None = None, joint: str = "-") -> DataFrame:
    """name made unique: a row keeps its name if no earlier row (by order, which should be total) has it, else it gets -1, -2, ...

    taken (name): names that are there already. The numbers are those that rows get one after the other: the least that is
    free. All rows ask at once, a row first for the number of earlier rows of its name. Where two ask for one name, the
    earlier has it and the later, with the rows of its name after it, asks for the next: as many rounds as such names are
    chained. Null names stay null.
    """
    columns = rows.columns
    placed = numbered(rows.withColumn("_name", F.col(name)), [F.col("_name"), *order], "_n")
    first = placed.groupBy(F.col("_name").alias("_of")).agg(F.min("_n").alias("_first"))
    placed = numbered(placed.join(first, F.col("_name") == F.col("_of"), "left"), list(order), "_o").withColumn("_rank", F.coalesce(F.col("_n") - F.col("_first"), F.lit(0)))
    stem, ending = _split("_name")
    state = written(placed.drop("_n", "_of", "_first").withColumn("_at", F.col("_rank")))
    held = None if taken is None else written(taken.select(F.col(taken.columns[0]).alias("_held")).distinct())
    while True:
        asked = state.withColumn("_asked", F.when(F.col("_at") == 0, F.col("_name")).otherwise(F.concat(stem, F.lit(joint), F.col("_at").cast("string"), ending)))
        rivals = asked.groupBy(F.col("_asked").alias("_held")).agg(F.min("_o").alias("_least"), F.count(F.lit(1)).alias("_k")).filter("_k > 1 and _held is not null")
        lost = asked.join(rivals, (F.col("_asked") == F.col("_held")) & (F.col("_o") > F.col("_least"))).select("_name", "_o")
        if held is not None:
            lost = lost.unionByName(asked.join(held, F.col("_asked") == F.col("_held"), "left_semi").select("_name", "_o")).distinct()
        lost = written(lost)
        if lost.isEmpty():
            return asked.select(*[F.col("_asked").alias(c) if c == name else c for c in columns])
        names = lost.select(F.col("_name").alias("_of")).distinct()
        moved = state.join(names, F.col("_name") == F.col("_of"), "left_semi").join(lost.select(F.col("_o").alias("_lost")), F.col("_o") == F.col("_lost"), "left")
        moved = moved.withColumn("_at", F.col("_at") + F.col("_lost").isNotNull().cast("int")).drop("_lost")
        up = F.max(F.col("_at") - F.col("_rank")).over(Window.partitionBy("_name").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
        state = written(state.join(names, F.col("_name") == F.col("_of"), "left_anti").unionByName(moved.withColumn("_at", up + F.col("_rank"))))


def _safe(c: Column) -> Column:
    return F.translate(c, "/\\", "__")


def notice_exports(sources: DataFrame, cases: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Stand-alone notices to the ledger's names: a row a source with target_notice, match_type, same_root_remap, folder and name.

    sources: source (unique), detected (the identifier after correction), selected (as it was read, null for the same). cases: row_no,
    sequence, notice_number; of equal identifiers the last row counts. A target is the detected identifier's, else its base
    number's, else the most similar of the base number (fuzzy, to be looked at). Of another number of one base, what was read is put into
    the name. Sources without a target go to the folder to look at, under their own name.
    """
    targets = tables.one_per_key(cases.withColumn("_k", T.notice_key(F.col("notice_number"))).filter("_k <> ''"), ["_k"], [F.col("row_no").desc()]).select(F.col("row_no").alias("_row"), "sequence", "notice_number", "_k")
    read = sources.select("*", T.notice_key(F.col("detected")).alias("_d"))
    levels = [matching.Level("exact", F.col("_d"), F.col("_k")), matching.Level("same_root_base", T.notice_root(F.col("_d")), F.col("_k"))]
    found = written(matching.leveled_join(read, targets, levels, "source", "_row"))
    close = ladders.root_ratio(found.filter("_k is null"), "_d", targets, "_k", "_row").select(F.col("probe").alias("_p"), F.col("row_no").alias("_c"))
    close = close.join(targets.select(F.col("_row").alias("_c"), F.col("sequence").alias("_seq"), F.col("notice_number").alias("_num")), "_c").drop("_c")
    open_ = F.col("_k").isNull()
    all_ = found.join(close, open_ & (F.col("_d") == F.col("_p")), "left")
    all_ = all_.withColumn("sequence", F.coalesce("sequence", "_seq")).withColumn("target_notice", F.coalesce("notice_number", "_num"))
    all_ = all_.withColumn("match_type", F.when(~open_, F.col("match_name")).when(F.col("_num").isNotNull(), "fuzzy").otherwise("unmatched"))
    target = T.notice_key(F.col("target_notice"))
    remap = F.coalesce((target != F.col("_d")) & (T.notice_root(target) == T.notice_root(F.col("_d"))), F.lit(False))
    plain = F.concat(F.col("sequence"), F.lit(f"-{NOTICE}-"), F.col("target_notice"), F.lit(".pdf"))
    selected = F.coalesce("selected", "detected")
    shown = F.when(remap & (selected != target), rulings.with_detected(plain, _safe(selected))).otherwise(plain)
    stem = F.regexp_replace("source", r"\.[^.]*$", "")
    bad = F.concat(stem, F.lit(f"_{SEEN}["), _safe(F.coalesce(F.nullif(F.col("detected"), F.lit("")), F.lit("未识别"))), F.lit(f"]_{LOOK}.pdf"))
    out = all_.select(*sources.columns, "target_notice", "match_type", remap.alias("same_root_remap"), F.when(F.col("target_notice").isNull(), LOOK).otherwise(NOTICE).alias("folder"), F.when(F.col("target_notice").isNull(), bad).otherwise(shown).alias("name"))
    good = unique_names(out.filter(F.col("folder") == NOTICE), "name", [F.col("source")], taken)
    return good.unionByName(unique_names(out.filter(F.col("folder") == LOOK), "name", [F.col("source")], None, "_"))


def application_exports(found: DataFrame, label: str = "申请书") -> DataFrame:
    """Ranges of an application file to names: folder and name, and the audit's event for those to be looked at.

    found: file, start, end (pages after start, to end), target_name (null for none), read_as (the identifier, null for none), source
    (how it was matched) and needs_review, as text_ladder gives them. Names to look at say pages, identifier and level.
    """
    pages = F.concat(F.lit(f"{label}_第"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("页_"))
    seen = F.concat(F.lit(f"{SEEN}["), _safe(F.col("read_as")), F.lit("]_"))
    matched, read = F.col("target_name").isNotNull(), F.col("read_as").isNotNull()
    sure = matched & ~F.coalesce("needs_review", F.lit(True))
    name = (
        F.when(sure, F.col("target_name")).when(matched, F.concat(pages, seen, F.lit(f"{BY}["), F.col("source"), F.lit(f"]_{LOOK}.pdf")))
        .when(read, F.concat(pages, seen, F.lit(f"{UNMATCHED}_{LOOK}.pdf"))).otherwise(F.concat(pages, F.lit(f"{UNREAD}_{LOOK}.pdf")))
    )
    event = F.when(sure, F.lit(None).cast("string")).when(matched, "application_needs_review").when(read, "application_unmatched").otherwise("application_unknown")
    out = found.withColumn("folder", F.when(sure, label).otherwise(LOOK)).withColumn("name", name).withColumn("event", event)
    return unique_names(out, "name", [F.col("folder"), F.col("file"), F.col("start")])


def company_exports(pages: DataFrame, targets: DataFrame, file: str, page: str, text: str, doc_type: str) -> DataFrame:
    """Pages of a file of companies to the targets' names (file, target_no, target): target_no, folder, name and the audit's event.

    In page order, each target once. Pages whose company has no free target are missing in the ledger, others unread: both
    are to be looked at.
    """
    read = written(pages.select(file, page, D.target_company(F.col(text)).alias("company")))
    pairs = ladders.company_pairs(read, "company", targets, "target", "target_no").join(shuffled(targets.select("target_no", F.col(file).alias("_file"), F.col("target").alias("_target"))), "target_no")
    pairs = read.join(shuffled(pairs), (F.col("company") == F.col("name")) & (F.col(file) == F.col("_file"))).select(file, page, "target_no", "rank", "_target")
    given = matching.assign_one_to_one(pairs, file, page, "target_no", [F.col(page), F.col("rank")]).select(file, page, "target_no", "_target")
    joined = read.join(shuffled(given), [file, page], "left")
    at = F.concat(F.lit(f"{doc_type}_第"), F.col(page).cast("string"), F.lit("页_"))
    missing = F.concat(at, F.lit(f"{SEEN}["), _safe(F.col("company")), F.lit(f"]_{MISSING}_{LOOK}.pdf"))
    matched, seen = F.col("target_no").isNotNull(), F.col("company").isNotNull()
    return joined.select(
        file, page, "company", "target_no", F.when(matched, doc_type).otherwise(LOOK).alias("folder"),
        F.when(matched, F.col("_target")).when(seen, missing).otherwise(F.concat(at, F.lit(f"{NO_COMPANY}_{LOOK}.pdf"))).alias("name"),
        F.when(matched, "company_name_match").when(seen, "company_name_unmatched").otherwise("company_name_unknown").alias("event"),
    )
