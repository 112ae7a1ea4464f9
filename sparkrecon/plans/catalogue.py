"""Registered queries of the reconciliation engine, with their DuckDB counterparts.

The driver's tables stand in for the engine's: documents and conversations are files of pages, customer, part and
supplier are ledgers, orders and lineitem hold what was matched, events is the task stream, labels the truth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.functions import rules, similarity
from sparkrecon.functions import text as T
from sparkrecon.operators import ladders, matching, outputs, patterns, reports, rulings, segments, tables
from sparkrecon.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(c: Column) -> Column:
    """A name without its trailing digits and marks: what an identifier has besides its number."""
    return F.regexp_replace(c, "[^A-Za-z]+$", "")


RULES = [("th", "TH"), ("THe", "<the>"), ("ing", "ng"), ("de la", "dela")]


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, 'th', 'TH'), 'THe', '<the>'), 'ing', 'ng'), 'de la', 'dela')) AS corrected FROM documents")
def correct_fold(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.correct(F.col("text"), T.merge_rules(RULES, [("th", "never")]))).alias("corrected"))


@query("SELECT doc_id, translate(concat('（', doc_id, '）[', lang, ']【', source, '】'), '（）【】〔〕［］', '()[][][]') AS ascii, translate(concat(' （', doc_id, '）[', lang, '] '), '()（）[]【】［］ ', '〔〕〔〕〔〕〔〕〔〕') AS notice FROM documents")
def bracket_normalize(spark, sf_dir):
    made = F.concat(F.lit("（"), F.col("doc_id").cast("string"), F.lit("）["), F.col("lang"), F.lit("]"))
    return _t(spark, sf_dir, "documents").select("doc_id", T.ascii_brackets(F.concat(made, F.lit("【"), F.col("source"), F.lit("】"))).alias("ascii"), T.notice_key(F.concat(F.lit(" "), made, F.lit(" "))).alias("notice"))


@query(
    """SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\f\\x0B\\x{a0}]+|[ \\t\\r\\f\\x0B\\x{a0}]+$', '', 'g')), chr(10))) AS tidy,
       md5(replace(replace(text, chr(10), ''), ' ', '')) AS compact FROM documents"""
)
def whitespace_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.tidy(F.col("text"))).alias("tidy"), F.md5(T.compact(F.col("text"))).alias("compact"))


@query("SELECT doc_id, translate(concat('１２', lang, 'Ａｂ', source), '０１２３４５６７８９Ａｂ', '0123456789Ab') AS half FROM documents")
def halfwidth(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.halfwidth(F.concat(F.lit("１２"), F.col("lang"), F.lit("Ａｂ"), F.col("source"))).alias("half"))


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{3,}')) AS id FROM documents")
def id_extract(spark, sf_dir):
    ids = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("[0-9]{3,}"), F.lit(0)))
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(ids).alias("id"))


@query("SELECT concat(l_orderkey, '-', l_linenumber, '号') AS id, concat(l_orderkey, '号') AS root, count(*) AS n FROM lineitem GROUP BY ALL")
def id_root(spark, sf_dir):
    ids = _t(spark, sf_dir, "lineitem").select(F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit("号")).alias("id"))
    return ids.groupBy("id", T.notice_root(F.col("id")).alias("root")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, unnest(CASE WHEN to_no >= from_no AND to_no - from_no <= 20 THEN range(from_no, to_no + 1) ELSE [] END) AS number
       FROM (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS from_no, CAST(l_quantity AS BIGINT) AS to_no FROM lineitem)"""
)
def range_expand(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("a"), F.col("l_quantity").cast("long").alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.explode(T.expand_ranges(F.col("a"), F.col("b"))).alias("number"))


NUMBER_RULES = [rules.Rule("version", r"version ([0-9.]+)", 1.0), rules.Rule("year", r"([12][0-9]{3})", 0.9), rules.Rule("any", r"([0-9]+)", 0.8)]


@query(
    """WITH h AS (SELECT doc_id, r.ord AS ord, r.source AS source, r.w AS w, regexp_extract(text, r.p, 1) AS value, regexp_matches(text, r.p) AS hit
         FROM documents, (VALUES (0, 'version', 1.0, 'version ([0-9.]+)'), (1, 'year', 0.9, '([12][0-9]{3})'), (2, 'any', 0.8, '([0-9]+)')) r(ord, source, w, p)),
       q AS (SELECT *, CAST(w AS DOUBLE) * CASE WHEN length(value) < 3 THEN 0.5 WHEN length(value) > 100 THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence FROM h WHERE hit)
       SELECT doc_id, value, confidence, source FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord) = 1"""
)
def best_rule(spark, sf_dir):
    best = _t(spark, sf_dir, "documents").select("doc_id", rules.best_hit(F.col("text"), NUMBER_RULES).alias("hit")).filter("hit is not null")
    return best.select("doc_id", "hit.value", "hit.confidence", "hit.source")


@query(
    """SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, 'licensed') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS kind,
       contains(text, 'the') AND contains(text, 'and') AS main FROM documents"""
)
def doc_type_classify(spark, sf_dir):
    t = F.col("text")
    kind = F.when(T.hits(t, ["License", "licensed"]) > 0, "licence").when(F.contains(t, F.lit("@")), "contact").when(F.contains(t, F.lit("|")), "table").otherwise("prose")
    return _t(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), (T.hits(t, ["the", "and"]) == 2).alias("main"))


@query("SELECT doc_id, (contains(text, 'the')::INT + contains(text, 'und')::INT + contains(text, 'que')::INT + contains(text, 'License')::INT) AS evidence FROM documents WHERE contains(text, 'the')::INT + contains(text, 'und')::INT + contains(text, 'que')::INT + contains(text, 'License')::INT >= 2")
def secondary_evidence(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.hits(F.col("text"), ["the", "und", "que", "License"]).alias("evidence")).filter("evidence >= 2")


@query("SELECT doc_id, CASE WHEN contains(text, 'Released under') OR contains(text, 'All rights') THEN 'withdrawn' ELSE lang END AS result FROM documents")
def withdraw_override(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.when(T.hits(F.col("text"), ["Released under", "All rights"]) > 0, "withdrawn").otherwise(F.col("lang")).alias("result"))


@query("SELECT doc_id, CASE WHEN NOT contains(text, '.') THEN 'no_signal' WHEN n_chars < 100 THEN 'too_short' WHEN n_chars < 500 AND NOT contains(text, 'the') THEN 'weak_signal' ELSE '' END AS reason FROM documents")
def fallback_reason(spark, sf_dir):
    reason = F.when(~F.contains("text", F.lit(".")), "no_signal").when(F.col("n_chars") < 100, "too_short").when((F.col("n_chars") < 500) & ~F.contains("text", F.lit("the")), "weak_signal").otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))


@query("SELECT lang, CASE WHEN n_chars >= 500 THEN 'good' WHEN n_chars >= 200 THEN 'fair' ELSE 'poor' END AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def text_quality(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang", reports.quality_bucket(F.col("n_chars"), 500, 200).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey, CASE WHEN ends_with(p_name, 'ing') THEN left(p_name, length(p_name) - 3) WHEN ends_with(p_name, 'd') THEN left(p_name, length(p_name) - 1) WHEN ends_with(p_name, 'e') THEN left(p_name, length(p_name) - 1) ELSE p_name END AS core,
       concat_ws(',', CASE WHEN contains(p_name, 'ing') THEN 'ing' END, CASE WHEN contains(p_name, 'd') THEN 'd' END, CASE WHEN contains(p_name, 'e') THEN 'e' END) AS suffixes FROM part"""
)
def name_core_suffix(spark, sf_dir):
    name, suffixes = F.col("p_name"), ["ing", "d", "e"]
    return _t(spark, sf_dir, "part").select("p_partkey", T.company_core(name, suffixes).alias("core"), F.array_join(T.suffixes_in(name, suffixes), ",").alias("suffixes"))


@query(
    """SELECT conv_id, row_number() OVER w AS range_no, turn - 1 AS start, coalesce(lead(turn) OVER w - 1, last_turn) AS "end"
       FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def boundary_segments(spark, sf_dir):
    return segments.boundary_ranges(_t(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")


@query(
    """WITH s AS (SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations)
       SELECT conv_id, segment::BIGINT AS segment, count(*) AS n_pages, min(turn) AS first_page, max(turn) AS last_page FROM s GROUP BY ALL"""
)
def gaps_islands(spark, sf_dir):
    pages = segments.islands(_t(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return pages.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n_pages"), F.min("turn").alias("first_page"), F.max("turn").alias("last_page"))


@query(
    """SELECT conv_id, r AS range_no, (r - 1) * 2 AS start, r * 2 AS "end" FROM (SELECT conv_id, unnest(range(1, least(3, count(*) // 2) + 1)) AS r FROM conversations GROUP BY conv_id)"""
)
def fixed_segments(spark, sf_dir):
    files = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return segments.fixed_ranges(files, "conv_id", F.col("n"), F.lit(3), 2)


@query(
    """SELECT conv_id, turn, coalesce(lag(role = 'system') OVER w, false) OR coalesce(lead(role = 'system') OVER w, false) AS neighbour FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def neighbour_signal(spark, sf_dir):
    return segments.neighbours(_t(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "system").select("conv_id", "turn", "neighbour")


@query(
    """WITH p AS (SELECT conv_id, turn, min(CASE WHEN length(text) > 200 THEN turn END) OVER (PARTITION BY conv_id) AS hit, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
       SELECT conv_id, turn FROM p WHERE k <= 5 AND (hit IS NULL OR turn <= hit)"""
)
def first_hit_stop(spark, sf_dir):
    return segments.until_first_hit(_t(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") > 200, 5).select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant') DESC, turn) = 1")
def candidate_pick(spark, sf_dir):
    return segments.pick(_t(spark, sf_dir, "conversations"), "conv_id", [(F.col("role") == "assistant").desc(), F.col("turn")]).select("conv_id", "turn", "role")


@query(
    """SELECT conv_id, count(*) AS n_pages, sum(length(text))::BIGINT AS seconds, arg_max(turn, (length(text), -turn)) AS slowest FROM conversations GROUP BY conv_id"""
)
def slowest_page(spark, sf_dir):
    return reports.slowest(_t(spark, sf_dir, "conversations").withColumn("d", F.length("text")), "conv_id", "turn", "d")


def _probes(spark, sf_dir) -> DataFrame:
    """Order references as read: some with a sub-number, some with another bracket."""
    key = F.col("o_orderkey")
    read = F.when(key % 5 == 0, F.concat(F.lit("c（"), F.col("o_custkey").cast("string"), F.lit("）号"))).when(key % 5 == 1, F.concat(F.lit("c["), F.col("o_custkey").cast("string"), F.lit("]-3号"))).otherwise(F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", read.alias("read"))


def _ledger(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("c〔"), key.cast("string"), F.lit("〕号")).alias("c_notice"))


_PROBES_SQL = """p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN concat('c〔', o_custkey, '〕号') WHEN o_orderkey % 5 = 1 THEN concat('c〔', o_custkey, '〕-3号') ELSE concat('x', o_custkey) END AS norm FROM orders),
       l AS (SELECT c_custkey, c_nationkey, concat('c〔', c_custkey, '〕号') AS norm FROM customer)"""


@query(f"WITH {_PROBES_SQL} SELECT o_orderkey, c_custkey FROM p JOIN l USING (norm)")
def ledger_exact(spark, sf_dir):
    probes = _probes(spark, sf_dir).withColumn("k", T.notice_key(F.col("read")))
    ledger = _ledger(spark, sf_dir).withColumn("k", T.notice_key(F.col("c_notice")))
    return probes.join(ledger, "k").select("o_orderkey", "c_custkey")


def _leveled(spark, sf_dir) -> DataFrame:
    read, notice = T.notice_key(F.col("read")), T.notice_key(F.col("c_notice"))
    levels = [
        matching.Level("exact", read, notice),
        matching.Level("root", F.regexp_replace(read, r"-\d+号$", "号"), notice),
        matching.Level("number", F.regexp_extract(read, r"^x(\d+)$", 1), F.col("c_custkey").cast("string"), review=True, where=F.col("c_nationkey") < 10),
    ]
    return matching.leveled_join(_probes(spark, sf_dir), _ledger(spark, sf_dir), levels, "o_orderkey", "c_custkey")


@query(
    f"""WITH {_PROBES_SQL}, f AS (
         SELECT o_orderkey, c_custkey, 1 AS lv FROM p JOIN l USING (norm)
         UNION ALL SELECT o_orderkey, c_custkey, 2 FROM p JOIN l ON regexp_replace(p.norm, '-[0-9]+号$', '号') = l.norm
         UNION ALL SELECT o_orderkey, c_custkey, 3 FROM p JOIN l ON p.norm = concat('x', c_custkey) AND c_nationkey < 10),
       b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY lv, c_custkey) = 1)
       SELECT o_orderkey, c_custkey, lv AS match_level, CASE lv WHEN 1 THEN 'exact' WHEN 2 THEN 'root' WHEN 3 THEN 'number' END AS match_name, coalesce(lv = 3, true) AS needs_review FROM orders LEFT JOIN b USING (o_orderkey)"""
)
def ledger_leveled(spark, sf_dir):
    return _leveled(spark, sf_dir).select("o_orderkey", "c_custkey", "match_level", "match_name", "needs_review")


@query(
    """SELECT a.s_suppkey, b.c_custkey FROM supplier a JOIN customer b ON ends_with(b.c_custkey::VARCHAR, a.s_suppkey::VARCHAR) OR ends_with(a.s_suppkey::VARCHAR, b.c_custkey::VARCHAR) WHERE length(a.s_suppkey::VARCHAR) >= 2 AND length(b.c_custkey::VARCHAR) >= 2"""
)
def suffix_theta(spark, sf_dir):
    a = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("a"))
    b = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("b"))
    return matching.suffix_pairs(a, "a", b, "b", 2).select("s_suppkey", "c_custkey")


@query(
    """SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON length(s_suppkey::VARCHAR) = length(c_custkey::VARCHAR) AND hamming(s_suppkey::VARCHAR, c_custkey::VARCHAR) = 1
       QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_suppkey - c_custkey), c_custkey) = 1"""
)
def hamming_neighbour(spark, sf_dir):
    a = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("a"))
    b = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("b"))
    near = matching.substitution_neighbours(a, "a", b, "b")
    return segments.pick(near, "s_suppkey", [F.abs(F.col("s_suppkey") - F.col("c_custkey")), F.col("c_custkey")]).select("s_suppkey", "c_custkey")


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part)
       SELECT a.name AS probe, b.name AS found, levenshtein(a.name, b.name)::INT AS distance FROM n a JOIN n b ON a.name <> b.name
       QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY levenshtein(a.name, b.name), b.name) = 1"""
)
def fuzzy_topk(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return ladders.nearest(names, "name", names, "name")


@query()
def similarity_ratios(spark, sf_dir):
    """All pairs of part names that are similar, with both ratios: SQL has no block ratio, tests hold it against brute force."""
    names = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = ladders.ratio_pairs(names, "name", names, "name", 0.6)
    return pairs.select(F.col("a").alias("probe"), F.col("b").alias("found"), F.col("ratio").alias("block_ratio"), similarity.indel_ratio("a", "b").alias("indel_ratio"))


@query(
    """SELECT r_name, count(n_name) AS files FROM region LEFT JOIN nation ON contains(lower(n_name), lower(left(r_name, 2))) GROUP BY r_name"""
)
def keyword_files(spark, sf_dir):
    """Names against keywords by what they contain; keywords without a file stay."""
    words = _t(spark, sf_dir, "region").select("r_name", F.lower(F.left("r_name", F.lit(2))).alias("word"))
    names = _t(spark, sf_dir, "nation").select("n_name", F.lower("n_name").alias("lower"))
    held = patterns.contained(names, "n_name", "lower", words, "word")
    return words.join(held, "word", "left").groupBy("r_name").agg(F.count("key").alias("files"))


@query(
    """WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS range_no, turn - 1 AS s, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last_turn) AS e
         FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) WHERE role = 'user')
       SELECT c.conv_id, range_no, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, count(*) AS n_pages FROM conversations c JOIN r ON c.conv_id = r.conv_id AND turn > s AND turn <= e GROUP BY c.conv_id, range_no"""
)
def range_join_pages(spark, sf_dir):
    pages = _t(spark, sf_dir, "conversations")
    ranges = segments.boundary_ranges(pages, "conv_id", "turn", F.col("role") == "user")
    return segments.pages_in_ranges(pages, ranges, "conv_id", "turn", "text").select("conv_id", "range_no", F.md5("range_text").alias("text_md5"), "n_pages")


@query(
    """WITH m AS (SELECT s_suppkey, c_custkey, s_suppkey = c_custkey AS i, true AS n, s_suppkey % 7 = c_custkey % 7 AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 500) = floor(c_acctbal / 500)),
       k AS (SELECT *, sum(i::INT) OVER w AS ids, sum(n::INT) OVER w AS names, sum((n AND c)::INT) OVER w AS n_both FROM m WINDOW w AS (PARTITION BY s_suppkey))
       SELECT s_suppkey, c_custkey FROM k WHERE CASE WHEN ids > 0 THEN i WHEN n_both > 0 THEN n AND c WHEN names > 0 THEN n AND names <= 3 ELSE c END"""
)
def cascade_match(spark, sf_dir):
    a, b = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "customer")
    step = lambda c: F.floor(F.col(c) / 500)
    pairs = a.join(b, (F.col("s_nationkey") == F.col("c_nationkey")) & (step("s_acctbal") == step("c_acctbal")))
    found = matching.cascade(pairs, "s_suppkey", F.col("s_suppkey") == F.col("c_custkey"), F.lit(True), F.col("s_suppkey") % 7 == F.col("c_custkey") % 7)
    return found.select("s_suppkey", "c_custkey")


@query("SELECT c_custkey, c_name, 'no order' AS reason FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01') ORDER BY c_custkey LIMIT 80")
def anti_unmatched(spark, sf_dir):
    late = _t(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return tables.unmatched(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), late, "c_custkey", "no order", [F.col("c_custkey")], 80)


@query(
    """SELECT DISTINCT id FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{2,}')) AS id FROM documents) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey::VARCHAR = id)"""
)
def source_only(spark, sf_dir):
    ids = _t(spark, sf_dir, "documents").select(F.explode_outer(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0))).alias("id")).filter("id is not null").distinct()
    return ids.join(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id")), "id", "left_anti")


@query(
    """WITH u AS (SELECT o_custkey AS c_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS c_mktsegment FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
       SELECT c.c_custkey, c.c_name, coalesce(nullif(u.c_mktsegment, ''), c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN u USING (c_custkey)"""
)
def write_back(spark, sf_dir):
    updates = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("c_mktsegment"))
    last = tables.one_per_key(updates, ["c_custkey"], [F.col("o_orderkey").desc()])
    return tables.write_back(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), last, "c_custkey", ["c_mktsegment"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_wins(spark, sf_dir):
    return tables.one_per_key(_t(spark, sf_dir, "events"), ["user_id"], [F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query(
    """WITH c AS (SELECT user_id, max(ts) AS seen, count(*) AS n FROM events GROUP BY user_id), live AS (SELECT user_id, n FROM c WHERE date_diff('day', seen::DATE, DATE '2024-01-31') < 3),
       fresh AS (SELECT user_id, -1::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 4 = 0))
       SELECT user_id, n FROM fresh UNION ALL SELECT user_id, n FROM live WHERE user_id NOT IN (SELECT user_id FROM fresh)"""
)
def cache_union(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    cache = events.groupBy("user_id").agg(F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"))
    live = tables.unexpired(cache, "at", F.lit("2024-01-31").cast("date"), 3).select("user_id", "n")
    fresh = events.filter("user_id % 4 = 0").select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("n"))
    return tables.union_by_priority([fresh, live], "user_id")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def insert_or_ignore(spark, sf_dir):
    known = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tables.insert_or_ignore(known, _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id")


def _statuses(spark, sf_dir) -> DataFrame:
    found = _leveled(spark, sf_dir)
    level = F.coalesce("match_level", F.lit(0))
    status = reports.notice_status(F.lit(1), F.col("o_orderkey") % 11 != 0, level == 1, level == 2, F.when(level == 3, 0.9).otherwise(0.1))
    return found.select("o_orderkey", "o_orderpriority", status.alias("s")).select("o_orderkey", "o_orderpriority", "s.status", "s.category")


_STATUS_SQL = f"""WITH {_PROBES_SQL}, k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND c_custkey IS NOT NULL THEN 1 WHEN o_orderkey % 5 = 1 AND c_custkey IS NOT NULL THEN 2 WHEN o_orderkey % 5 > 1 AND c_nationkey < 10 THEN 3 ELSE 0 END AS lv FROM p LEFT JOIN customer ON o_custkey = c_custkey),
       s AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'FAIL' WHEN lv = 2 THEN 'WARNING' WHEN lv = 1 THEN 'PASS' WHEN lv = 3 THEN 'WARNING' ELSE 'FAIL' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'ocr_failure' WHEN lv = 2 THEN 'basis_mismatch' WHEN lv = 1 THEN '' WHEN lv = 3 THEN 'fuzzy_mapping' ELSE 'heuristic_mismatch' END AS category FROM k)"""


@query(f"{_STATUS_SQL} SELECT status, category, count(*) AS n FROM s GROUP BY ALL")
def notice_statuses(spark, sf_dir):
    return _statuses(spark, sf_dir).groupBy("status", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{_STATUS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARNING') AS warnings, count(*) FILTER (status = 'FAIL') AS failed, coalesce((count(*) FILTER (status = 'PASS'))::DOUBLE / nullif(count(*), 0), 0.0) AS pass_rate FROM s"""
)
def status_summary(spark, sf_dir):
    return reports.status_summary(_statuses(spark, sf_dir), "status")


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS total, min(length(text)) AS least, max(length(text)) AS most, avg(length(text)) AS mean FROM conversations WHERE length(text) > 0 GROUP BY role")
def timing_stats(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumn("d", F.length("text").cast("long"))
    return reports.timing(rows, "role", "d")


@query(
    f"""WITH {_PROBES_SQL}, j AS (SELECT o_orderkey, c_custkey FROM p LEFT JOIN l USING (norm))
       SELECT count(DISTINCT o_orderkey) AS probes, count(DISTINCT CASE WHEN c_custkey IS NOT NULL THEN o_orderkey END) AS matched, count(DISTINCT c_custkey) AS rows_matched,
       coalesce(round(count(DISTINCT CASE WHEN c_custkey IS NOT NULL THEN o_orderkey END) * 100.0::DOUBLE / nullif(count(DISTINCT o_orderkey), 0), 1), 0.0) AS match_rate FROM j"""
)
def match_stats(spark, sf_dir):
    probes = _probes(spark, sf_dir).withColumn("k", T.notice_key(F.col("read")))
    ledger = _ledger(spark, sf_dir).withColumn("k", T.notice_key(F.col("c_notice")))
    return reports.match_stats(probes.join(ledger, "k", "left"), "o_orderkey", "c_custkey")


@query("SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def batch_rollup(spark, sf_dir):
    return _t(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id::VARCHAR AS original, event_type AS corrected, 0.95::DOUBLE AS confidence FROM events GROUP BY ALL HAVING count(*) >= 3 AND avg((value > 10)::INT) > 0.7")
def rule_promotion(spark, sf_dir):
    tried = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("original"), F.col("event_type").alias("corrected"), (F.col("value") > 10).alias("success"))
    return rulings.learned(tried, 3, 0.7).withColumn("confidence", F.col("confidence").cast("double"))


@query("SELECT count(*) AS files, sum((quality = (n_chars >= 500)::INT)::INT)::BIGINT AS matched, round(avg((quality = (n_chars >= 500)::INT)::INT), 4) AS rate FROM documents JOIN labels USING (doc_id)")
def quality_eval(spark, sf_dir):
    same = (F.col("quality") == (F.col("n_chars") >= 500).cast("int")).cast("int")
    joined = _t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_t(spark, sf_dir, "labels"), "doc_id")
    return joined.agg(F.count(F.lit(1)).alias("files"), F.sum(same).alias("matched"), F.round(F.avg(same), 4).alias("rate"))


@query(
    """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer)
       SELECT c_custkey, concat_ws(',', CASE WHEN name = '' THEN 'name' END, CASE WHEN segment IS NULL THEN 'segment' END) AS missing, CASE WHEN name = '' AND segment IS NULL THEN 'failed' WHEN name = '' OR segment IS NULL THEN 'warning' ELSE 'success' END AS status FROM r"""
)
def completeness_status(spark, sf_dir):
    key = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(key % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("segment"))
    return tables.completeness(rows, ["name", "segment"]).select("c_custkey", "missing", "status")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'error' ELSE 'ok' END AS envelope FROM events")
def json_envelope(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(k.try_cast("long"), F.lit(-1)).alias("k"), F.when(k.isNull(), "error").otherwise("ok").alias("envelope"))


REGIONS = ("EUROPE", "ASIA", "AMERICA")


@query("SELECT n_name, r_name, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'AMERICA' THEN 3 ELSE 99 END, n_name) AS position FROM nation JOIN region ON n_regionkey = r_regionkey")
def region_rank_sort(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", outputs.region_rank(F.col("r_name"), REGIONS).alias("rank"))
    return outputs.numbered(rows, [F.col("rank"), F.col("n_name")], "position").select("n_name", "r_name", "position")


@query("SELECT p_partkey, concat(lower(p_brand), '-', lpad(p_size::VARCHAR, 12, '0')) AS key FROM (SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '', 'g') AS p_brand, p_size FROM part)")
def natural_sort(spark, sf_dir):
    name = F.concat(F.regexp_replace("p_brand", "[0-9]+", ""), F.lit("-"), F.col("p_size").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", T.natural_key(name).alias("key"))


@query()
def greedy_assign(spark, sf_dir):
    pages, targets = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "customer")
    pairs = pages.join(targets, F.col("s_nationkey") == F.col("c_nationkey")).filter(F.abs(F.col("s_acctbal") - F.col("c_acctbal")) < 300).select("s_nationkey", "s_suppkey", "c_custkey", F.abs(F.col("s_acctbal") - F.col("c_acctbal")).alias("apart"))
    return matching.assign_one_to_one(pairs, "s_nationkey", "s_suppkey", "c_custkey", [F.col("s_suppkey"), F.col("apart"), F.col("c_custkey")])


@query(
    """WITH a AS (SELECT user_id, count(*) AS attempts, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id)
       SELECT user_id, attempts, last, CASE WHEN last = 'error' AND attempts > 60 THEN 'permanent' WHEN last = 'error' THEN 'retry' WHEN last = 'purchase' THEN 'done' ELSE 'pending' END AS state FROM a"""
)
def retry_queue(spark, sf_dir):
    return queue.states(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type", failed="error", done="purchase", most=60)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return queue.tumbling(_t(spark, sf_dir, "events"), "ts", "1 hour", "event_type", "value")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_session(spark, sf_dir):
    return queue.sessions(_t(spark, sf_dir, "events"), "ts", "30 minutes", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@query("SELECT k, 'both' AS side FROM ((SELECT c_nationkey AS k FROM customer) INTERSECT (SELECT s_nationkey FROM supplier)) UNION ALL SELECT k, 'left' FROM ((SELECT c_custkey AS k FROM customer) EXCEPT (SELECT o_custkey FROM orders))")
def set_ops(spark, sf_dir):
    a, b = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    both = a.select(F.col("c_nationkey").cast("long").alias("k")).intersect(b.select(F.col("s_nationkey").cast("long")))
    left = a.select(F.col("c_custkey").alias("k")).subtract(_t(spark, sf_dir, "orders").select("o_custkey"))
    return both.withColumn("side", F.lit("both")).union(left.withColumn("side", F.lit("left")))


@query("SELECT event_id, k, v FROM (SELECT event_id, unnest(['type', 'user']) AS k, unnest([event_type, user_id::VARCHAR]) AS v FROM events)")
def audit_map(spark, sf_dir):
    detail = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", F.explode(detail).alias("k", "v"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_leveled(spark, sf_dir)
