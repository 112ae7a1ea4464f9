"""Spelling variants: words one edit apart, by a distance-one automaton run depth-first over compact trie shards."""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import scratch, text

#: A shard holds so many words and characters at most (one word at least); a round broadcasts so many bytes of shards (one at least).
SHARD_WORDS, SHARD_CHARS, ROUND_BYTES = 1 << 16, 1 << 20, 32 << 20


def trie(words: list[str], counts: list[int]) -> tuple:
    """A trie of sorted different words: (words, counts, labels, first, word).

    Nodes are numbered level by level, so a node's children are first[k] to first[k + 1], ordered by labels[k], the
    character that leads to them. word[k] is the word that ends at the node, or that is alone below it; else -1.
    """
    labels, first, word, todo = ["\0"], array("q"), array("q"), [(0, len(words), 0)]
    for lo, hi, depth in todo:
        first.append(len(todo))
        if hi - lo == 1:
            word.append(lo)
            continue
        ends = lo < hi and len(words[lo]) == depth
        word.append(lo if ends else -1)
        lo += ends
        while lo < hi:
            c = words[lo][depth]
            end = hi if c == "\U0010ffff" else bisect_left(words, words[lo][:depth] + chr(ord(c) + 1), lo, hi)
            labels.append(c)
            todo.append((lo, end, depth + 1))
            lo = end
    first.append(len(todo))
    return words, counts, "".join(labels), first, word


class Descent:
    """The shard's words that are one insertion, deletion or replacement away from a word, for words in sorted order.

    The word's automaton goes down the trie depth-first. While nothing differs one node is open a depth (exact). After the
    edit up to three places in the word are: the last read character was inserted (place depth - 1, flag 1), it is a
    replacement (depth, 2), or follows a deletion (depth + 1, 4). side[d] has the nodes at depth d with their flags; it
    depends on the first d + 1 characters only, so words that begin alike share the descent. Any order gives the same.
    """

    def __init__(self, shard: tuple):
        self.words, self.counts, self.labels, self.first, self.word = shard
        self.exact: list[int] = [0]
        self.side: list[list[tuple[int, int]]] = [[]]

    def near(self, w: str, alike: int) -> list[int]:
        """Numbers of the words near w; alike: how many characters w begins with that the word before began with."""
        words, labels, first, word, exact, side = self.words, self.labels, self.first, self.word, self.exact, self.side
        m, d = len(w), min(len(exact), max(alike, 1)) - 1
        if exact[d] < 0 and not side[d]:
            return []
        del exact[d + 1 :], side[d + 1 :]
        while d <= m and (exact[d] >= 0 or side[d]):
            c1, c2, c3 = w[d - 1] if d else "", w[d] if d < m else "", w[d + 1] if d + 1 < m else ""
            new, same, ways = [], -1, {}
            for node, flags in side[d]:
                low, high = first[node], first[node + 1]
                if low == high:  # alone: its characters are read one by one
                    v = words[word[node]]
                    if len(v) > d:
                        c = v[d]
                        if open_ := (flags & 1 if c == c1 else 0) | (flags & 2 if c == c2 else 0) | (flags & 4 if c == c3 else 0):
                            new.append((node, open_))
                    continue
                if flags not in ways:
                    by: dict[str, int] = {}
                    for flag, c in ((1, c1), (2, c2), (4, c3)):
                        if flags & flag and c:
                            by[c] = by.get(c, 0) | flag
                    ways[flags] = list(by.items())
                for c, open_ in ways[flags]:
                    if (k := labels.find(c, low, high)) >= 0:
                        new.append((k, open_))
            if (node := exact[d]) >= 0:
                low, high = first[node], first[node + 1]
                base = 3 if c2 else 1
                if low == high:
                    v = words[word[node]]
                    if len(v) > d:
                        c = v[d]
                        if c == c2:
                            same = node
                        else:
                            new.append((node, base | (4 if c == c3 else 0)))
                for k in range(low, high):
                    c = labels[k]
                    if c == c2:
                        same = k
                    else:
                        new.append((k, base | (4 if c == c3 else 0)))
            exact.append(same)
            side.append(new)
            d += 1
        found = []
        for at, flag in ((m - 1, 4), (m, 2), (m + 1, 1)):
            if 0 <= at < len(side):
                nodes = [n for n, flags in side[at] if flags & flag]
                if flag == 4 and exact[at] >= 0:
                    nodes.append(exact[at])
                found += [word[n] for n in nodes if word[n] >= 0 and len(words[word[n]]) == at]
        return found


def alike(a: str, b: str) -> int:
    """How many characters two words begin with in common."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words (word, n) as trie shards: (first, size, body)."""
    words, counts, chars = [], [], 0

    def shard() -> pa.RecordBatch:
        body = pickle.dumps(trie(words, counts), protocol=5)
        return pa.RecordBatch.from_pydict({"first": [words[0]], "size": [len(body)], "body": [body]}, schema=pa.schema([("first", pa.string()), ("size", pa.int64()), ("body", pa.binary())]))

    for batch in batches:
        for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if words and (len(words) >= SHARD_WORDS or chars + len(w) > SHARD_CHARS):
                yield shard()
                words, counts, chars = [], [], 0
            words.append(w)
            counts.append(n)
            chars += len(w)
    if words:
        yield shard()


def variants(counted: DataFrame, least_ratio: int = 10) -> DataFrame:
    """From counted (word, n), words unique, the table (word, form, root, n, n_near, form_n).

    n_near: other words one edit away. form: of those the one of largest n, the smallest of several, if its n is at least
    least_ratio times the word's; else null. root: the form's form and so on, the word itself without one. Null words
    and null or negative counts are left out; an empty table gives an empty one; other columns are not carried.

    The words are sorted by ranges into trie shards of bounded size. Shards are broadcast in rounds of bounded size; in
    each round every word meets every shard, in sorted order, and only its count and best form of the round leave the task.
    """
    spark = counted.sparkSession
    words = scratch.table(counted.filter("word is not null and n >= 0").select("word", F.col("n").cast("long").alias("n")), "words")
    v = words.count()
    ranges = words.repartitionByRange(max(1, -(-v // SHARD_WORDS)), "word").sortWithinPartitions("word")
    shards = scratch.table(ranges.mapInArrow(_sharded, "first string, size long, body binary"), "shards")
    sizes = shards.select("first", "size").orderBy("first").collect()  # a row a shard
    rounds, held = [], 0
    for r in sizes:
        if not rounds or held + r["size"] > ROUND_BYTES:
            rounds.append([r["first"], r["first"]])
            held = 0
        rounds[-1][1] = r["first"]
        held += r["size"]
    tasks = max(v >> 16, min(v >> 9, 8 * spark.sparkContext.defaultParallelism), 1)
    kind = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best", pa.int64()), ("best_word", pa.string())])
    found = None
    for lo, hi in rounds:
        held_here = spark.sparkContext.broadcast([bytes(r["body"]) for r in shards.filter(F.col("first").between(lo, hi)).select("body").collect()])

        def meet(batches: Iterator[pa.RecordBatch], held_here=held_here) -> Iterator[pa.RecordBatch]:
            shards = [Descent(pickle.loads(b)) for b in held_here.value]
            before = ""
            for batch in batches:
                near, best, best_word = [], [], []
                for w in batch.column("word").to_pylist():
                    total, top, common = 0, (1, None), alike(before, w)
                    before = w
                    for s in shards:
                        ids = s.near(w, common)
                        total += len(ids)
                        if ids:
                            top = min(top, min((-s.counts[i], s.words[i]) for i in ids))
                    near.append(total)
                    best.append(-top[0] if total else None)
                    best_word.append(top[1])
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(near, pa.int64()), pa.array(best, pa.int64()), pa.array(best_word, pa.string())], schema=kind)

        met = words.repartitionByRange(tasks, "word").sortWithinPartitions("word").mapInArrow(meet, "word string, n long, n_near long, best long, best_word string")
        met = scratch.table(met, "near")
        held_here.unpersist()
        found = met if found is None else found.unionByName(met)
    if found is None:
        return spark.createDataFrame([], "word string, form string, root string, n long, n_near long, form_n long")
    if len(rounds) > 1:
        top = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best")).alias("b"), "best_word")))
        found = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), top.alias("t")).select("word", "n", "n_near", (-F.col("t.b")).alias("best"), F.col("t.best_word").alias("best_word"))
    often = F.col("best") >= least_ratio * F.col("n")
    found = scratch.table(found.select("word", "n", "n_near", F.when(often, F.col("best_word")).alias("form"), F.when(often, F.col("best")).alias("form_n")), "forms")
    return _rooted(found)


def _rooted(found: DataFrame) -> DataFrame:
    """Follow the forms: each round doubles the steps that are known, so a chain of k forms takes log2 k rounds."""
    up = scratch.table(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        later = up.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        up = scratch.table(up.join(later, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if not up.filter("moved").limit(1).count():
            break
        up = up.drop("moved")
    roots = up.select(F.col("word").alias("_word"), "root")
    return found.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Maximal runs of Latin letters.
RUN = r"[A-Za-zÀ-ÿ]"


def damaged_words(docs: DataFrame, least_length: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, by how often they occur, those too short or too rare left out.

    Of every so manyth run, by the crc32 of document and run, one character is deleted. A null id counts as an empty
    one, a null text has no words. Shorter runs are never exploded; counts are combined before the shuffle.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", text.ascii_lower(F.col("run")))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)
