"""Many words in many texts: automata of bounded size, one pass over the texts each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkrecon.operators.store import written

#: Bytes of words that one automaton holds, about: what a round brings to the driver and broadcasts.
ROUND_BYTES = 4 << 20


def _hits(held: Broadcast):
    """The broadcast words that a text contains, each once."""

    @F.arrow_udf(ArrayType(StringType()))
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in held.value:
            machine.add_word(w, w)
        machine.make_automaton()
        some = bool(held.value)
        for batch in batches:
            yield pa.array([sorted({w for _, w in machine.iter(x.as_py())}) if some else [] for x in batch], pa.list_(pa.string()))

    return hits


def contained(texts: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """(key, word) for every text and every different word that it contains; null and empty texts and words meet nothing.

    The words are dealt by hash into as many rounds as their size asks for; a round's words become one automaton, which
    each task builds once and runs over its texts. No text meets a word that it doesn't hold, and no list grows with
    the tables.
    """
    spark = texts.sparkSession
    own = written(words.select(F.col(word).alias("word")).filter("word <> ''").distinct())
    size = own.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    rounds = max(1, -(-size // ROUND_BYTES))
    slim = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text <> ''")
    found = None
    for i in range(rounds):
        part = own.filter(F.pmod(F.xxhash64("word"), F.lit(rounds)) == i)
        hits = _hits(spark.sparkContext.broadcast([r["word"] for r in part.collect()]))
        met = slim.select("key", F.explode(hits("text")).alias("word"))
        found = met if found is None else found.unionByName(met)
    return found
