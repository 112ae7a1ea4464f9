"""Deleted interpolation: bigram, unigram and uniform estimates mixed by the frequency of the context.

Documents are packed into blocks of a bounded number of tokens. A block asks for the counts of its different
n-grams once, by ranges of their hashes; a range adds up what all training blocks hold and answers every block in
the order it asked. So n-grams cross the network once a block, as sorted numbers, and no n-gram, however frequent,
gathers more than one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import scratch, text
from sparkrecon.llm.shingles import _LOWER, _mix

#: Context-frequency buckets: the number of bits of the context's count.
FREQUENCIES = 48
#: Mixture weights (bigram, unigram, uniform) of a bucket without held-out counts.
USUAL = (0.3, 0.6, 0.1)
_U = np.uint64


def _squeeze(x: np.ndarray) -> bytes:
    """Whole numbers, a plane for each byte, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _spread(blob: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sorted_blob(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=_U(0)))


def _sorted_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_spread(blob, np.uint64), dtype=np.uint64)


def _pack(most_bytes: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of documents of one part (0 train, 1 held out for the weights, 2 held out of training)."""
        import zstandard
        from pyspark import TaskContext

        partition, number = TaskContext.get().partitionId(), 0
        ids, texts, size, tokens = [[], [], []], [[], [], []], [0, 0, 0], [0, 0, 0]

        def flush(part: int) -> pd.DataFrame:
            nonlocal number
            number += 1
            known = np.array([i is not None for i in ids[part]])
            numbers = np.array([i or 0 for i in ids[part]], dtype=np.int64)
            lengths = np.array([len(t) for t in texts[part]], dtype=np.int64)
            row = (f"{partition}-{number}", part, len(ids[part]), tokens[part], numbers.tobytes(), known.tobytes(), lengths.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts[part])))
            ids[part], texts[part], size[part], tokens[part] = [], [], 0, 0
            return pd.DataFrame([row], columns=["block", "part", "docs", "tokens", "ids", "known", "lengths", "texts"])

        for batch in batches:
            for doc_id, part, value in zip(batch["doc_id"].astype("Int64"), batch["part"], batch["text"], strict=True):
                value = (value or "").encode("utf-8", "surrogatepass").translate(_LOWER)
                ids[part].append(None if doc_id is pd.NA else int(doc_id))
                texts[part].append(value)
                size[part] += len(value) + 64
                tokens[part] += len(value.split()) + 1
                if size[part] >= most_bytes:
                    yield flush(part)
        for part in range(3):
            if ids[part]:
                yield flush(part)

    return pack


class _Block:
    """The tokens of a block: keys of each token, of its context and of the two together, and where documents begin."""

    def __init__(self, row):
        import xxhash
        import zstandard

        of, known = xxhash.xxh3_64_intdigest, {}
        whole = zstandard.ZstdDecompressor().decompress(row.texts, max_output_size=1 << 31) if row.texts else b""
        ends = np.cumsum(np.frombuffer(row.lengths, dtype=np.int64)).tolist()
        self.ids, self.known = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.known, dtype=bool)
        stop, first, begin = of(b" end"), [], of(b" begin")
        tokens, at = [], 0
        for end in ends:
            words = whole[at:end].split()
            at = end
            for w in set(words).difference(known):
                known[w] = of(w)
            first.append(len(tokens))
            tokens.extend(map(known.__getitem__, words))
            tokens.append(stop)
        t = np.array(tokens, dtype=np.uint64)
        self.first = np.array(first, dtype=np.int64)
        c = np.concatenate([[_U(begin)], t[:-1]])
        c[self.first] = _U(begin)
        even, odd = ~_U(1), _U(1)
        self.word = _mix(t, 3) & even
        self.start = (_mix(np.array([begin], dtype=np.uint64), 3) | odd)[0]
        self.context = np.concatenate([[self.start], self.word[:-1]])
        self.context[self.first] = self.start
        self.pair = _mix(c * _U(0xD6E8FEB86659FD93) + t, 5) | odd

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([self.word, self.pair, np.full(len(self.first), self.start)]), return_counts=True)


def _edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    of = ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    return np.searchsorted(of, np.arange(ranges + 1))


def _asked(ranges: int):
    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                keys, counts = _Block(row).keys()
                at = _edges(keys, ranges)
                out = [(row.block, row.part, r, _sorted_blob(keys[a:b]), _squeeze(counts[a:b].astype(np.uint32))) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
                yield pd.DataFrame(out, columns=["block", "part", "r", "keys", "counts"])

    return asked


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """What the training blocks hold of each key asked for, and (block null) how many different words they hold."""
    asked = [_sorted_keys(x) for x in group["keys"]]
    every, place = np.unique(np.concatenate(asked), return_inverse=True)
    cut = np.cumsum([0, *map(len, asked)])
    main, both = np.zeros(len(every), dtype=np.uint64), np.zeros(len(every), dtype=np.uint64)
    for i, (part, counts) in enumerate(zip(group["part"], group["counts"], strict=True)):
        if part < 2:
            n = _spread(counts, np.uint32).astype(np.uint64)
            both[place[cut[i] : cut[i + 1]]] += n
            if part == 0:
                main[place[cut[i] : cut[i + 1]]] += n
    words = (every & _U(1)) == 0
    r = int(group["r"].iloc[0])
    out = [(block, r, _squeeze(main[x]) if part == 1 else None, _squeeze(both[x]), 0, 0) for i, (block, part) in enumerate(zip(group["block"], group["part"], strict=True)) for x in [place[cut[i] : cut[i + 1]]]]
    out.append((None, r, None, None, int((main[words] > 0).sum()), int((both[words] > 0).sum())))
    return pd.DataFrame(out, columns=["block", "r", "main", "both", "main_words", "both_words"]).astype(object).where(lambda x: x.notna(), None)


def _looked_up(blocks: pd.DataFrame, replies: pd.DataFrame, which: str):
    block = _Block(next(blocks.itertuples()))
    counts = np.concatenate([_spread(x, np.uint64) for x in replies.sort_values("r")[which]])
    keys, _ = block.keys()
    if len(keys) != len(counts):
        raise ValueError("a block's answers do not fit its questions")
    find = lambda x: counts[np.searchsorted(keys, x)].astype(np.float64)
    return block, find(block.word), find(block.context), find(block.pair)


def _frequency(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), FREQUENCIES - 1).astype(np.int64)


def _held_out_counts(tokens: int):
    def counted(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """Held-out tokens by context-frequency bucket and, to half an octave, bigram and unigram estimates."""
        if not len(blocks) or not len(replies):
            return pd.DataFrame({"bucket": [], "two": [], "one": [], "n": []}, dtype=np.int64)
        _, word, context, pair = _looked_up(blocks, replies, "main")
        step = lambda p: np.where(p > 0, np.rint(-2 * np.log2(np.maximum(p, 1e-30))), -1).astype(np.int64)
        two, one = step(pair / np.maximum(context, 1)), step(word / max(1, tokens))
        rows, n = np.unique(np.stack([_frequency(context), two, one]), axis=1, return_counts=True)
        return pd.DataFrame({"bucket": rows[0], "two": rows[1], "one": rows[2], "n": n})

    return counted


def learn_weights(counts: pd.DataFrame, words: int, rounds: int = 100) -> np.ndarray:
    """Expectation-maximisation on held-out counts: the weights of (bigram, unigram, uniform) of each bucket."""
    weights = np.tile(np.array(USUAL), (FREQUENCIES, 1))
    for bucket, own in counts.groupby("bucket"):
        n = own["n"].to_numpy(float)
        p = np.stack([np.where(own[c] >= 0, 2.0 ** (-own[c] / 2), 0.0) for c in ("two", "one")] + [np.full(len(own), 1 / (words + 1))], axis=1)
        w = np.array(USUAL)
        for _ in range(rounds):
            part = p * w
            part /= part.sum(axis=1, keepdims=True)
            w = (part * n[:, None]).sum(axis=0) / n.sum()
        weights[int(bucket)] = 0.999 * w + 0.001 * np.array(USUAL)
    weights[0] = [0.0, *(weights[0][1:] / weights[0][1:].sum())]  # an unseen context has no bigram estimate
    return weights


def _scored(weights: np.ndarray, tokens: int, words: int):
    def scored(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(replies):
            return pd.DataFrame({"doc_id": [], "part": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}, dtype=object)
        block, word, context, pair = _looked_up(blocks, replies, "both")
        w = weights[_frequency(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, tokens) + w[:, 2] / (words + 1)
        base = np.log10((word + 1) / (tokens + words + 1))
        n = np.diff(np.append(block.first, len(word)))
        add = lambda x: np.add.reduceat(x, block.first)
        ids = pd.array(block.ids, dtype="Int64")
        ids[~block.known] = pd.NA
        return pd.DataFrame({"doc_id": ids, "part": int(blocks["part"].iloc[0]), "n_tokens": n, "n_known": add((word > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))})

    return scored


def score(docs: DataFrame, folds: int = 7, test: int = 2, dev: int = 3, block_bytes: int = 8 << 20) -> DataFrame:
    """Score the texts of docs (doc_id, text); learn from those outside fold test of folds.

    The weights are learned on fold dev with the counts of the other training folds; the counts are then those of
    all training folds. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, one added) and
    score (log10 probability under the mixture), a row for each row of docs. Null text counts as empty: its one
    token is the end. A document is never split; a block holds at least one.
    """
    spark = docs.sparkSession
    fold = text.fold(F.col("doc_id"), folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(fold == test, 2).when(fold == dev, 1).otherwise(0).alias("part"), "text")
    kind = "block string, part int, docs long, tokens long, ids binary, known binary, lengths binary, texts binary"
    blocks = scratch.table(rows.mapInPandas(_pack(block_bytes), kind), "blocks")
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    main_tokens = sums.get(0, 0)
    tokens = main_tokens + sums.get(1, 0)
    ranges = max(12, sum(sums.values()) >> 20)
    asked = blocks.mapInPandas(_asked(ranges), "block string, part int, r int, keys binary, counts binary")
    replies = scratch.table(
        asked.groupBy("r").applyInPandas(_answered, "block string, r int, main binary, both binary, main_words long, both_words long"), "answers"
    )
    main_words, words = replies.agg(F.coalesce(F.sum("main_words"), F.lit(0)), F.coalesce(F.sum("both_words"), F.lit(0))).first()
    replies = replies.filter("block is not null")
    held = blocks.filter("part = 1").groupBy("block").cogroup(replies.filter("main is not null").groupBy("block"))
    counts = held.applyInPandas(_held_out_counts(main_tokens), "bucket long, two long, one long, n long")
    counts = counts.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas()  # bounded by the steps of the three
    weights = learn_weights(counts, main_words)
    found = blocks.groupBy("block").cogroup(replies.select("block", "r", "both").groupBy("block")).applyInPandas(
        _scored(weights, tokens, words), "doc_id long, part int, n_tokens long, n_known long, base_score double, score double"
    )
    return found.select(
        "doc_id", (F.col("part") == 2).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
