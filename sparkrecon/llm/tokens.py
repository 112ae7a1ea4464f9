"""Token counts by whole-token shortcut, equal to those of the sentencepiece library."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import carry

#: What the library writes for a space inside pieces; it also stands for itself in a text.
MARK = "▁"
#: Pre-tokens remembered by a Python worker; beyond it the memory starts anew.
REMEMBERED = 500_000


@functools.lru_cache(maxsize=2)
def shortcuts(model_file: str):
    """The processor, the pre-tokens proven to be one token each, and the expression that cuts pre-tokens.

    A merge only ever makes a piece of the vocabulary. So if no piece holds MARK after another character, no merge
    crosses the place before a run of spaces, and the text's count is the sum over pre-tokens (a run of spaces and
    what follows to the next space). Likewise a control character that no longer piece holds never merges, and
    pre-tokens may be cut around it. Each piece that begins with MARK is then encoded alone: those that come
    back as one token are the whole-token pre-tokens.
    """
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    own = [p for i, p in enumerate(pieces) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
    if any(MARK in p.lstrip(MARK) for p in own):
        raise ValueError("a piece holds a space after another character: pre-tokens can't be counted apart")
    alone = [p for p in own if p.startswith(MARK) and p.strip(MARK)]
    whole = {p for p, ids in zip(alone, processor.encode([p[1:] for p in alone]), strict=True) if len(ids) == 1}
    longer = {c for p in own if len(p) > 1 for c in p}
    apart = "".join(c for c in "\n\t\r" if c not in longer)
    each = {c: len(processor.encode("a" + c)) - len(processor.encode("a")) for c in apart}
    cut = re.compile(f"{MARK}+[^{MARK}{re.escape(apart)}]*|[{re.escape(apart)}]|[^{MARK}{re.escape(apart)}]+") if apart else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
    return processor, whole, cut, each


def counter(model_file: str):
    """A function from text to its number of tokens."""
    processor, whole, cut, each = shortcuts(model_file)
    if each:  # a space before a character that is cut off stands alone
        first = next(iter(each))
        each = each | {MARK: len(processor.encode(first)) - each[first]}
    known: dict[str, int] = dict.fromkeys(whole, 1) | each

    def merged(pre: str) -> int:
        """Tokens of a pre-token that isn't one token: after a run of marks, or after a character cut off."""
        if pre[0] == MARK:
            return len(processor.encode(pre[1:]))
        return len(processor.encode(first + pre)) - len(processor.encode(first))

    def count(text: str) -> int:
        nonlocal known
        if not text:
            return 0
        total = 0
        for pre, n in Counter(cut.findall(MARK + text.replace(" ", MARK))).items():
            if (each_n := known.get(pre)) is None:
                each_n = merged(pre)
                if len(known) >= REMEMBERED:
                    known = dict.fromkeys(whole, 1) | each
                known[pre] = each_n
            total += n * each_n
        return total

    return count


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to docs (text, ...).

    model names a file of the public tokenizers. Null text counts as empty: 0 bytes, 0 tokens. A text is
    handled whole in one call, beside a bounded memory of pre-tokens. No shuffle. An added column takes the place of an
    input column of its name; other columns are carried whatever their names.
    """

    @F.pandas_udf("long")
    def tokens_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers

        count = counter(public_tokenizers.path(model))
        for texts in batches:
            yield pd.Series([0 if t is None else count(t) for t in texts], dtype="int64")

    rows = (
        carry.packed(docs, ["text"])
        .withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
        .withColumn("n_tokens", tokens_of("text"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
    return carry.unpacked(rows, docs, ["text"], ["n_bytes", "n_tokens", "over_limit"])
