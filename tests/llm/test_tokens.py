import random

import public_tokenizers
import sentencepiece

from sparkrecon.llm import registry, tokens

MODEL = "piece_bpe_32k.model"


def test_counts_equal_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op2_token_counts(spark, sf).collect():
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 4096)


def test_counts_on_random_strings():
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    count = tokens.counter(public_tokenizers.path(MODEL))
    random.seed(5)
    parts = [*"ab  \n\t\r▁é中😀x<>s/.,'\x00　 ", "<s>", "</s>", "<unk>", "<0x0A>", " the", "\n\n", "ing", "ﬁ", "́"]
    for _ in range(5000):
        text = "".join(random.choices(parts, k=random.randint(0, 30)))
        assert count(text) == len(library.encode(text)), repr(text)


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (3, "a b " * 50000), (3, "a b " * 50000), (4, "x" * 10000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' N_TOKENS", "'y' _carried")
    got = tokens.count_tokens(docs)
    assert got.columns == ["doc_id", "text", "_carried", "n_bytes", "n_tokens", "over_limit"]
    got = got.collect()
    assert {r["_carried"] for r in got} == {"y"}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    assert [r.n_tokens for r in got] == [len(library.encode(t or "")) for _, t in rows]
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
