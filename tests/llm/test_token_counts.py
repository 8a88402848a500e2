import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from uttera.llm import token_counts
from uttera.session import ship

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_counts.TokenCounter(PATH, public_tokenizers.PATTERN, {" the": 1})


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "\t", "'s", "don't", " the", "é", "漢字", "12 34", "!!", " ", "a" * 30]), max_size=12).map("".join)))
def test_as_the_library(text):
    assert COUNTER.count(text) == library(text)


def test_table(spark):
    ship(spark)
    texts = [None, "", "one <|endoftext|>two<|endoftext|>", "word " * 40_000, "x" * 50_000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    got = {r.doc_id: r for r in token_counts.token_counts(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        n = library(t or "")
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.token_counts(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
