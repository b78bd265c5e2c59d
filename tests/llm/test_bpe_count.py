import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspark.llm import bpe_count as bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return bpe.TokenCounter(bpe.PairRanks.load(PATH), memo=500)


def test_counts_equal_the_library(counter):
    random.seed(1)
    pool = "aab'stréve \n\t\r\x0b\x1c\x85\xa0  日本👍12٣_-.<|>"
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "x" * 30000, "word " * 5000, "   \n\n  end", "I'll they're 'S"]
    library = Tokenizer.from_file(PATH)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_table(spark, counter):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (None, "", "y"), (3, "token " * 600, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.count_tokens(df, PATH).collect()), key=str)
    assert got == sorted([(d, len((t or "").encode()), n := counter.count(t or ""), n > 512) for d, t, _ in rows], key=str)
    assert bpe.count_tokens(df.limit(0), PATH).count() == 0
