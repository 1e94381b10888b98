import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ra ste nim pol".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with everything that is awkward: (doc_id, text) rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for i in range(0, 120, 7):
        far[i] = "other"
    return [
        (1, base), (2, base), (3, base.replace(" ", "\n", 5)), (4, " ".join(near)), (5, " ".join(far)),
        (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, "One two three four"), (11, prose(rng, 40)), (11, prose(rng, 30)),
        (12, "same row"), (12, "same row"), (None, "no id"), (None, None), (13, "x" * 200_000), (14, "ab " * 20_000),
        (15, "ÀÉÎ ÑÖ ÇŒ 中文字 ☃ \U0001F600 é  Σ ΟΔΟΣ İ"), (16, "<|endoftext|>a<|startoftext|> b"), (17, "it's 12,5% \x1c \x85  z"),
        (18, base.upper()), (19, prose(rng, 300)),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from lumenframe.llm.rows import tokenizer_path
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="session")
def documents_table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
