import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, value string, words string, _id long, _h long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, texts without letters, columns that clash with the operators' own."""
    rng = random.Random(5)
    vocabulary = ["ab" + "".join(rng.choices("cdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    long_text = " ".join(rng.choices(vocabulary, k=9000))
    base = " ".join(rng.choices(vocabulary, k=120))
    texts = [None, "", "   \n\t ", "one", "two words", "one", "One  TWO three four", "1234 ... 5", long_text, long_text + " more", base, base,
             base + " x", "y " + base + " z", base.replace(" ab", " AB"), "É é Σ σ ß", "a" * 50_000, "\n" * 3000 + "end", "<|endoftext|> a <|endoftext|>",
             " ".join(rng.choices(vocabulary, k=60)) + "\n" + base]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None, "r", "v", "w", i, 1) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 3, "r", "v", "w", 3, 1)] * 2 + [(None, base, None, None, None, None, None, None, None, None),
                                                                  (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").withColumn("root", F.lit("clash"))
