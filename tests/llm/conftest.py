import random
import string

import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of every awkward kind: (id, text) pairs with nulls, empties, repeats, ties and a long one."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    base, passage = prose(160), prose(70)
    near = base.split()
    near[5] = near[90] = "changed"
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "word"), (5, "Two  words"), (6, base), (7, base), (8, base.replace(" ", "\n")),
            (9, " ".join(near)), (10, base.upper()), (11, prose(50) + " " + passage + " " + prose(50)),
            (12, passage + " " + prose(30)), (13, prose(20) + " " + passage), (14, "é ß 中文 \U0001F600 " + prose(40)),
            (15, prose(6000)), (16, "a" * 5000), (17, prose(40) + " " + passage + " " + passage), (18, "x\x00y  z"), (18, "x\x00y  z"),
            (None, prose(45)), (None, prose(45)), (20, "<|endoftext|> it's 10% <|endoftext|>!"), (21, "ab ab ab " * 60)]
    rows += [(100 + i, prose(rng.randint(1, 120))) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts with the columns of documents and two whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1.5) for i, t in odd_texts],
                                 "doc_id long, text string, lang string, source string, n_chars long, digest string, row double") \
        .repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
