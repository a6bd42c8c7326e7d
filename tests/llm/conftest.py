import hashlib

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, blob int, rank int, u int, v int, bucket int, kept boolean, flags int"


def table(spark, rows):
    """``rows`` of (doc_id, text, lang, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, None, 1, 2, 3, 4, 5, True, 6) for i, t, lang, s in rows], DOC).repartition(3)


WORDS = [f"w{hashlib.md5(str(i).encode()).hexdigest()[:5]}" for i in range(400)]
BASE = " ".join(WORDS[:120])
NEAR = " ".join([*WORDS[:60], "changed", *WORDS[61:120]])
LONG = " ".join(WORDS[i * i % 400] for i in range(30_000))
ROWS = [
    (1, None, None, None), (2, "", "en", "src0"), (3, BASE, "en", "src0"), (4, BASE, "en", "src0"), (5, NEAR, None, "src1"), (6, "one two three four", "de", "src2"),
    (7, "One  TWO three\tfour", "de", "src2"), (8, LONG, "fr", None), (9, " ".join(WORDS[200:330]), "fr", "src3"), (3, BASE, "en", "src0"), (None, "no id here", "en", "src1"),
    (10, "12 34 !", "en", "src1"), (11, "Same line\n\n same LINE \nother", "en", "src1"),
]


@pytest.fixture
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture
def empty(spark):
    return table(spark, [])
