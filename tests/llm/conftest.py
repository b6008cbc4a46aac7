import random

import pytest

from tests.conftest import SF_SMALL


@pytest.fixture(scope="session")
def rows(spark):
    """Documents of the smallest table with hard rows: NULLs, empty and repeated ones, near copies, long words."""
    rnd = random.Random(11)
    got = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    base = got[3][1]
    for i in range(12):
        words = base.split(" ")
        words[rnd.randrange(len(words))] = f"edit{i}"
        got.append((1000 + i, " ".join(words)))
    passage = " ".join(f"w{i}" for i in range(70))
    got += [(1100 + i, f"{got[i][1][:200]} {passage[:150 + 20 * i]} {got[i + 9][1][:300]}") for i in range(8)]
    got += [(2000, None), (2001, ""), (2002, " \n\t "), (None, base), (None, None), (2003, "one"), (2003, "one"),
            (2004, "two words"), (5, got[5][1]), (5, "another text of id five"), (-7, base), (2005, "x" * 5000),
            (2006, "a b c " * 3000), (2007, "ſecret=abcdefgh Password: 'hunter22' api-key=1 api_key = zzzzzz99"),
            (2008, "mail a.b@c.d.e, x@y, @q.r +1 (456) 555-2186 10.0.0.256 1.2.3.4.5 4111 1111 1111 1111 é@ü.de z@z.zz"),
            (2009, "0" * 4000 + "." + "1" * 4000), (2010, "AKIA" + "Q" * 16 + " AKIA1 " + "deadbeef" * 4 + "g" + "0f" * 12)]
    return got


@pytest.fixture(scope="session")
def docs(spark, rows):
    """As a table of several files with extra columns whose names the operators use inside."""
    extra = ["th", "kid", "row", "spans", "fp", "hits", "label", "score"]
    data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), *["?"] * len(extra)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame(data, schema).repartition(6).cache()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def words(text):
    """[^\\x20\\x09-\\x0D]+ as bytes."""
    return (text or "").encode().split()
