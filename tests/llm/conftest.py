import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, size string, row string"


def rows(n=240, seed=5):
    """Small documents with all that operators have to bear: null ids, texts
    and sources, empty and one very long text, copies, near copies, shared
    lines and passages, rows repeated as they are."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 8))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    line, passage = "A shared line of the corpus", say(90)
    out = []
    for i in range(n):
        text = "\n".join(say(r.randrange(1, 30)) for _ in range(r.randrange(1, 6)))
        if i % 3 == 0:
            text = text + "\n  " + line.upper() + "\t\n" + say(5)
        if i % 5 == 0:
            text = say(3) + " " + passage + " " + say(4)
        if i % 7 == 0 and i > 20:
            text = (out[i - 14][1] or "") + (" more" if i % 2 else "")
        if i % 31 == 1:
            text = [None, "", " \t\n ", "one", "###$$ !!! ###", "ab " * 200][i // 31 % 6]
        out.append((i, text, "xx", None if i % 17 == 4 else f"s{i * i % 4}", 3, "k", "n", "s", "r"))
    out.append((n, say(30_000), "xx", "s0", 3, "k", "n", "s", "r"))
    out += [(None, out[2][1], None, "s1", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out + [out[3], out[3]]


@pytest.fixture(scope="session")
def corpus():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def unique(corpus):
    """Rows with an id, each id once."""
    return [r for r in corpus[:-2] if r[0] is not None]


@pytest.fixture(scope="session")
def unique_docs(spark, unique):
    return spark.createDataFrame(unique, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
