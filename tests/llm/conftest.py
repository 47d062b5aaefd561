import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, empty, null and very long ones."""
    rng = random.Random(11)
    passages = [words(rng, 60) for _ in range(4)]
    texts = [words(rng, rng.randint(1, 150)) for _ in range(60)]
    texts += [words(rng, 20) + "\n" + rng.choice(passages) + "\n" + words(rng, 25) for _ in range(40)]
    for _ in range(30):
        copy = rng.choice(texts[:60]).split(" ")
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[3]] * 25 + [None, None, "", "   ", "A b", "ÄÖ ß 漢字 \t\r\n x\u00a0y", words(rng, 9000), "ab " * 400, "z" * 900]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Writes rows as a Parquet table and reads it, as operators meet their input."""

    def store(rows, schema=DOCUMENTS, files=3):
        if schema == DOCUMENTS:
            rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
        path = str(tmp_path_factory.mktemp("table") / "t")
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return store


@pytest.fixture(scope="session")
def documents(stored, corpus):
    return stored(corpus)


@pytest.fixture(scope="session")
def odd(stored, corpus, spark):
    """Repeated rows, null ids and columns whose names operators use themselves."""
    rows = [(d, t, 1, "x", 2, "y", 3.0) for d, t in corpus[:80]] * 2 + [(None, corpus[5][1], 1, "x", 2, "y", 3.0), (None, None, 1, None, 2, "y", 3.0)]
    return stored(rows, "doc_id long, text string, doc int, row string, size int, digest string, score double")


@pytest.fixture(scope="session")
def empty(stored):
    return stored([])
