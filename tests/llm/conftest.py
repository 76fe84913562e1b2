import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Null, empty, tiny, long, repeated and near-equal rows; one hot source."""
    import random

    r = random.Random(5)
    words = ["the", "of", "an", "Stone", "river", "Berg", "éta", "日本", "x!!", "a|b", "#1", "night", "under", "milk"]
    body = [r.choice(words) + str(r.randrange(30)) for _ in range(300)]
    rows = [(0, None, None, None, None), (1, "", "en", "s0", 0), (2, " \n\t ", "en", "s0", 4), (None, "no id here", "en", "s1", 10)]
    for i in range(3, 40):
        w = list(body[:120 + i])
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"new{i}"
        t = " ".join(w) + ("\nsame line\nsame line" if i % 3 else "")
        rows.append((i, t, "en" if i % 2 else "fr", "s0" if i % 5 else "s1", len(t)))
    rows += [(40 + i, rows[10 + i][1], "en", "s0", 5) for i in range(6)] + [(60, "word " * 4000, "de", None, 20000), (61, "abc", "", "s2", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture
def rows(docs):
    return [tuple(x) for x in docs.collect()]
