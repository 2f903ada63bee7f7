import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, id string, key string, word string, packed string"


def sample(n=60, seed=1):
    """Documents with copies, near copies, shared passages, empty and null texts, and columns that clash with the operators' own."""
    r = random.Random(seed)
    vocab = ["alpha", "beta", "Gamma", "delta", "Été", "x1", "the", "of", "naïve", "漢字", "end."]
    line = lambda k: " ".join(r.choice(vocab) + str(r.randint(0, 40)) for _ in range(k))
    passage = line(70)
    texts = [None, "", "   \n\t ", "one", "two words", "one", "ONE", line(3000)]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.2:
            texts.append(r.choice([t for t in texts if t]))
        elif kind < 0.45:
            w = r.choice([t for t in texts if t and t.strip()]).split()
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind < 0.65:
            texts.append(line(r.randint(5, 40)) + "\n" + passage + " " + line(20))
        else:
            texts.append(line(r.randint(1, 120)))
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t or "")) + ("?",) * 5 for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
