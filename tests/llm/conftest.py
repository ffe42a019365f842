import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, fp string, node int, h int"


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["été", "a", "A", "zz z"]
    passage = " ".join(rng.choice(vocab) for _ in range(45))
    out = [None, "", " \t\n", "one", "one two", "ONE two", "x" * 5000, "a " * 120, "a b " * 80]
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 150))]
        if rng.random() < 0.4:
            words[rng.randint(0, len(words)) :] = passage.split()[rng.randint(0, 10) :]
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    base = out[-1].split()
    for k in range(12):  # near copies
        copy = list(base)
        copy[k % len(copy)] = f"new{k % 3}"
        out.append(" ".join(copy))
    out += [out[10], out[10], out[12]]  # exact copies
    out.append("mail a.b@c.d.org, card 4111 1111 1111 1111 or +1 (017) 555-7713 from 10.0.0.255 and 10.0.0.256")
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", None, 1, "x", "y", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, "only text without id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain(spark, texts):
    """Unique ids, the columns of ``documents``."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
