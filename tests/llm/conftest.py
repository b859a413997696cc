import pytest
import random

SF = "/root/testdata/sf0.001"

#: Columns beyond doc_id, text and source clash with names the operators use inside.
DDL = "doc_id long, text string, lang string, source string, n_chars long, uid string, fp string, key string, h string, digest string, row string"


def nasty_rows(seed=0, n=120):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta.", "Épée", "straße", "one", "two", "three", "#x|", "token=abc123def456", "clown"]
    out = []
    for i in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), "\t Shared LINE of many documents \x0b")
        out.append((i, "\n".join(lines)))
    out += [(None, "a null id"), (None, None), (500, None), (501, ""), (502, " \t\n\x0b "), (503, "x" * 70000), (504, "word " * 30000),
            (505, out[0][1]), (506, out[0][1]), (506, out[0][1]), (3, "an id again"), (507, "İstanbul ΣΑΣ     \x1c 😀 é"),
            (508, "\n\n  two  spaces\r\n\ttabs "), (509, "<|endoftext|> it's we'll 123 ...")]
    return [(d, t, None if i % 5 == 0 else "en", None if i % 17 == 0 else f"s{i % 3}", None, "u", "f", "k", "h", "d", "r") for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
