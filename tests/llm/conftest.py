import random

import pytest

from windrift.llm import registry  # noqa: F401  (the whole subpackage imports)

SCHEMA = ("doc_id long, text string, lang string, source string, kept boolean, q string, spans string, ids string, "
          "shard string, th string, rid string, h1 string, kept_text string, n_tokens string, lang_pred string, _w string")


def prose(rng, n):
    return " ".join(rng.choice(["The", "of", "and"]) if rng.random() < 0.2 else "".join(
        rng.choice(["an", "er", "ing", "Tion", "é", "ß", "th", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_docs():
    """(doc_id, text): ties, repeats, nulls, empty, one long text, shared lines and passages."""
    rng = random.Random(5)
    line = "A common line that many documents of this table share, word by word"
    passage = prose(rng, 60)
    out = [(None, None), (None, "no id here, but a text of a few words"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"),
           (5, "one"), (6, "one two three"), (7, "x" * 30_000), (8, "na " * 5_000), (8, "a second row of id 8"),
           (9, "same row"), (9, "same row"), (10, prose(rng, 9_000)), (11, "日本語のテキスト 💩 " * 20), (12, "\n" * 50)]
    for k in range(20, 60):
        body = prose(rng, rng.randint(5, 120))
        if k % 3 == 0:
            body = f"{body}\n  {line.upper() if k % 2 else line}\t\n{prose(rng, 12)}"
        if k % 7 == 0:
            body = f"{prose(rng, 30)} {passage} {prose(rng, 30)}"
        out.append((k, body))
    base = prose(rng, 200).split()
    for k in range(60, 80):  # near copies at many distances
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
        out.append((k, " ".join(w)))
    out += [(k, " ".join(base)) for k in range(80, 90)]
    return out


DOCS = make_docs()


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None if k % 4 == 0 else "en", "src0", None, *["clash"] * 11)
            for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
