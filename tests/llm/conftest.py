import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: Vowel runs make words; each fixture text is invented here.
WORDS = [a + b for a in "b d f g k l m n p r s t v z".split() for b in "a e i o u an en on ar el".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def docs(spark):
    """Prose, exact and near copies, and the odd cases: null, empty, blank, long, repeated rows, null ids."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 160)), rng.choice(["en", "de"]), f"src{i % 3}", 0) for i in range(60)]
    for i in range(60, 90):
        w = rows[i - 60][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "src0", 0))
    rows += [(90, rows[3][1], "en", "src1", 0), (91, rows[3][1].upper(), None, None, 0), (92, None, "en", "src0", None), (93, "", "en", None, 0)]
    rows += [(94, " \t\n", "de", "src2", 3), (95, "one", "en", "src2", 3), (96, prose(rng, 9000), "en", "src0", 0), (95, "one", "en", "src2", 3)]
    rows += [(None, "a row without id", "en", "src0", 0), (97, "a b ÉtÉ naïve café", "fr", "src9", 0)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
