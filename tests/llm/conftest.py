import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in was that tion ing ner ould eat ari moss quill brant sova lumen teckle orrin pad vex".split()


def prose(rng, n, letters=WORDS):
    return " ".join(rng.choice(letters) + rng.choice(["", "s", "er", "ing"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts of all kinds: null, empty, blank, long, equal, near copies, shared passages, null and repeated ids."""
    rng = random.Random(11)
    shared, base = prose(rng, 60), prose(rng, 200)
    near = base.split(" ")
    near[100] = "changed"
    texts = [None, "", " \n\t ", base, base, " ".join(near), prose(rng, 30) + "\n" + shared + " tail", shared.upper(), "head " + shared + " " + prose(rng, 20), prose(rng, 6000), "one", "a b c", "x " * 120, "é ü 日本語 ﬁn", prose(rng, 80) + "\n" + prose(rng, 80)]
    rows = [(k, t, "en", f"src{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]
    return rows + [(None, base, None, "src1", 1), (None, None, None, None, None), rows[6], rows[6], (3, "another text under a used id", "en", "src9", 5)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows over several partitions, with extra columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    extra = {n: F.lit(n) for n in ("row", "key", "n", "fp", "hash", "block", "queue", "base", "found", "kept", "__block_id", "component_id")}
    return spark.createDataFrame(odd_rows, DOC).repartition(3).withColumns(extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
