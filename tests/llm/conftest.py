import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, score double, row string, key string, shard int, label int"
VOCABULARY = [a + b for a in ("the", "on", "re", "ti", "sha", "bri", "mo", "le") for b in ("", "ra", "ing", "st", "da", "ly", "en", "os")]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def sentence(rng, n):
    return " ".join(words(rng, n)).capitalize() + "."


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of ``(doc_id, text[, source])`` with further columns whose names clash with the operators'."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7, 1, 2, 0.5, "r", "k", 3, 4) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts and sources, empty, blank, short and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(60, 160)) for _ in range(12)]
    passage = words(rng, 70)
    rows = [(i, " ".join(w), f"s{i % 3}") for i, w in enumerate(base)]
    for i in range(12, 40):
        w = list(base[i % 12])
        if i % 3 == 0:
            for _ in range(i % 5):
                w[rng.randrange(len(w))] = "changed"
        elif i % 3 == 1:
            w = words(rng, 20) + passage + words(rng, 20)
        rows.append((i, " ".join(w), f"s{i % 4}"))
    rows += [(50, None, "s1"), (51, "", "s1"), (52, " \n\t ", None), (53, "one two", None), (54, "One\ttwo", "é"), (None, rows[3][1], "s0"),
             (None, None, None), (7, rows[7][1], rows[7][2]), (8, rows[9][1] + " more", "s2"), (60, " ".join(words(rng, 30_000)), "s0"),
             (61, "x" * 200_000, "s0"), (62, "dé jà\u2003vu 漢字 🙂 " * 12, "s1"), (-5, " ".join(base[0]), "s0"), (63, "again " * 400, "s2")]
    return rows


@pytest.fixture
def odd(frame, odd_rows):
    return frame(odd_rows)


@pytest.fixture
def none(frame):
    return frame([])
