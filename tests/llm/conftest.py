from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, block long, carried string, kept boolean, "
          "size long, h binary, held_out string")


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Ids and texts with everything that is unusual: nulls, blanks, copies, ties, a very long text."""
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma.", "dé", "ñandú", "of", "the", "THE", "x", "42"] + [f"w{i}" for i in range(60)]
    passage = sentence(rng, 70, vocabulary)
    line = "A line that many documents hold, word for word"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one"), (6, "two words"), (None, passage), (None, None),
            (7, passage), (8, passage), (8, passage), (9, passage + " tail"), (10, "head " + passage.replace("of", "Of")),
            (11, "\n".join([line, "short", line.upper(), "", line])), (12, f"  {line}\nother\n"), (13, f"{line}\n{line}"),
            (-5, line + "\nbefore all"), (14, "a" * 300), (15, "a" * 120 + "b" + "a" * 120), (16, "ab" * 100),
            (17, sentence(rng, 4000, vocabulary) + " " + passage), (18, passage[:200]), (18, "same id, another text"),
            (19, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
            (20, "# * $ % & | < > " * 20), (1 << 60, passage + " " + passage), (21, "é" * 60), (22, "x" + "é" * 60)]
    base = sentence(rng, 120, vocabulary).split()
    for i in range(30, 60):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    for i in range(60, 90):
        rows.append((i, sentence(rng, rng.randrange(1, 40), vocabulary[:12])))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """As a table whose other columns have nulls and names that operators use themselves."""
    return spark.createDataFrame([(i, t, None, None if k % 4 == 0 else f"s{k % 3}", None, k, "c", None, k, b"", "x")
                                  for k, (i, t) in enumerate(odd_rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def marks(spark):
    """Labels with nulls, repeats and ids of no document."""
    rows = [(i, 1 if i % 5 else 0, 0) for i in range(30, 90)] + [(20, 0, 0), (20, 0, 0), (None, 1, 0), (40, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
