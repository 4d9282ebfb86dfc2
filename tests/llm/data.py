"""Small tables with the awkward rows every operator has to handle."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, id string, anchor string"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "epsilon.", "zeta", "eta", "thêta", "iota", "kappa"]) + str(rng.randrange(60)) for _ in range(n))


def texts(seed=1):
    """Id and text: plain, near copies, shared passages, repeated rows, empty, blank, null and long ones."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    base = sentence(rng, 120).split(" ")
    rows = [(i, sentence(rng, rng.randrange(1, 80))) for i in range(20)]
    rows += [(20 + i, sentence(rng, 15) + "\n" + passage + " " + sentence(rng, 15)) for i in range(5)]
    for i in range(5):
        copy = list(base)
        copy[rng.randrange(120)] = "other"
        rows.append((30 + i, " ".join(copy)))
    rows += [(40, " ".join(base)), (41, " ".join(base).upper()), (42, " ".join(base))]
    rows += [(50, ""), (51, None), (52, " \n\t "), (53, "one"), (54, "a " * 300), (55, "é" * 250), (55, "é" * 250), (None, sentence(rng, 30)), (None, None)]
    rows += [(60, sentence(rng, 4000) + passage), (61, "x" * 3000)]
    return rows


def docs(spark, rows=None):
    """With further columns whose names the operators use themselves."""
    rows = texts() if rows is None else rows
    full = [(i, t, None if n % 7 == 0 else "en", None if n % 5 == 0 else f"src{n % 3}", None if t is None else len(t), 0.5, "k", "i", "a") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(pairs, nodes):
    """Least node reachable over the pairs."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


__all__ = ["F", "docs", "empty", "groups", "rows_of", "sentence", "texts"]
