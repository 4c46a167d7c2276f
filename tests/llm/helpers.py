"""Small tables and plain versions shared by the tests of the training-data operators."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "...!!! 123",
    "a",
    "Straße  déjà\tvu\r\n\r\nx",
    "it's 'S we'll  I'D ",
    "日本語 テスト　x",
    "\x1c\x1d a\x85b​ c﻿",
    "<|endoftext|> <|startoftext|>",
    "🙂🙂 a‍b 1a2b ½",
    "ab" * 3000,
    " " * 300 + "\n" * 50 + "z",
    "trail  \n ",
]


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{int(draw.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


def odd_docs(spark):
    """Odd texts, copies, near copies, null and repeated ids, and columns with clashing names."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD_TEXTS)]
    base = words(1, 300)
    for k in range(12):
        own = list(base)
        own[k] = f"x{k}"
        rows.append((100 + k, " ".join(own), "en", "s", 0))
    rows += [(200 + k, " ".join(base), "de", "s", 0) for k in range(4)]
    rows += [(300 + k, " ".join(words(9 + k, 80)), "fr", "s", 0) for k in range(10)]
    rows += [(300, " ".join(words(9, 80)), "fr", "s", 0), (None, "no id here", "en", "s", 0)]
    return clashing(spark.createDataFrame(rows, DOCS))


def clashing(df):
    from pyspark.sql import functions as F

    names = "row part node fp block ids words label kept component_id __len __n start side".split()
    return df.withColumns({n: F.lit("?") for n in names if n not in df.columns})


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def least_reachable(nodes, links):
    """Smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
