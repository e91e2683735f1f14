"""Small tables of documents with the awkward rows in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, `group` int, value double, path string, row_id int"


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def awkward(spark, more=()):
    """Null and blank texts, a null id, repeated rows, equal texts, a very long text; extra columns with clashing names."""
    rnd = random.Random(4)
    texts = [(i, prose(rnd, rnd.randint(1, 60)) + rnd.choice(["", ".\n", "\nline two", " ü 中文"])) for i in range(2, 30)]
    texts += [(30, None), (31, ""), (32, " \n\t "), (33, prose(rnd, 30_000)), (34, texts[0][1]), (35, texts[0][1]), (35, texts[0][1]), (36, "a"), (None, "no id here at all"), (40, "x" * 5000), *more]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", None]), None if t is None else len(t), "f", 1, 0.5, "p", 7) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
