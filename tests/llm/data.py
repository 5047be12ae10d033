"""Small documents, with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the of and house water green river stone market morning evening people always window street garden letter number little".split()
FRENCH = "le de et maison eau vert rivière pierre marché matin soir gens toujours fenêtre rue jardin lettre nombre petit être".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + (str(rng.randrange(999)) if rng.random() < 0.3 else "") for _ in range(n))


def documents(n=60, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        text = "\n".join(sentence(rng, ENGLISH if lang == "en" else FRENCH, rng.randrange(12, 30)) for _ in range(rng.randrange(1, 6)))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    return rows


def awkward():
    """Null and empty fields, white space, one very long text, equal rows, and an id with two texts."""
    long = " ".join(f"word{i}" for i in range(30_000))
    return [
        (900, None, "en", "s0", None), (901, "", None, None, 0), (902, "   \n\t ", "en", "s1", 6), (903, long, "en", "s2", len(long)),
        (904, "twice the same row here", "en", "s1", 23), (904, "twice the same row here", "en", "s1", 23), (905, "one text", "en", "s1", 8), (905, "another text", None, "s1", 12),
        (None, "a row without any id", "en", "s0", 20), (906, "12345 !!! 678", None, None, 13), (907, "x", "fr", None, 1)]


def frame(spark, rows, extra=()):
    """A frame of documents, with further columns named as operators name theirs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("mine"))
    return df
