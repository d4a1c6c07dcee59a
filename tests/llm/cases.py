"""Hand-made rows with the awkward cases every operator must survive."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside: they must neither clash nor be lost.
    T.StructField("id", T.StringType()), T.StructField("size", T.LongType()), T.StructField("words", T.StringType()),
    T.StructField("keep_id", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("component", T.LongType()),
    T.StructField("rank", T.StringType()), T.StructField("mark", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("bucket", T.LongType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


def frame(spark, rows):
    """rows: (doc_id, text, source) -> a table of documents with clashing extra columns."""
    full = [(i, t, "en", s, None if t is None else len(t), f"x{i}", 7, "w", "k", "maybe", 5, "r", "m", 1, 2, {"a": "b"})
            for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed, alphabet=400):
    r = random.Random(seed)
    return [f"w{r.randrange(alphabet)}" for _ in range(n)]


def awkward():
    """Nulls, empty and blank texts, few words, repeated rows, equal texts up to white space, long and odd texts."""
    base = " ".join(words(120, 1))
    return [
        (1, base, "a"), (2, base.replace(" ", "\n"), "a"), (2, base.replace(" ", "\n"), "a"), (3, base + "  ", None),
        (4, None, "a"), (5, "", "b"), (6, " \t\n\x0b\x0c\r", "b"), (None, base, "b"), (None, None, None), (7, "one two", "c"),
        (8, "One TWO", "c"), (9, " é𝔘 中文 ñ x", "c"), (10, " ".join(words(30000, 2, 5000)), "d"),
        (11, "x" * 200000, "d"), (12, "a b c d e", "d"), (13, "A b  c\td e", "d"), (14, "a b c d e f", "e"),
        (15, "same line of it\n" * 40, "e"), (16, base + " tail of words", "e"), (17, "", None),
    ]
