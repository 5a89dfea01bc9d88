import pytest
from pyspark.sql import types as T

# Edge cases: null, empty and long texts, ties, repeated rows, null ids and clashing extra columns.
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box with five dozen liquor jugs near quiet rivers".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1) + i * i * seed) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


BASE = " ".join(f"w{i}" for i in range(200))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", "en", None, 4), (4, "word", None, "b", 4),
    (5, BASE, "en", "a", 1), (6, BASE, "de", "b", 1), (7, BASE.replace("w100", "x"), "en", "a", 1),
    (8, BASE.replace("w10 ", "y ").replace("w150", "z"), "en", "c", 1),
    (9, prose(3, 60), "fr", "a", 9), (10, prose(4, 60), "fr", "a", 9), (10, prose(4, 60), "fr", "a", 9), (10, prose(6, 30), "fr", "a", 9),
    (None, prose(5, 20), "en", "a", 2), (None, None, None, None, None),
    (11, "Licensed under CC-BY 4.0.\nGNU General Public License version 3, all rights reserved. cc by cc by", "en", "a", 3),
    (12, "é" * 500 + " " + "x" * 3000 + " all\nrights...RESERVED", "fr", "z", 5),
    (13, "you idiot, pathetic loser and worthless scum, moron", "en", "a", 6),
    (14, "QUIET RIVERS!! " * 40 + prose(9, 150), "en", "a", 7), (15, prose(9, 150), "en", "b", 8),
    (16, "don't  we'll\n\n\n 123abc  … “quoted” 日本語テキスト 🙂🙂 <|endoftext|>", "ja", "a", 9),
    (17, " ".join(f"t{i % 97}" for i in range(9000)), "en", "a", 10),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def spark():
    from segmenter.session import build_session
    return build_session(master="local[*]", shuffle_partitions=4)


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    # Extra columns under names that the operators use inside.
    for c in ("start", "shard", "rep", "token", "h", "row", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
