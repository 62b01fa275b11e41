"""Awkward rows that every operator must take."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PROSE = ("the quick brown fox jumps over the lazy dog while seven bright zebras quietly watch from a green hill "
         "near the old stone bridge that crosses the river at dawn")
TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE),              # copies, and a row repeated whole
    (3, PROSE.replace("zebras", "horses")), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  TWO"),
    (9, LONG), (10, LONG + " tail"), (None, "a row without an id"), (11, "naïve café – ünïcode 文字 \U0001F600 ok"),
]
#: names that operators use inside
CLASHES = ("key", "n", "score", "component_id", "ties", "part", "bucket", "_mix_epoch", "spans", "text_crc32")


def documents(spark, rows=TEXTS, clashes=True):
    extra = CLASHES if clashes else ()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in extra]])
    data = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 2}", None,
             *[None if k % 2 else "x"] * len(extra)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema)
