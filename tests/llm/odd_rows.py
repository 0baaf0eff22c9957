"""Small tables with the odd cases that every operator has to bear."""

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
ROWS = [
    (1, "plain words in a row, nothing odd about them at all", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", None),
    (4, " \t\n ", None, "a"),
    (5, LONG, "en", "a"),
    (6, "same text twice", "en", "b"),
    (7, "same text twice", "en", "b"),
    (7, "same text twice", "en", "b"),
    (None, "no id here", "de", "b"),
    (None, None, None, None),
    (8, "one\n\ntwo\none\ntwo\n  \n  ", "en", "b"),
    (9, "ünï cödé 字 😀 𝔘 | # $ end", "fr", "b"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def clashing(docs):
    """Extra columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "n_words shard slot size digest failed kept m key token score label row words pos bytes rows hash id n component_id old text_crc32 spans n_tokens virtual_slot".split()
    return docs.withColumns({n: F.lit("x") for n in names})


def folder(docs, path):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)
