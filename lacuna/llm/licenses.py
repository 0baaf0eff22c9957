"""License scans by diagonal voting.

All rolling word pairs of all texts are joined with the pairs of a small set of
license templates.  A match at word i of the text and word j of the template votes
for the diagonal i - j.  A diagonal with all the pairs of a template is the template
word for word; neighbouring diagonals, as words put in or left out make them, are
merged and their span verified by the share of the template that it covers.

Only Spark expressions run here.  Null and empty texts have no words and no labels.  A very long text is read whole,
as an array of its words; an empty table gives an empty result; labels are sorted and
first and last places are extremes, so there are no ties.
Identical rows (same id and text) are scanned as often as they stand there and get a
result each.  Only `doc_id` and `text` are read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import read, stored, whole_text
from lacuna.llm.native_words import words

# Phrases that are reported wherever their words stand, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Templates of this operator's own, matched with gaps where they are long.
TEMPLATES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "all rights reserved": "reserved",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the apache license version 2 0": "apache",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Templates of fewer words have to stand word for word.
LONG = 6
#: Share of a long template that a span has to cover, and its length against the template's.
COVERED = 0.8
STRETCH = 1.5
#: Diagonals at most this far apart are merged.
NEAR = 2
_ALL = [*((p, label, True) for p, label in PHRASES.items()), *((p, label, False) for p, label in TEMPLATES.items())]


def template_pairs(spark: SparkSession) -> DataFrame:
    """Each word pair of each template; as many rows as the lists above have words."""
    rows = ", ".join(
        str((n, j, len(w) - 1, w[j], w[j + 1]))
        for n, (phrase, _, _) in enumerate(_ALL)
        for w in [phrase.split()]
        for j in range(len(w) - 1)
    )
    pairs = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, j, pairs, first, second)")
    return pairs.withColumn("pair", F.xxhash64("first", "second"))


def votes(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text_key): a row per template and diagonal, and one without template per document.

    The latter carries n_words and how many identical rows there are; with it, one
    pass over the texts is enough.  Pairs that match nothing go before any shuffle.
    """
    split = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), F.array_append(words(), "").alias("words"))
    each = split.select("doc_id", "text_key", "words", F.posexplode("words")).withColumnsRenamed({"pos": "i", "col": "w"})
    following = F.get("words", F.col("i") + 1)
    paired = each.select("doc_id", "text_key", "i", "w", following.alias("w2"), F.xxhash64("w", following).alias("pair"))
    t = F.broadcast(template_pairs(docs.sparkSession))  # a fixed list
    hits = paired.join(t, (paired["pair"] == t["pair"]) & (paired["w"] == t["first"]) & (paired["w2"] == t["second"]), "left")
    return (
        hits.where(F.col("template").isNotNull() | (F.col("w") == ""))
        .groupBy("doc_id", "text_key", "template", (F.col("i") - F.col("j")).alias("diagonal"))
        .agg(
            F.max("pairs").alias("pairs"), F.collect_set("j").alias("covered"), F.min("i").alias("low"), F.max("i").alias("high"),
            F.count("*").alias("n"),
        )
    )


def merged(found: DataFrame) -> DataFrame:
    """Spans of templates: neighbouring diagonals as one, with the share of the template that they cover."""
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > NEAR
    run = F.sum(F.when(apart, 1).otherwise(0)).over(order)
    return (
        found.where("template IS NOT NULL").withColumn("run", run)
        .groupBy("doc_id", "text_key", "template", "run")
        .agg(
            F.max("pairs").alias("pairs"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"),
            F.min("low").alias("low"), (F.max("high") + 1).alias("high"),
        )
        .withColumn("share", F.col("covered") / F.col("pairs"))
        .withColumn("sound", F.expr(
            f"share = 1 AND high - low = pairs OR pairs + 1 >= {LONG} AND share >= {COVERED} AND high - low <= {STRETCH} * pairs"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """A result for each document: words, places of the phrases, labels and the best share."""
    found = stored(votes(docs), "license-votes")  # read twice, and small beside the texts
    label = F.element_at(F.create_map(*(F.lit(x) for n, (_, name, _) in enumerate(_ALL) for x in (n, name))), F.col("template"))
    base = F.col("template") < len(PHRASES)
    whole = F.size("covered") == F.col("pairs")
    exact = found.select(
        "doc_id", "text_key",
        F.when(F.col("template").isNull(), F.col("low")).alias("n_words"), F.when(F.col("template").isNull(), F.col("n")).alias("copies"),
        F.when(whole & base, F.col("diagonal")).alias("place"), F.when(whole, label).alias("label"), F.when(whole & base, label).alias("base_label"),
        (F.size("covered") / F.col("pairs")).alias("share"),
    )
    near = merged(found).select(
        "doc_id", "text_key", *(F.lit(None).cast(t).alias(c) for c, t in (("n_words", "int"), ("copies", "long"), ("place", "int"))),
        F.when(F.col("sound"), label).alias("label"), F.lit(None).cast("string").alias("base_label"),
        F.when(F.col("sound"), F.col("share")).alias("share"),
    )
    listed = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    out = exact.unionAll(near).groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("place").alias("n_base"), F.min("place").cast("long").alias("first_word"),
        F.max("place").cast("long").alias("last_word"), listed("base_label").alias("base_labels"), listed("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.max("copies").cast("int").alias("copies"),
    )
    return out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies", "text_key", "col")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


_TEMPLATE_ROWS = ", ".join(
    f"({n}, {j}, {len(w) - 1}, '{w[j]}', '{w[j + 1]}', '{label}', {str(base).lower()})"
    for n, (phrase, label, base) in enumerate(_ALL) for w in [phrase.split()] for j in range(len(w) - 1)
)
SQL = rf"""
WITH t(template, j, pairs, a, b, label, base) AS (VALUES {_TEMPLATE_ROWS}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT r, i - 1 AS i, words[i] AS a, words[i + 1] AS b FROM (SELECT r, words, unnest(range(1, len(words))) AS i FROM d)),
v AS (SELECT r, template, i - j AS diagonal, any_value(label) AS label, any_value(base) AS base, max(pairs) AS pairs,
        list(DISTINCT j) AS covered, min(i) AS low, max(i) AS high FROM p JOIN t USING (a, b) GROUP BY r, template, i - j),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {NEAR} THEN 1 ELSE 0 END AS apart FROM v),
n AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM o),
s AS (SELECT r, label, len(list_distinct(flatten(list(covered)))) / max(pairs) AS share, max(pairs) AS pairs, min(low) AS low, max(high) + 1 AS high
      FROM n GROUP BY r, template, run, label),
e AS (SELECT r, CASE WHEN len(covered) = pairs AND base THEN diagonal END AS place, CASE WHEN len(covered) = pairs THEN label END AS label,
        CASE WHEN len(covered) = pairs AND base THEN label END AS base_label, len(covered) / pairs AS share FROM v
      UNION ALL SELECT r, NULL, label, NULL, share FROM s
      WHERE share = 1 AND high - low = pairs OR pairs + 1 >= {LONG} AND share >= {COVERED} AND high - low <= {STRETCH} * pairs),
g AS (SELECT r, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT base_label, ',' ORDER BY base_label) AS bl,
        string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(share) AS share FROM e GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl, '') AS base_labels, coalesce(l, '') AS labels,
  coalesce(share, 0)::DOUBLE AS score FROM d LEFT JOIN g USING (r)
"""

QUERIES = {"op6_license_scans": (op6_license_scans, SQL)}
