"""Benchmark decontamination over a positional inverted index.

A window is `WINDOW` consecutive words of a benchmark item (a shorter item is one
window).  The steps:

1. frequencies of the benchmark's terms in the training texts;
2. of each window, its rarest terms (anchors): two, and for near matches one more than
   a window may lack;
3. an index of the training texts: a posting (document, position) for each occurrence
   of an anchor, with the hashes of the words around it, kept where these share enough
   with the words around the anchor in its item;
4. exact matches: the lists of a window's two rarest terms are moved by their offsets in
   the item and intersected on (document, item, offset), and what is left is verified
   word by word in the neighbourhoods that the postings carry;
5. near matches: a stretch of as many words as a window that holds at least `NEAR` of
   the window's words, in any order, found in the same neighbourhoods.

So common terms, which fill most of the texts, have no lists, nothing but likely places
leaves a task, and texts are never shuffled.  Tables made from the benchmark alone are
stored and read back; they are broadcast where their size allows, and joined beyond.
Equal 64-bit hashes of words count as equal words.

A very long text is read whole, as an array of its words' hashes; empty tables give no
matches; equally rare words are taken by their place.

Null and empty texts have no words; null and empty items have no windows; an item
without id marks words but is not listed.  Repeated items count once.  Identical rows
(same id and text) get a result each.  Only `doc_id`, `item_id` and `text` are read.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import read, stored, whole_text
from lacuna.llm.native_words import words

WINDOW = 10
#: Share of a window's words that a near match has in as many words of the text, in any order.
NEAR = 0.8
#: Stands for the end of a text among its words' hashes.
END = -0x7A3D_51C6_0E92_4B8F
#: Places that are broadcast, of at most some 200 bytes each; more are joined.
BROADCAST = 200_000


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (a key) and its words."""
    split = benchmark.select(F.col("item_id").cast("string"), words().alias("words"))
    return stored(split.where(F.size("words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "words")), "benchmark-items")


def _each_word(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, term of all words, and an empty term behind the last; `words` goes along."""
    split = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), F.array_append(words(), "").alias("words"))
    return split.select("doc_id", "text_key", "words", F.posexplode("words")).withColumnsRenamed({"col": "term"})


def frequencies(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How often each term of the items occurs in the texts; counted in each task before the shuffle."""
    asked = stored(items.select(F.explode("words").alias("term")).distinct(), "benchmark-terms")
    return _each_word(docs).select("term").join(asked, "term").groupBy("term").agg(F.count("*").alias("n"))


def _ranked(items: DataFrame, frequency: DataFrame, width: int) -> DataFrame:
    """item, s, size of each window, and its places with their terms' frequencies, rarest first (`rare`)."""
    size = F.least(F.size("words"), F.lit(width))
    start = F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("s")
    spots = items.select("item", "words", size.alias("size"), start).select(
        "item", "size", "s", F.posexplode(F.slice("words", F.col("s") + 1, F.col("size"))).alias("o", "term"))
    known = stored(frequency, "term-frequencies")
    n = F.coalesce("n", F.lit(0)).alias("n")
    return spots.join(known, "term", "left").groupBy("item", "s").agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct(n, (F.col("s") + F.col("o")).alias("p")))).alias("rare"))


def anchors(items: DataFrame, frequency: DataFrame, width: int = WINDOW, share: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """The places by which matches are found, and which of them exact ones need.

    First table: item, p, term_key, `item_words`, the hashes of the words around p, and
    `item_at`, where p is in them; k, the words of a window; `needed`, those of a near
    match.  Of its rarest words, one more than a window may lack, a near match has one
    at least; words that no text has are among those it lacks.  `distinct` is the least
    number of different words that a match has in common with these: outside a window,
    and by repetition in it, no more go than there are places.  Second table: item,
    item_id, and `pairs`, the two rarest places of each window that can stand in a text
    as it is.  Both are as large as the benchmark.
    """
    ranked = stored(_ranked(items, frequency, width), "ranked-windows")
    exact = ranked.where(F.col("rare")[0]["n"] > 0).select("item", F.col("rare")[0]["p"].alias("p1"), F.get("rare", F.lit(1))["p"].alias("p2")).distinct()
    pairs = items.select("item", "item_id").join(exact.groupBy("item").agg(F.collect_list(F.struct("p1", "p2")).alias("pairs")), "item")
    few = F.greatest(F.col("size") - _needed(F.col("size"), share) + 1, F.least(F.lit(2), F.col("size")))
    found = ranked.select("item", F.explode(F.slice("rare", F.lit(1), few)).alias("r")).where("r.n > 0").select("item", "r.p").distinct()
    low = F.greatest(F.col("p") - (width - 1), F.lit(0))
    around = F.transform(F.slice("words", low + 1, F.col("p") - low + width), lambda w: F.xxhash64(w))
    placed = found.join(items.select("item", "words"), "item").select(
        "item", "p", F.xxhash64(F.expr("words[p]")).alias("term_key"), around.alias("item_words"), (F.col("p") - low).alias("item_at"),
        F.least(F.size("words"), F.lit(width)).alias("k")).withColumn("needed", _needed(F.col("k"), share))
    distinct = F.expr("size(array_distinct(item_words)) - size(item_words) + needed").alias("distinct")
    return stored(placed.select("*", distinct), "anchors"), stored(pairs, "anchor-pairs")


def _needed(size: Column, share: float) -> Column:
    """How many of so many words are the share."""
    return F.ceil(F.round(size * share, 6)).cast("int")


def index(docs: DataFrame, places: DataFrame, width: int = WINDOW) -> DataFrame:
    """Stored postings of the anchors, kept where the words around them share enough with the item's.

    doc_id, text_key, pos, the columns of `places`, and `doc_words`, the hashes around
    pos, with `doc_at`, where pos is in them.  One more row per document has no item
    and, as its pos, the number of words.
    """
    end = F.lit(END).cast("long")
    closing = places.sparkSession.range(1).select(
        *(end.alias(c) if c == "term_key" else F.lit(0).alias(c) if c == "distinct" else F.lit(None).cast(t).alias(c) for c, t in places.dtypes))
    known = places.unionByName(closing)
    hashes = F.array_append(F.transform(words(), lambda w: F.xxhash64(w)), end)
    each = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), hashes.alias("hashes")).select(
        "doc_id", "text_key", "hashes", F.posexplode("hashes").alias("pos", "term_key"))
    met = each.join(F.broadcast(known) if places.count() <= BROADCAST else known, "term_key")
    low = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    # The end of a text is no word.
    doc_words = F.slice("hashes", low + 1, F.least(F.col("pos") - low + width, F.size("hashes") - 1 - low))
    around = met.withColumn("doc_words", F.when(F.col("item").isNotNull(), doc_words))
    likely = F.col("item").isNull() | (F.size(F.array_intersect("item_words", "doc_words")) >= F.col("distinct"))
    return stored(around.where(likely).select(
        "doc_id", "text_key", "pos", "item", "p", "k", "needed", "item_words", "item_at", "doc_words", (F.col("pos") - low).alias("doc_at")), "postings")


def _agree(a: Column, b: Column) -> Column:
    """How many leading words two arrays share."""
    first_other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(a))


def phrases(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact matches: doc_id, text_key, item, item_id, and the stretch of words low to high.

    A posting moved by its offset says where the item would begin in the document.
    """
    before = lambda w, at: F.reverse(F.slice(w, 1, F.col(at)))
    after = lambda w, at: F.slice(w, F.col(at) + 2, F.size(w))
    moved = postings.where("item IS NOT NULL").select(
        "doc_id", "text_key", "item", "k", (F.col("pos") - F.col("p")).alias("begin"),
        F.struct("p", _agree(before("doc_words", "doc_at"), before("item_words", "item_at")).alias("a"),
                 _agree(after("doc_words", "doc_at"), after("item_words", "item_at")).alias("b")).alias("at"))
    met = moved.groupBy("doc_id", "text_key", "item", "k", "begin").agg(F.collect_set("at").alias("ats")).join(pairs, "item")
    both = F.expr("exists(pairs, q -> exists(ats, x -> x.p = q.p1) AND (q.p2 IS NULL OR exists(ats, x -> x.p = q.p2)))")
    runs = met.where(both).select("doc_id", "text_key", "item", "item_id", "begin", "k", F.explode("ats").alias("x"))
    return runs.where("x.a + x.b + 1 >= k").selectExpr(
        "doc_id", "text_key", "item", "item_id", "begin + x.p - x.a AS low", "begin + x.p + x.b AS high")


def proximity(likely: DataFrame) -> DataFrame:
    """doc_id, text_key, item and share: stretches with enough of a window's words, in any order.

    A word counts as often as it stands in both.
    """
    runs = lambda w: f"transform(sequence(0, greatest(size({w}) - k, 0)), i -> slice({w}, i + 1, k))"
    both = "aggregate(array_distinct(w), 0, (t, x) -> t + least(size(filter(w, y -> y = x)), size(filter(d, y -> y = x))))"
    close = f"filter({runs('item_words')}, w -> size(filter(w, x -> array_contains(doc_words, x))) >= needed)"
    best = f"coalesce(array_max(flatten(transform({close}, w -> transform({runs('doc_words')}, d -> {both})))), 0)"
    # Passages that many documents share are measured once.
    pair = F.xxhash64("item_words", "doc_words", "k", "needed")
    keyed = likely.withColumn("pair", pair)
    distinct = keyed.groupBy("pair").agg(*(F.first(c).alias(c) for c in ("item_words", "doc_words", "k", "needed")))
    met = distinct.withColumn("met", F.expr(best)).where("met >= needed").select("pair", (F.col("met") / F.col("k")).alias("share"))
    return keyed.select("doc_id", "text_key", "item", "pair").join(stored(met, "near-pairs"), "pair").groupBy("doc_id", "text_key", "item").agg(F.max("share").alias("share"))


def near_matches(postings: DataFrame, exact: DataFrame) -> DataFrame:
    """doc_id, text_key, item and share of near matches of items that do not stand there as they are.

    exact: doc_id, text_key and item of exact matches.
    """
    likely = postings.where("item IS NOT NULL").select("doc_id", "text_key", "item", "k", "needed", "item_words", "doc_words")
    known = exact.select(F.col("doc_id").alias("x_id"), F.col("text_key").alias("x_key"), F.col("item").alias("x_item")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("text_key") == F.col("x_key")) & (F.col("item") == F.col("x_item"))
    return proximity(likely.join(known, same, "left_anti"))


@dataclass
class Matches:
    """What stands in the documents: stretches low to high of exact matches, near matches, and the postings."""

    exact: DataFrame
    near: DataFrame
    postings: DataFrame
    items: DataFrame


def find_all(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = NEAR) -> Matches:
    """Exact and near matches, from one index; with a share of 1 it has what exact ones need."""
    items = benchmark_items(benchmark)
    places, pairs = anchors(items, frequencies(docs, items), width, share)
    postings = index(docs, places, width)
    exact = stored(phrases(postings, pairs), "exact-matches")
    return Matches(exact, near_matches(postings, exact), postings, items)


def all_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = NEAR) -> DataFrame:
    """Exact and near matches: doc_id, text_key, item_id, exact, and the largest share.

    A row for each document (by id and text) and item; an item without id has rows too.
    """
    found = find_all(docs, benchmark, width, share)
    exact = found.exact.select("doc_id", "text_key", "item", F.lit(True).alias("exact"), F.lit(1.0).alias("share")).distinct()
    near = found.near.select("doc_id", "text_key", "item", F.lit(False).alias("exact"), "share")
    return exact.unionAll(near).join(found.items.select("item", "item_id"), "item").drop("item")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """All exact matches (see `phrases`)."""
    return find_all(docs, benchmark, width, 1.0).exact


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """A row per document: n_words, n_hit, `items`, the ids of items with windows in it, and `near`, of others with near matches."""
    found = find_all(docs, benchmark, width)
    none = {"n_words": "int", "item_id": "string", "near_id": "string", "hit": "int"}
    rows = lambda df, **have: df.select("doc_id", "text_key", *(F.col(have[c]).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in none.items()))
    hits = rows(found.exact.select("doc_id", "text_key", "item_id", F.explode(F.sequence("low", "high")).alias("hit")).distinct(), item_id="item_id", hit="hit")
    near = rows(found.near.join(found.items.select("item", "item_id").where("item_id IS NOT NULL"), "item"), near_id="item_id")
    ends = rows(found.postings.where("item IS NULL"), n_words="pos")
    one = hits.unionAll(near).unionAll(ends).groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").cast("int").alias("copies"),
        F.size(F.collect_set("hit")).cast("long").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"), F.collect_set("near_id").alias("near"))
    one = one.withColumn("near", F.sort_array(F.array_except("near", "items")))
    return one.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies", "col")


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, near: bool = False) -> DataFrame:
    """The documents without any exact match, with `near` without near ones too; columns as they came."""
    if near:
        found = all_matches(docs, benchmark, width)
    else:
        found = matches(docs, benchmark, width)
    found = stored(found.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("text_key"))
    clean = rows.join(found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left_anti")
    return clean.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), F.sha2(F.concat_ws(",", "near"), 256).alias("near_sha256"))


def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and item: whether the item stands there, or most of the words of a window."""
    found = all_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.when(F.col("exact"), "exact").otherwise("near").alias("match"), "share")


_SPLIT = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item_id, {_SPLIT} AS w FROM benchmark),
sized AS (SELECT *, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM sized)),
seen AS (SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d JOIN (SELECT DISTINCT k FROM win) ON len(w) >= k)),
m AS (SELECT r, s, k, item_id FROM seen JOIN win USING (k, g)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r),
bi AS (SELECT row_number() OVER () AS item, *, ceil(round(k * {NEAR}, 6))::INT AS needed FROM sized WHERE item_id IS NOT NULL),
places AS (SELECT item, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM bi),
posted AS (SELECT r, pos, term FROM (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d) SEMI JOIN places USING (term)),
freq AS (SELECT term, count(*) AS n FROM posted GROUP BY term),
starts AS (SELECT item, k, needed, unnest(range(1, len(w) - k + 2)) AS s FROM bi),
rare AS (SELECT item, p, term, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item, s ORDER BY coalesce(n, 0), p) <= k - needed + 1 AS few
  FROM starts JOIN places USING (item) LEFT JOIN freq USING (term) WHERE p BETWEEN s AND s + k - 1),
around AS (SELECT DISTINCT r, bi.item, item_id, k, needed, bi.w[greatest(p - {WINDOW} + 1, 1) : p + {WINDOW} - 1] AS iw, d.w[greatest(pos - {WINDOW} + 1, 1) : pos + {WINDOW} - 1] AS dw
  FROM (SELECT DISTINCT item, p, term FROM rare WHERE few AND n > 0) JOIN posted USING (term) JOIN bi USING (item) JOIN d USING (r)),
likely AS (SELECT * FROM around WHERE len(list_intersect(iw, dw)) >= len(list_distinct(iw)) - len(iw) + needed),
combos AS (SELECT r, item_id, needed, iw[s : s + k - 1] AS x, unnest(range(1, greatest(len(dw) - k, 0) + 2)) AS t, dw, k
  FROM (SELECT *, unnest(range(1, len(iw) - k + 2)) AS s FROM likely)),
close AS (SELECT r, item_id, needed, x, dw[t : t + k - 1] AS y FROM combos),
near AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS near_ids FROM (
  SELECT DISTINCT r, item_id FROM close
  WHERE len(list_intersect(x, y)) >= needed - (len(x) - len(list_distinct(x)))
    AND list_sum(list_transform(list_distinct(x), lambda e: least(len(list_filter(x, lambda v: v = e)), len(list_filter(y, lambda v: v = e))))) >= needed
  EXCEPT SELECT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AS contaminated, coalesce(near.n, 0) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN near USING (r)
"""

QUERIES = {
    "op7_benchmark_decontamination": (op7_benchmark_decontamination, SQL),
    "benchmark_matches": (benchmark_matches, None),
}
