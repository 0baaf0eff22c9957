"""Phrase collocations by set-oriented relational mining (SETM).

Relations of occurrences are kept as tables, sorted by place.  A place counts words and
ends of pieces, so places of neighbours in one piece, and only these, differ by one.

1. Words are counted per language; the relation of level 1 has the places of frequent
   words with the word's id.
2. Level k joins its relation with itself, by piece and neighbouring place: an
   occurrence of a phrase and the one a place further on are an occurrence of the phrase
   longer by one word.  As both sides are sorted, the join is one merge.
3. Its groups are counted over all documents, partly in each block first.
4. Frequent groups get ids, and the occurrences semi-joined with them are the next
   level's relation.

A relation's rows are stretches of a block of documents with their places and ids, cut where
no neighbours stand, so what a task, its reader and its Python worker hold at a time is a few
short rows; levels are read where they lie, and only counts of groups are shuffled.
Groups are told to the tasks as sorted keys while they are at most EXACT; beyond, as a
bitmap of fixed size, which keeps all frequent groups and lets some others through to
the next count, where they are too few: results are the same, tables larger.

Scores of cuts, phrases inside longer ones, and the best of each language are joins and
groupings of the frequent phrases alone.

Null and empty texts have no words; a null language is `und`.  Very long texts take
memory in proportion to their words, each in a block of its own; a text's pieces never
meet another's.  Repeated rows count each.  Ties are settled by count, then phrase.  An
empty table gives no rows.  Only `text` and `lang` are read.  Equal 64-bit hashes of
words of one language count as equal words within a block and from one pass to the next.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lacuna.llm.common import arrow_rows, read, setting, stored
from lacuna.llm.words import mix, word_spans

LEAST = 30
LONGEST = 4
TOP = 2000
#: Part of a phrase's occurrences within a longer one from which on it is dropped, in percent.
INSIDE = 80
NO_LANGUAGE = "und"
#: Frequent groups told to tasks one by one (24 bytes each), and the bits that stand for more.
EXACT = 2_000_000
BITS = 28
#: Bytes of texts in a block; a longer text is a block by itself.
BLOCK_BYTES = 1_000_000
#: Places in a row of a relation, from which on it ends with the piece.
ROW_PLACES = 10_000
#: Texts, and rows of a relation, that a task is handed at once.
TEXT_ROWS, RELATION_ROWS = 1000, 16
#: Rows of a relation that Spark reads at once, and bytes that it gathers before it writes them.
READ_ROWS, WRITE_BYTES = 64, 16 << 20

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)]] = False
_PIECE_END = ~_WORD
_PIECE_END[[0x20, 0x09]] = False


def _languages(langs: list[str | None]) -> np.ndarray:
    """A hash of each language, which sets its words apart from other languages'."""
    known = {name: mix(word_spans(["x" + name.encode("utf-8", "surrogatepass").hex()], _WORD, lower=False)[3])[0] for name in set(langs)}
    return np.array([known[name] for name in langs], np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, tuple]]:
    """Of each block of documents: languages, hash and place of each word, (bytes, starts, ends, language of each word)."""
    for batch in batches:
        sizes = [n or 0 for n in pc.binary_length(batch.column(0)).to_pylist()]
        at = 0
        while at < len(sizes):
            to, size = at + 1, sizes[at]
            while to < len(sizes) and size + sizes[to] <= BLOCK_BYTES:
                size += sizes[to]
                to += 1
            texts, langs = (batch.column(c).slice(at, to - at).to_pylist() for c in (0, 1))
            langs = [x if x is not None else NO_LANGUAGE for x in langs]
            # A piece end before each text parts it from the one before.
            raw, start, end, words, first = word_spans(["\n" + (t or "") for t in texts], _WORD, lower=True)
            owner = np.repeat(np.arange(to - at, dtype=np.int32), np.diff(first))
            place = np.cumsum(_PIECE_END[raw], dtype=np.int32)[start] + np.arange(len(start))
            yield langs, words ^ _languages(langs)[owner], place, (raw, start, end, owner)
            at = to


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, key (its hash) and n of all words, and one row per language without a word that counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, keys, _, (raw, start, end, owner) in _blocks(batches):
            key, one, n = np.unique(keys, return_index=True, return_counts=True)
            blob = raw.tobytes()
            word = [blob[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            name = [langs[o] for o in owner[one]]
            total: dict[str, int] = {}
            for lang, many in zip(langs, np.bincount(owner, minlength=len(langs)).tolist(), strict=True):
                total[lang] = total.get(lang, 0) + many
            total = {lang: many for lang, many in total.items() if many}
            yield pa.RecordBatch.from_arrays(
                [pa.array(name + list(total), pa.string()), pa.array(word + [None] * len(total), pa.string()),
                 pa.array(np.append(key.view(np.int64), np.zeros(len(total), np.int64))), pa.array(np.append(n, list(total.values())).astype(np.int64))],
                ["lang", "word", "key", "n"])

    counted = docs.select("text", "lang").mapInArrow(run, "lang string, word string, key long, n long")
    return counted.groupBy("lang", "word").agg(F.min("key").alias("key"), F.sum("n").alias("n"))


@dataclass
class Frequent:
    """Frequent groups as tasks know them: keys in order, whose ranks are ids, or a bitmap of hashed keys."""

    keys: np.ndarray | None
    bits: np.ndarray | None

    @classmethod
    def of(cls, groups: DataFrame) -> "Frequent":
        """groups: a stored table with `key`, at most EXACT of which come to the driver."""
        if groups.count() <= EXACT:
            return cls(np.sort(groups.select("key").toArrow().column(0).to_numpy().view(np.uint64)), None)
        spread = F.pmod(F.xxhash64("key"), F.lit(1 << BITS))
        # At most 2 ** BITS / 64 rows, whatever the number of groups.
        some = groups.groupBy(F.shiftright(spread, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, int(pmod(xxhash64(key), {1 << BITS}) & 63)))").alias("bits")).toArrow()
        bits = np.zeros(1 << (BITS - 6), np.uint64)
        bits[some["at"].to_numpy()] = some["bits"].to_numpy().view(np.uint64)
        return cls(None, bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are frequent, and the ids of these."""
        if self.keys is not None:
            at = np.searchsorted(self.keys, keys)
            ok = at < len(self.keys)
            ok[ok] = self.keys[at[ok]] == keys[ok]
            return ok, at[ok].astype(np.int32)
        spread = xxhash64(keys) & np.uint64(64 * len(self.bits) - 1)
        ok = (self.bits[(spread >> np.uint64(6)).astype(np.int64)] >> (spread & np.uint64(63))) & np.uint64(1) == 1
        return ok, keys[ok].view(np.int64)


def xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long values."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.uint64(42 + 8) + p5 ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def pair_key(left: np.ndarray, right: np.ndarray, dense: bool) -> np.ndarray:
    """One key for two ids: both side by side if they are ranks, else a hash of them."""
    left, right = left.astype(np.uint64), right.astype(np.uint64)
    return (left << np.uint64(32)) | right if dense else mix(mix(left) + right * np.uint64(0x9E3779B97F4A7C15))


def _relation(place: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """Rows that begin at the cuts."""
    ends = pa.array(np.append(cuts, len(ids)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(ids))], ["place", "id"])


def _cuts(place: np.ndarray) -> np.ndarray:
    """Where rows of a block begin: at its start, and where the first two that are no neighbours stand after each ROW_PLACES."""
    gaps = np.flatnonzero(place[1:] != place[:-1] + 1) + 1
    at = np.searchsorted(gaps, np.arange(ROW_PLACES, len(place), ROW_PLACES))
    return np.unique(np.append(gaps[at[at < len(gaps)]], 0))


def _relation_schema(frequent: Frequent) -> str:
    """Ranks are numbers of 32 bits, hashes of 64."""
    return f"place array<int>, id array<{'int' if frequent.keys is not None else 'long'}>"


def first_relation(docs: DataFrame, frequent: Frequent) -> DataFrame:
    """Occurrences of frequent words, in rows of about ROW_PLACES."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, place, _ in _blocks(batches):
            ok, ids = shared.value.find(keys)
            yield _relation(place[ok], ids, _cuts(place[ok]))

    return docs.select("text", "lang").mapInArrow(run, _relation_schema(frequent))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Place, id and the id a place further on, of some rows, and where each row's begin: both sides are sorted by place, which is in a row once."""
    for batch in batches:
        place, ids = (batch.column(c).flatten().to_numpy() for c in (0, 1))
        begin = np.append(0, np.cumsum(pc.list_value_length(batch.column(0)).to_numpy()))
        near = place[1:] == place[:-1] + 1
        # The end of a row and the start of the next are no neighbours: they may be of two blocks.
        near[begin[(begin > 0) & (begin < len(place))] - 1] = False
        next_to = np.flatnonzero(near)
        yield place[next_to], ids[next_to], ids[next_to + 1], np.searchsorted(next_to, begin[:-1])


def group_counts(relation: DataFrame, dense: bool) -> DataFrame:
    """left, right and n of all pairs of ids at neighbouring places, and their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, right, _ in _joined(batches):
            key, one, n = np.unique(pair_key(left, right, dense), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (left[one], right[one], n)] + [pa.array(key.view(np.int64))], ["left", "right", "n", "key"])

    counted = relation.mapInArrow(run, "left long, right long, n long, key long")
    return counted.groupBy("left", "right").agg(F.sum("n").alias("n"), F.min("key").alias("key"))


def next_relation(relation: DataFrame, frequent: Frequent, dense: bool) -> DataFrame:
    """Occurrences of frequent phrases that are longer by one word."""
    shared = relation.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, left, right, begin in _joined(batches):
            ok, ids = shared.value.find(pair_key(left, right, dense))
            yield _relation(place[ok], ids, np.append(0, np.cumsum(ok))[begin])

    return relation.mapInArrow(run, _relation_schema(frequent))


def _with_ids(groups: DataFrame, frequent: Frequent) -> DataFrame:
    """The groups with the ids that relations have for them."""
    shared = groups.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy().view(np.uint64)
            yield batch.append_column("id", pa.array(shared.value.find(keys)[1].astype(np.int64)))

    return groups.mapInArrow(run, StructType([*groups.schema.fields, StructField("id", LongType())]))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, words and f of all phrases of up to `longest` words found `least` times; and lang and n, all words of each."""
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        counts = stored(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()), "setm-words")
        totals = counts.where("word IS NULL").select("lang", "n")
        words = counts.where("word IS NOT NULL")
        frequent = Frequent.of(words)
        dense = frequent.keys is not None
        level = stored(_with_ids(words, frequent).select("id", "lang", F.array("word").alias("words"), F.col("n").alias("f")), "setm-phrases")
        out, relation = [level], stored(first_relation(docs, frequent), "setm-relation", WRITE_BYTES)
    for size in range(2, longest + 1):
        with arrow_rows(spark, RELATION_ROWS), setting(spark, "spark.sql.parquet.columnarReaderBatchSize", READ_ROWS):
            groups = stored(group_counts(relation, dense).where(F.col("n") >= least), "setm-groups")
            frequent = Frequent.of(groups)
            if size < longest:
                relation = stored(next_relation(relation, frequent, dense), "setm-relation", WRITE_BYTES)
        dense = frequent.keys is not None
        lefts = level.select(F.col("id").alias("left"), "lang", "words")
        rights = level.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"))
        level = stored(_with_ids(groups, frequent).join(lefts, "left").join(rights, "right").select(
            "id", "lang", F.concat("words", F.array("last")).alias("words"), F.col("n").alias("f")), "setm-phrases")
        out.append(level)
    phrases = out[0]
    for more in out[1:]:
        phrases = phrases.unionAll(more)
    return phrases.drop("id"), totals


def collocations(phrases: DataFrame) -> DataFrame:
    """lang, words, a, l, r and score of the phrases of two words and more that no longer one stands for.

    Of all cuts the one with the lowest score counts, of equal ones the first.
    """
    f = phrases.select("lang", "words", "f")
    longer = f.where(F.size("words") > 1)
    cuts = longer.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).withColumns(
        {"head": F.slice("words", 1, F.col("k")), "tail": F.slice("words", F.col("k") + 1, F.size("words"))})
    cuts = cuts.join(f.select("lang", F.col("words").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(f.select("lang", F.col("words").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "words").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Phrases of two words and more inside each longer one.
    inner = longer.where(F.size("words") > 2).select("lang", F.col("f").alias("outer"), F.expr(
        "explode(flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), i -> slice(words, i, s)))))").alias("words"))
    inner = inner.groupBy("lang", "words").agg(F.max("outer").alias("outer"))
    kept = scored.join(inner, ["lang", "words"], "left").where(
        f"outer IS NULL OR CAST(outer AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * {INSIDE}")
    return kept.select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases, totals = frequent_phrases(read(spark, sf_dir, "documents"))
    found = collocations(phrases).withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= TOP)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT lang, d, unnest(cut) AS piece, generate_subscripts(cut, 1) AS p
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
               string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS cut
        FROM documents WHERE text IS NOT NULL)),
words AS (
  SELECT lang, d, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT lang, d, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
ahead AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY d, p ORDER BY i)),
phrases AS (
  SELECT lang, [w1] AS ws, count(*) AS f FROM ahead GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT * FROM phrases WHERE len(ws) > 1),
cuts AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.ws, c.a, c.k, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (h.f + t.f) AS BIGINT) AS score
  FROM cuts c JOIN phrases h ON h.lang = c.lang AND h.ws = c.ws[1:c.k] JOIN phrases t ON t.lang = c.lang AND t.ws = c.ws[c.k + 1:]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, ws, max(f) AS f FROM (
    SELECT lang, f, unnest([ws[1:2], ws[2:3]]) AS ws FROM candidates WHERE len(ws) = 3
    UNION ALL SELECT lang, f, unnest([ws[1:2], ws[2:3], ws[3:4], ws[1:3], ws[2:4]]) FROM candidates WHERE len(ws) = 4) GROUP BY lang, ws),
kept AS (
  SELECT s.*, array_to_string(s.ws, ' ') AS phrase FROM lowest s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.ws = s.ws
  WHERE i.f IS NULL OR 100 * i.f < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": (op11_collocations, SQL)}
