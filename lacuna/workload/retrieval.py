"""Search over pages as chunks, for every benchmark text as a question."""

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.functions import tokens as T
from lacuna.operators import blind as B
from lacuna.operators import pages as P
from lacuna.operators import search as S
from lacuna.plans import ask
from lacuna.plans.index import Index
from lacuna.session import materialise, new_path
from lacuna.sources.tables import read_table
from lacuna.workload.passages import CHUNK_ROWS
from lacuna.workload.standins import (
    CHUNKS, QUESTIONS, STRUCTURED, finish, page_chunks, questions, sql_text, structured_pages, terms_sql,
)


def tokens(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", T.terms("text").alias("t"))
    flat = X.unnest(docs, "t", "term", "position")
    return finish(flat.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum(F.length("term")).alias("n_letters"), F.min("term").alias("least"), F.max("term").alias("greatest")))


def stems(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", T.raw_tokens("text").alias("t"))
    words = X.unnest(docs, "t", "word").where(T.keep_token("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("stem", T.singular("word")).where(F.col("stem").isNotNull())


def expanded_terms(spark, sf_dir):
    """Expansion of texts in which domain words were put in by position."""
    words = F.split(F.col("text"), " ", -1)
    domain = [k for k in V.SYNONYMS]
    mixed = F.array_join(F.transform(words, lambda w, i: F.concat(F.element_at(F.array(*[F.lit(d) for d in domain]), (i % len(domain) + 1).cast("int")), F.lit(" "), w)), " ")
    q = read_table(spark, sf_dir, "benchmark").withColumn("mixed", mixed).select("item_id", T.expanded("mixed").alias("t"))
    flat = X.unnest(q, "t", "term")
    return flat.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def _tokenised(spark, sf_dir):
    return S.tokenised(page_chunks(spark, sf_dir))


def postings(spark, sf_dir):
    posted = S.postings(_tokenised(spark, sf_dir))
    return finish(posted.select("document_id", "page_number", "term", "tf", "length"))


def term_df(spark, sf_dir):
    return S.document_frequency(S.postings(_tokenised(spark, sf_dir)))


def corpus_stats(spark, sf_dir):
    return S.corpus_stats(_tokenised(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


def _parts(spark, sf_dir):
    q = questions(spark, sf_dir)
    asked = S.query_terms(q)
    posted = S.relevant_postings(page_chunks(spark, sf_dir), asked)
    return q, asked, posted, S.query_weights(posted, asked)


def idf(spark, sf_dir):
    *_, weights = _parts(spark, sf_dir)
    return finish(weights.select("query_id", "document_id", "term", "weight", F.round("idf", 6).alias("idf")))


def bm25_scores(spark, sf_dir):
    q, _, posted, weights = _parts(spark, sf_dir)
    scored = S.scores(posted, weights, q)
    return scored.select("query_id", "document_id", "page_number", F.round("score", 4).alias("score"), "matched", "distinctive")


def bm25_definition_boost(spark, sf_dir):
    """Questions that ask for a definition, over pages half of which define something."""
    chunks = page_chunks(spark, sf_dir).withColumn(
        "text",
        F.when((F.col("page_number") % 2 == 0) & (F.col("page_quality") == "clean"),
               F.concat(F.lit("2."), F.col("page_number").cast("string"), F.lit(" Term of page: means this. "), F.col("text"))).otherwise(F.col("text")),
    )
    q = questions(spark, sf_dir).withColumn(
        "question", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("What is the meaning of "), F.col("question"))).otherwise(F.col("question"))
    )
    asked = S.query_terms(q)
    posted = S.relevant_postings(chunks, asked)
    weights = S.query_weights(posted, asked)
    top = S.top_hits(S.scores(posted, weights, q))
    return finish(top.select("query_id", "document_id", "page_number", "score", "rank"))


def bm25_topk(spark, sf_dir):
    q, _, posted, weights = _parts(spark, sf_dir)
    top = S.top_hits(S.scores(posted, weights, q))
    return finish(top.select("query_id", "document_id", "page_number", "score", "rank"))


def evidence_floor(spark, sf_dir):
    q, _, posted, weights = _parts(spark, sf_dir)
    kept = S.evidence_floor(S.top_hits(S.scores(posted, weights, q)))
    return finish(kept.select("query_id", "page_number", "score", "rank", "matched", "distinctive"))


def why_matched(spark, sf_dir):
    q, asked, posted, weights = _parts(spark, sf_dir)
    kept = S.evidence_floor(S.top_hits(S.scores(posted, weights, q)))
    hits = S.matched_terms(kept, posted, asked)
    return finish(hits.select("query_id", "page_number", "rank", F.array_join("matched_terms", " ").alias("matched_terms"),
                              S.why_matched(F.col("matched_terms")).alias("why")))


def region_descriptors(spark, sf_dir):
    r = B.blind_regions(page_chunks(spark, sf_dir))
    return finish(r.select("document_id", "page_start", "page_end", "descriptor", "following_context", B.describe().alias("description")))


def region_scores(spark, sf_dir):
    *_, weights = _parts(spark, sf_dir)
    scored = B.region_scores(B.blind_regions(page_chunks(spark, sf_dir)), weights)
    return finish(scored.select("query_id", "document_id", "page_start", "match_score",
                                F.array_join("matched_terms", " ").alias("matched_terms"), "query_relevant"))


def _answers(spark, sf_dir):
    return ask.answer(page_chunks(spark, sf_dir), questions(spark, sf_dir))


def regions_near_hits(spark, sf_dir):
    spots = _answers(spark, sf_dir).blind_spots
    return finish(spots.select("query_id", "document_id", "page_start", "page_end", "match_score", "query_relevant", "near_hit", "rank"))


def coverage_note(spark, sf_dir):
    return _answers(spark, sf_dir).coverage_notes


def image_pages(spark, sf_dir):
    r = B.blind_regions(page_chunks(spark, sf_dir))
    out = r.select("document_id", "page_start", F.explode(B.page_images()).alias("url"))
    return finish(out)


def numeric_provisions(spark, sf_dir):
    graded = P.grade_pages(structured_pages(spark, sf_dir))
    evidence = graded.select(
        "document_id", "page_number", "text", (F.col("page_number") % 3 == 0).alias("text_was_repaired"),
        F.when(F.col("page_number") % 4 == 0, "severe").alias("table_risk"))
    found = S.numeric_provisions(evidence, ["document_id", "page_number"])
    return finish(found.select("document_id", "page_number", F.col("at").alias("start_at"), "value", "unit", "context", "is_reliable", "caveat"))


def _chunked(spark, sf_dir):
    """The chunk table, stored once: a corpus is ingested once and asked often."""
    return materialise(ask.ingest(structured_pages(spark, sf_dir)))


def passage_hits(spark, sf_dir):
    """Best passages of chunked pages, after the evidence floor."""
    found = ask.answer(_chunked(spark, sf_dir), questions(spark, sf_dir))
    return finish(found.hits.select("query_id", "document_id", "page_number", "chunk_ordinal", "score", "rank"))


def passage_evidence(spark, sf_dir):
    """From raw pages to cited passages with their caveats: the whole path."""
    chunked = _chunked(spark, sf_dir)
    found = ask.answer(chunked, questions(spark, sf_dir))
    e = ask.evidence(chunked, found.hits)
    return finish(e.select("query_id", "rank", "chunk_id", "page_number", "char_start", "char_end", "quote", "citation_label",
                           "is_safe_verbatim", "table_risk", F.array_join("caveats", " ").alias("caveats"), "why_matched", "score"))


def stored_index(spark, sf_dir):
    """The corpus as two uploads, one behind the other: each is a segment."""
    index = Index(spark, new_path(spark, "index"))
    page = ["document_id", "page_number", "raw_text"]
    index.add(structured_pages(spark, sf_dir, FIRST_UPLOAD).select(page))
    index.add(structured_pages(spark, sf_dir).select(page).where(F.col("page_number") > FIRST_UPLOAD))
    return index


def index_hits(spark, sf_dir):
    """Best passages from the stored index; the same rows as passage_hits."""
    found = stored_index(spark, sf_dir).search(questions(spark, sf_dir))
    return finish(S.evidence_floor(found.hits).select("query_id", "document_id", "page_number", "chunk_ordinal", "score", "rank"))


def index_hits_after_changes(spark, sf_dir):
    """Two documents are removed, one of them comes back, and all is merged into one segment."""
    index = stored_index(spark, sf_dir)
    index.remove(spark.createDataFrame([(d,) for d in REMOVED], "document_id string"))
    pages = structured_pages(spark, sf_dir).select("document_id", "page_number", "raw_text")
    index.add(pages.where(F.col("document_id") == REMOVED[0]))
    index.compact()
    found = index.search(questions(spark, sf_dir))
    return finish(S.evidence_floor(found.hits).select("query_id", "document_id", "page_number", "chunk_ordinal", "score", "rank"))


#: Pages of each document in the first of two uploads; documents taken out, the first of which comes back.
FIRST_UPLOAD = 20
REMOVED = ["src3", "src7"]

_DOC_TERMS = terms_sql("dt", "documents", "doc_id", "text")
_Q = f"""{QUESTIONS}, {terms_sql('qt', 'questions', 'query_id, document_id', 'question')}"""
_SYN = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs in V.SYNONYMS.items() for v in vs) + ") AS syn(k, v)"
_ASKED = f"""{_Q}, asked AS (
  SELECT query_id, document_id, pos * 10 + sub AS o, term FROM qt
  UNION ALL SELECT query_id, document_id, 1000000 + pos * 10 + sub, v FROM qt JOIN {_SYN} ON k = term)"""


def index_sql(chunks: str, asked: str) -> str:
    return f"""{chunks}, {terms_sql('ct', 'chunks', 'document_id, page_number, chunk_ordinal, page_quality', 'text')},
posted AS (SELECT document_id, page_number, chunk_ordinal, page_quality, term, count(*) AS tf FROM ct GROUP BY ALL),
lens AS (SELECT c.document_id, c.page_number, c.chunk_ordinal, count(t.term) AS length FROM chunks c
  LEFT JOIN ct t USING (document_id, page_number, chunk_ordinal) GROUP BY ALL),
stats AS (SELECT document_id, count(*) AS n, avg(length) AS avg_len FROM lens GROUP BY 1),
dfs AS (SELECT document_id, term, count(*) AS df FROM posted GROUP BY ALL), {asked},
weights AS (SELECT query_id, a.document_id, a.term, count(*) AS weight, any_value(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf, any_value(avg_len) AS avg_len
  FROM asked a JOIN dfs USING (document_id, term) JOIN stats USING (document_id) GROUP BY query_id, a.document_id, a.term)"""


_INDEX = index_sql(CHUNKS, _ASKED)
_SHARE = "weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(length, 1) / avg_len))"
_SCORED = f"""{_INDEX}, scored AS (
  SELECT query_id, document_id, page_number, chunk_ordinal, sum({_SHARE}) AS score, count(*) AS matched, count(*) FILTER (idf >= 3.0) AS distinctive
  FROM posted JOIN weights USING (document_id, term) JOIN lens USING (document_id, page_number, chunk_ordinal)
  WHERE page_quality <> 'unreadable' GROUP BY ALL)"""
_TOP = f"""{_SCORED}, top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_number, chunk_ordinal) AS rank
  FROM scored WHERE score > 0 QUALIFY rank <= 8)"""
_FLOOR = f"""{_TOP}, kept AS (SELECT * FROM top WHERE query_id IN (SELECT query_id FROM top WHERE rank = 1 AND matched >= 2 AND distinctive >= 1))"""
_REGIONS = r"""runs AS (
  SELECT document_id, min(page_number) AS page_start, max(page_number) AS page_end FROM (
    SELECT *, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS g FROM chunks WHERE page_quality = 'unreadable')
  GROUP BY document_id, g
), flat AS (SELECT document_id, page_number, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chunks WHERE page_quality <> 'unreadable'
), regions AS (
  SELECT r.*, coalesce(trim(right(b.t, 260)), '') AS descriptor, coalesce(trim(left(f.t, 200)), '') AS following_context
  FROM runs r LEFT JOIN flat b ON b.document_id = r.document_id AND b.page_number = page_start - 1
    LEFT JOIN flat f ON f.document_id = r.document_id AND f.page_number = page_end + 1)"""
_REGION_SCORES = f"""{_REGIONS}, {terms_sql('rt', 'regions', 'document_id, page_start, page_end', 'descriptor')},
rp AS (SELECT document_id, page_start, page_end, term, count(*) AS tf FROM rt GROUP BY ALL),
rl AS (SELECT document_id, page_start, count(*) AS length FROM rt GROUP BY ALL),
rs AS (SELECT query_id, document_id, page_start, page_end, round(sum(idf * tf) / (1 + ln(1 + any_value(length))), 4) AS match_score,
    string_agg(term, ' ' ORDER BY term) AS matched_terms, count(*) FILTER (idf >= 3.0) > 0 AS query_relevant
  FROM rp JOIN rl USING (document_id, page_start) JOIN weights USING (document_id, term) GROUP BY ALL)"""
_SPOTS = f"""{_FLOOR}, {_REGION_SCORES}, near AS (
  SELECT DISTINCT k.query_id, r.document_id, r.page_start, r.page_end FROM kept k JOIN regions r
    ON r.document_id = k.document_id AND k.page_number BETWEEN page_start - 3 AND page_end + 3
), spots AS (
  SELECT query_id, document_id, page_start, page_end, coalesce(match_score, 0.0) AS match_score, coalesce(query_relevant, false) AS query_relevant,
    n.hit IS NOT NULL AS near_hit
  FROM rs FULL JOIN (SELECT *, 1 AS hit FROM near) n USING (query_id, document_id, page_start, page_end)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY query_relevant DESC, match_score DESC, page_end - page_start DESC, page_start) AS rank
  FROM spots WHERE query_relevant OR near_hit)"""

_STEMS = f"""WITH {_DOC_TERMS}
SELECT t AS word, count(*) AS n, s AS stem FROM (
  SELECT t, CASE WHEN length(t) <= 3 OR NOT regexp_full_match(t, '[a-z]+') THEN NULL WHEN t LIKE '%ies' THEN left(t, length(t) - 3) || 'y'
    WHEN regexp_matches(t, '(s|x|z|ch|sh)es$') THEN left(t, length(t) - 2)
    WHEN t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is)$') THEN left(t, length(t) - 1) END AS s FROM dt_kept)
WHERE s IS NOT NULL AND s NOT IN {"(" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + ")"} GROUP BY t, s"""

_DOMAIN = "[" + ", ".join(f"'{k}'" for k in V.SYNONYMS) + "]"
_EXPANDED = f"""WITH mixed AS (
  SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: {_DOMAIN}[(i - 1) % {len(V.SYNONYMS)} + 1] || ' ' || w), ' ') AS text FROM benchmark
), {terms_sql('mt', 'mixed', 'item_id', 'text')}
SELECT item_id, term, count(*) AS n FROM (SELECT item_id, term FROM mt UNION ALL SELECT item_id, v FROM mt JOIN {_SYN} ON k = term) GROUP BY ALL"""

_BOOST_CHUNKS = CHUNKS.replace("chunks AS (", "plain_chunks AS (") + """, chunks AS (
  SELECT document_id, page_number, chunk_ordinal, page_quality,
    CASE WHEN page_number % 2 = 0 AND page_quality = 'clean' THEN '2.' || page_number || ' Term of page: means this. ' || text ELSE text END AS text
  FROM plain_chunks)"""
_BOOST_ASKED = _ASKED.replace(
    "text AS question FROM benchmark", "CASE WHEN item_id % 2 = 0 THEN 'What is the meaning of ' || text ELSE text END AS question FROM benchmark")
_BOOST = f"""WITH {index_sql(_BOOST_CHUNKS, _BOOST_ASKED)}, scored AS (
  SELECT query_id, document_id, page_number, chunk_ordinal,
    sum({_SHARE}) * CASE WHEN query_id % 2 = 0 AND page_number % 2 = 0 THEN 2 ELSE 1 END AS score
  FROM posted JOIN weights USING (document_id, term) JOIN lens USING (document_id, page_number, chunk_ordinal)
  WHERE page_quality <> 'unreadable' GROUP BY query_id, document_id, page_number, chunk_ordinal)
SELECT query_id, document_id, page_number, round(score, 4) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_number, chunk_ordinal) AS rank
FROM scored WHERE score > 0 QUALIFY rank <= 8"""

_WHY = f"""WITH {_FLOOR}, m AS (
  SELECT k.query_id, k.page_number, k.rank, string_agg(a.term, ' ' ORDER BY a.o) AS matched_terms, list_sort(list_distinct(list(a.term))) AS d
  FROM kept k JOIN posted p USING (document_id, page_number, chunk_ordinal)
    JOIN asked a ON a.query_id = k.query_id AND a.term = p.term GROUP BY ALL)
SELECT query_id, page_number, rank, matched_terms, 'Matched on: ' || array_to_string(d[1:8], ', ') AS why FROM m"""

_DESCRIBE = f"""WITH {CHUNKS}, {_REGIONS}
SELECT document_id, page_start, page_end, descriptor, following_context,
  CASE WHEN page_start = page_end THEN 'page ' || page_start ELSE 'pages ' || page_start || chr(8211) || page_end || ' (' || (page_end - page_start + 1) || ' pages)' END
  || ': {V.BLIND_REASON}.' ||
  CASE WHEN descriptor <> '' THEN ' The text immediately before it reads: ' || chr(8220) || left(descriptor, 200) || chr(8221) ELSE '' END ||
  CASE WHEN following_context <> '' THEN ' The text immediately after it reads: ' || chr(8220) || left(following_context, 160) || chr(8221) ELSE '' END AS description
FROM regions"""

_NOTE = f"""WITH {_SPOTS}, relevant AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM ranked WHERE query_relevant)
SELECT query_id, sum(page_end - page_start + 1) || ' page(s) of this document bearing on your question could not be read (' || count(*) || ' region(s): '
  || string_agg(CASE WHEN k > 3 THEN NULL WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END, ', ' ORDER BY k)
  || ') and are not included in the evidence below.' AS coverage_note FROM relevant GROUP BY query_id"""

_IMAGES = f"""WITH {CHUNKS}, {_REGIONS}
SELECT document_id, page_start, '/api/corpus/page/' || unnest(generate_series(page_start, page_end)) || '/image' AS url FROM regions"""

# The structured pages hold measures only in the sentence put in, so its pattern finds them;
# a measure needs no word character or dot before it and nothing of a word after its unit.
_PROVISIONS = rf"""WITH {STRUCTURED}, f AS (
  SELECT document_id, page_number, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM structured
), marked AS (
  SELECT document_id, page_number, t, regexp_replace(t, '(?i)(^|[^\p{{L}}\p{{N}}_.])([0-9]+(?:\.[0-9]+)?\s*(?:m|metre|meter|sqm|sq\.?\s?m|%|ha))([^\p{{L}}\p{{N}}_]|$)', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS m FROM f
), parts AS (SELECT document_id, page_number, t, generate_subscripts(p, 1) AS k, unnest(p) AS part FROM (SELECT *, string_split(m, chr(1)) AS p FROM marked)
), placed AS (SELECT *, string_split(part, chr(2))[1] AS whole, sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY document_id, page_number ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS s FROM parts
), found AS (SELECT *, page_number % 3 = 0 AS rep, page_number % 4 = 0 AS risky FROM placed WHERE k > 1)
SELECT document_id, page_number, s AS start_at, regexp_extract(whole, '[0-9]+(?:\.[0-9]+)?')::DOUBLE AS value,
  lower(replace(replace(regexp_replace(whole, '^[0-9.]+\s*', ''), '.', ''), ' ', '')) AS unit,
  substr(t, greatest(s - 110, 0) + 1, least(s + length(whole) + 110, length(t)) - greatest(s - 110, 0)) AS context,
  NOT (rep OR risky) AS is_reliable,
  CASE WHEN risky THEN {sql_text(S.WORDING["risky"])} WHEN rep THEN {sql_text(S.WORDING["repaired"])} END AS caveat
FROM found"""

_PASSAGES = f"""{CHUNK_ROWS}, chunks AS (
  SELECT document_id, page_number, char_start AS chunk_ordinal, text,
    CASE WHEN chunk_id LIKE '%:unreadable' THEN 'unreadable' ELSE 'clean' END AS page_quality FROM chunk_rows)"""
_PASSAGE_HITS = "WITH RECURSIVE " + _FLOOR.replace(CHUNKS, _PASSAGES, 1)

_EVIDENCE = rf"""{_PASSAGE_HITS}, m AS (
  SELECT k.query_id, k.rank, list_sort(list_distinct(list(a.term))) AS d FROM kept k JOIN posted p USING (document_id, page_number, chunk_ordinal)
    JOIN asked a ON a.query_id = k.query_id AND a.term = p.term GROUP BY ALL)
SELECT k.query_id, k.rank, c.chunk_id, k.page_number, c.char_start, c.char_end, trim(regexp_replace(c.text, '\s+', ' ', 'g')) AS quote, c.label AS citation_label,
  c.safe_to_quote AS is_safe_verbatim, c.table_risk, c.caveats, 'Matched on: ' || array_to_string(d[1:8], ', ') AS why_matched, round(k.score, 4) AS score
FROM kept k JOIN m USING (query_id, rank) JOIN chunk_rows c ON c.document_id = k.document_id AND c.page_number = k.page_number AND c.char_start = k.chunk_ordinal"""

QUERIES = {
    "tokens": (tokens, f"WITH {_DOC_TERMS} SELECT doc_id, count(*) AS n_terms, sum(length(term))::BIGINT AS n_letters, min(term) AS least, max(term) AS greatest FROM dt GROUP BY 1"),
    "stems": (stems, _STEMS),
    "expanded_terms": (expanded_terms, _EXPANDED),
    "postings": (postings, f"WITH {_INDEX} SELECT document_id, page_number, term, tf, length FROM posted JOIN lens USING (document_id, page_number, chunk_ordinal)"),
    "term_df": (term_df, f"WITH {_INDEX} SELECT document_id, term, df FROM dfs"),
    "corpus_stats": (corpus_stats, f"WITH {_INDEX} SELECT document_id, n, round(avg_len, 6) AS avg_len FROM stats"),
    "idf": (idf, f"WITH {_INDEX} SELECT query_id, document_id, term, weight, round(idf, 6) AS idf FROM weights"),
    "bm25_scores": (bm25_scores, f"WITH {_SCORED} SELECT query_id, document_id, page_number, round(score, 4) AS score, matched, distinctive FROM scored WHERE score > 0"),
    "bm25_definition_boost": (bm25_definition_boost, _BOOST),
    "bm25_topk": (bm25_topk, f"WITH {_TOP} SELECT query_id, document_id, page_number, round(score, 4) AS score, rank FROM top"),
    "evidence_floor": (evidence_floor, f"WITH {_FLOOR} SELECT query_id, page_number, round(score, 4) AS score, rank, matched, distinctive FROM kept"),
    "why_matched": (why_matched, _WHY),
    "region_descriptors": (region_descriptors, _DESCRIBE),
    "region_scores": (region_scores, f"WITH {_INDEX}, {_REGION_SCORES} SELECT query_id, document_id, page_start, match_score, matched_terms, query_relevant FROM rs"),
    "regions_near_hits": (regions_near_hits, f"WITH {_SPOTS} SELECT query_id, document_id, page_start, page_end, match_score, query_relevant, near_hit, rank FROM ranked"),
    "coverage_note": (coverage_note, _NOTE),
    "image_pages": (image_pages, _IMAGES),
    "numeric_provisions": (numeric_provisions, _PROVISIONS),
    "passage_hits": (passage_hits, f"{_PASSAGE_HITS} SELECT query_id, document_id, page_number, chunk_ordinal, round(score, 4) AS score, rank FROM kept"),
    "index_hits": (index_hits, f"{_PASSAGE_HITS} SELECT query_id, document_id, page_number, chunk_ordinal, round(score, 4) AS score, rank FROM kept"),
    "index_hits_after_changes": (index_hits_after_changes, f"{_PASSAGE_HITS} SELECT query_id, document_id, page_number, chunk_ordinal, round(score, 4) AS score, rank FROM kept WHERE document_id <> '{REMOVED[1]}'"),
    "passage_evidence": (passage_evidence, _EVIDENCE),
}
