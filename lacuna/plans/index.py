"""A stored corpus that grows and shrinks: segments of chunks and postings, and a log.

Every upload becomes a segment of its own: its chunks, its postings in blocks, and its
documents' totals, none of which is written again when others come.  Frequencies and
mean lengths are sums over the live segments when a question is asked.  Removing a
document writes a line to the log that hides its rows in all earlier segments.
Compaction merges what is live into one segment.

    folder/log                          version, action, segment, document_id
    folder/{chunks,blocks,totals}/segment=<name>

A segment counts from its line in the log on, which is written last: what a broken-off
upload left behind is never read.  One writer at a time; readers see the log as it was
when they opened the index.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.operators import blockmax, search
from lacuna.plans import ask
from lacuna.sources.tables import path_exists

LOG = "version long, action string, segment string, document_id string"
TABLES = ("chunks", "blocks", "totals")


@dataclass
class Index:
    spark: SparkSession
    folder: str
    pages_per_block: int = blockmax.PAGES_PER_BLOCK

    # --- the log ---------------------------------------------------------------

    def log(self) -> DataFrame:
        path = f"{self.folder}/log"
        return self.spark.read.schema(LOG).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], LOG)

    def _next(self) -> int:
        return (self.log().agg(F.max("version")).first()[0] or 0) + 1

    def _note(self, rows: DataFrame) -> None:
        rows.select("version", "action", "segment", "document_id").write.mode("append").parquet(f"{self.folder}/log")

    def _note_segment(self, version: int, action: str, segment: str) -> None:
        self._note(self.spark.createDataFrame([(version, action, segment, None)], LOG).coalesce(1))

    def segments(self) -> list[str]:
        """Live segments: the last compaction and what was added since.  One name per upload."""
        kept = self.log().where("action IN ('add', 'compact')")
        since = kept.agg(F.max(F.when(F.col("action") == "compact", F.col("version")))).first()[0] or 0
        return [r.segment for r in kept.where(F.col("version") >= since).orderBy("version").collect()]

    # --- reading ---------------------------------------------------------------

    def live(self, table: str) -> DataFrame:
        """Rows of the live segments without those of documents removed later."""
        names = self.segments()
        if not names:
            raise ValueError("nothing was added to this index")
        rows = self.spark.read.parquet(*[f"{self.folder}/{table}/segment={n}" for n in names])
        removed = self.log().where("action = 'remove'").groupBy("document_id").agg(F.max("version").alias("_removed"))
        later = (rows["document_id"] == removed["document_id"]) & (removed["_removed"] > rows["version"])
        return rows.join(removed, later, "left_anti")

    def search(self, questions: DataFrame, k: int = V.TOP_K) -> blockmax.Found:
        return blockmax.top_hits(self.live("blocks"), self.live("totals"), questions, k)

    def answers(self, questions: DataFrame, k: int = V.TOP_K) -> DataFrame:
        """Hits that pass the evidence floor, with their matched terms."""
        found = self.search(questions, k)
        return blockmax.matched_terms(found, self.live("blocks"), search.evidence_floor(found.hits))

    def evidence(self, questions: DataFrame, k: int = V.TOP_K) -> DataFrame:
        """Passages with everything that qualifies them, as ask.evidence gives them."""
        return ask.evidence(self.live("chunks"), self.answers(questions, k))

    # --- writing ---------------------------------------------------------------

    def _write(self, rows: DataFrame, table: str, segment: str) -> None:
        rows.write.parquet(f"{self.folder}/{table}/segment={segment}")

    def add(self, raw_pages: DataFrame, running_header: str | None = None) -> str:
        """Pages(document_id, page_number, raw_text) as a new segment; its name."""
        return self.add_chunks(ask.ingest(raw_pages, running_header))

    def add_chunks(self, chunked: DataFrame) -> str:
        version, segment = self._next(), uuid.uuid4().hex
        self._write(chunked.withColumn("version", F.lit(version).cast("long")), "chunks", segment)
        stored = self.spark.read.parquet(f"{self.folder}/chunks/segment={segment}")
        now = F.lit(version).cast("long")
        blocks = blockmax.block_postings(search.tokenised(stored), self.pages_per_block)
        # In the order of terms, so that asked-for terms prune row groups; no second exchange.
        self._write(blocks.withColumn("version", now).sortWithinPartitions("term", "document_id"), "blocks", segment)
        written = self.spark.read.parquet(f"{self.folder}/blocks/segment={segment}")
        self._write(blockmax.document_totals(stored, written).withColumn("version", now), "totals", segment)
        self._note_segment(version, "add", segment)
        return segment

    def remove(self, documents: DataFrame) -> None:
        """Hide documents(document_id) in all segments there are; they may be added again."""
        version = F.lit(self._next()).cast("long")
        self._note(documents.select(version.alias("version"), F.lit("remove").alias("action"), F.lit(None).cast("string").alias("segment"), "document_id").distinct())

    def compact(self) -> list[str]:
        """Merge all live rows into one segment; the names of those that are no longer read."""
        version, segment, old = self._next(), uuid.uuid4().hex, self.segments()
        now = F.lit(version).cast("long")
        self._write(self.live("chunks").withColumn("version", now), "chunks", segment)
        self._write(blockmax.merged(self.live("blocks")).withColumn("version", now).sortWithinPartitions("term", "document_id"), "blocks", segment)
        totals = self.live("totals").groupBy("document_id").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms"))
        self._write(totals.withColumn("version", now), "totals", segment)
        self._note_segment(version, "compact", segment)
        return old
