"""Scoring answers against ground truth that is checked first."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.session import materialise

#: Counts per key and round of a selection by histograms.
BUCKETS = 4096


def ground_truth_problems(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """(case_id, problem) for every case that contradicts its document.

    cases(case_id, document_id, expected_pages, expected_phrase, blind_first,
    blind_last); pages(document_id, page_number, text, readable).
    """
    duplicated = (
        cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        .select("case_id", F.lit("duplicate case id").alias("problem"))
    )
    expected = X.unnest(
        cases.select("case_id", "document_id", "expected_phrase", "expected_pages"), "expected_pages", "page_number"
    ).drop("expected_pages")
    # Pages are narrowed to those that cases name, and tested there; texts stop here.
    named = expected.select("document_id", "page_number", "expected_phrase").distinct()
    tested = pages.select("document_id", "page_number", "text", "readable").join(named, ["document_id", "page_number"]).select(
        "document_id", "page_number", "expected_phrase", "readable",
        F.contains(F.lower("text"), F.lower("expected_phrase")).alias("holds"))
    phrase = F.col("expected_phrase").eqNullSafe(F.col("_phrase"))
    looked_up = expected.join(
        tested.withColumnsRenamed({"document_id": "_document", "page_number": "_page", "expected_phrase": "_phrase"}),
        (F.col("document_id") == F.col("_document")) & (F.col("page_number") == F.col("_page")) & phrase, "left")
    page = F.col("page_number").cast("string")
    out_of_range = looked_up.where(F.col("readable").isNull()).select(
        "case_id", F.concat(F.lit("page "), page, F.lit(" out of range")).alias("problem")
    )
    unreadable = looked_up.where(~F.col("readable")).select(
        "case_id", F.concat(F.lit("expects readable text on page "), page).alias("problem")
    )
    held = F.coalesce(
        F.col("readable") & F.col("holds"), F.lit(False)
    )
    absent = (
        looked_up.where(F.col("expected_phrase").isNotNull())
        .groupBy("case_id")
        .agg(F.bool_or(held).alias("found"))
        .where(~F.col("found"))
        .select("case_id", F.lit("phrase not present on the expected pages").alias("problem"))
    )
    wanted = cases.where(F.col("blind_first").isNotNull()).select(
        "case_id", "document_id", F.explode(F.sequence("blind_first", "blind_last")).alias("page_number")
    )
    blind = pages.where(~F.col("readable")).select("document_id", "page_number")
    readable_blind = (
        wanted.join(blind, ["document_id", "page_number"], "left_anti")
        .select("case_id", F.lit("expected blind pages are readable").alias("problem"))
        .distinct()
    )
    return duplicated.unionByName(out_of_range).unionByName(unreadable).unionByName(absent).unionByName(readable_blind)


def contained(wanted: DataFrame, reported: DataFrame) -> DataFrame:
    """Cases whose wanted page range lies inside one reported region."""
    return wanted.join(
        reported.select("case_id", "page_start", "page_end"), "case_id"
    ).where((F.col("page_start") <= F.col("blind_first")) & (F.col("page_end") >= F.col("blind_last"))).select("case_id").distinct()


def case_checks(cases: DataFrame, hits: DataFrame, reported: DataFrame, surface: DataFrame) -> DataFrame:
    """One row per case with nine checks; null where a check does not apply.

    hits(case_id, rank, page_number, quote, text_was_repaired, table_risk): kept hits;
    reported(case_id, page_start, page_end): regions on the topic;
    surface(case_id, text, is_gap): statements shown.
    """
    expects_page = F.size("expected_pages") > 0
    per_hit = hits.join(cases.select("case_id", "expected_pages", "expected_phrase"), "case_id")
    on_page = F.array_contains("expected_pages", F.col("page_number"))
    from_hits = per_hit.groupBy("case_id").agg(
        F.bool_or(on_page).alias("_recall"),
        F.bool_or(on_page & (F.col("rank") == 1)).alias("_p1"),
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quote"))), lambda q: q["quote"]), " ")).alias("_evidence"),
        F.bool_or("text_was_repaired").alias("_repaired"),
        F.bool_or(F.coalesce(F.col("table_risk").isin(V.RISKY_LEVELS), F.lit(False))).alias("_risky"),
    )
    regions = reported.groupBy("case_id").agg(F.count(F.lit(1)).alias("_regions"))
    covered = contained(cases.where(F.col("blind_first").isNotNull()), reported).withColumn("_covered", F.lit(True))
    shown = surface.join(cases.select("case_id", "forbidden_phrases"), "case_id")
    offence = F.exists("forbidden_phrases", lambda p: F.contains(F.lower(F.col("text")), F.lower(p)))
    from_surface = shown.groupBy("case_id").agg(
        F.bool_or(offence).alias("_offends"), F.bool_or("is_gap").alias("_gap")
    )
    joined = (
        cases.join(from_hits, "case_id", "left")
        .join(regions, "case_id", "left")
        .join(covered, "case_id", "left")
        .join(from_surface, "case_id", "left")
    )

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    has_evidence = F.col("_evidence").isNotNull()
    phrase = F.col("expected_phrase")
    checked = joined.select(
        "case_id",
        F.when(expects_page, known("_recall")).alias("page_recall"),
        F.when(expects_page, known("_p1")).alias("page_precision_at_1"),
        F.when(phrase.isNotNull(), F.coalesce(F.contains(F.col("_evidence"), F.lower(phrase)), F.lit(False))).alias("phrase_found"),
        F.when(F.col("blind_first").isNotNull(), known("_covered")).alias("blind_spot_reported"),
        F.when(known("expect_no_blind_spot"), F.coalesce("_regions", F.lit(0)) == 0).alias("no_false_blind_spot"),
        F.when(known("expect_repair_caveat"), known("_repaired")).alias("repair_caveat_present"),
        F.when(known("expect_table_risk"), known("_risky")).alias("table_risk_flagged"),
        F.when(known("expect_no_evidence"), ~has_evidence | known("_gap")).alias("absence_handled"),
        F.when(F.size("forbidden_phrases") > 0, ~known("_offends")).alias("no_overclaim"),
    )
    return checked.withColumn("passed", passed([c for c, _ in V.CASE_CHECKS]))


def passed(checks: list[str]) -> Column:
    """All checks that apply hold."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(F.col(c), F.lit(True))
    return out


def tally(checked: DataFrame, checks: list[str]) -> DataFrame:
    """Hits, total and percentage per check; checks that do not apply are left out."""
    long = checked.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in checks])
        ).alias("c")
    ).select("c.*")
    counted = long.groupBy("check").agg(
        F.count_if("ok").alias("hits"), F.count("ok").alias("total")
    )
    share = F.coalesce(F.try_divide(100 * F.col("hits"), F.col("total")), F.lit(0.0))
    return counted.withColumn("percent", F.round(share, 1))


def failed_checks(checked: DataFrame, checks: list[str]) -> DataFrame:
    """Names of the failed checks of each case that failed."""
    names = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]))
    return checked.withColumn("failed", F.array_join(names, ", ")).where(F.col("failed") != "").select("case_id", "failed")


def of_kind(checked: DataFrame, cases: DataFrame, kinds: list[str]) -> DataFrame:
    """The checked cases of some kinds; cases(case_id, kind)."""
    return checked.join(cases.where(F.col("kind").isin(kinds)).select("case_id", "kind"), "case_id")


def report_counts(metrics: DataFrame) -> DataFrame:
    """How many metrics were measured and not, and how many of those measured are perfect."""
    measured = F.col("status") == "measured"
    return metrics.agg(
        F.count_if(measured).alias("measured"), F.count_if(~measured).alias("not_measured"),
        F.count_if(measured & (F.col("value") == 100)).alias("passed"),
    )


def order_statistics(df: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]], buckets: int = BUCKETS) -> DataFrame:
    """Exact elements of each key's values by their place in order: key, n and a column per name.

    places: name -> 0-based place among n values, as a column of n.  Selection by
    histograms: the range that holds the place is cut into buckets, values are counted
    by bucket, and only the bucket with the place is kept, until all its values are
    equal.  A range is cut by signs, then by powers of two, then evenly, so a few rounds
    do for any numbers.  Of a key, at most `buckets` counts meet in one task.  Values that
    are null or NaN are left out; a key without any others has no row.
    """
    known = df.select(F.col(key).alias("_key"), F.col(value).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    whole = known.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), at(F.col("_n")).cast("long").alias("_place")) for name, at in places.items()])
    state = materialise(whole.select("*", F.inline(asked)).withColumn("_below", F.lit(0).cast("long")))
    done = state.where("_lo = _hi")
    while (open_ := state.where("_lo < _hi")).head(1):
        v, lo, hi = (F.col(c).cast("double") for c in ("_v", "_lo", "_hi"))
        power = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)))  # an infinite number has the highest
        even = F.floor((F.col("_v") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double") * buckets)
        bucket = (
            F.when((lo <= 0) & (hi >= 0), F.signum(v).cast("long"))
            .when((lo > 0) & (hi / 4 > lo), power)
            .when((hi < 0) & (lo / 4 < hi), -power)
            .otherwise(even)
        )
        ranges = open_.select("_key", "_name", "_n", "_place", "_lo", "_hi", "_below")
        same = known["_key"].eqNullSafe(ranges["_key"]) & known["_v"].between(ranges["_lo"], ranges["_hi"])
        counted = known.join(ranges, same).select("_name", ranges["_key"], "_n", "_place", "_below", "_v", bucket.alias("_bucket")).groupBy(
            "_key", "_name", "_n", "_place", "_below", "_bucket").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = Window.partitionBy("_key", "_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        state = materialise(
            counted.withColumn("_upto", F.col("_below") + F.sum("_c").over(upto)).where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_c") <= F.col("_place")))
            .select("_key", "_n", "_lo", "_hi", "_name", "_place", (F.col("_upto") - F.col("_c")).alias("_below")))
        done = done.unionByName(state.where("_lo = _hi"))
    named = [F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(name) for name in places]
    return done.groupBy(F.col("_key").alias(key)).agg(F.max("_n").alias("n"), *named)


def indexed_quantiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """Upper-middle median and p95, both elements of the data, and how many different values there are, per key."""
    places = {"median": lambda n: F.floor(n / 2), "p95": lambda n: F.least(n - 1, F.floor(0.95 * n))}
    chosen = order_statistics(df, key, value, places).drop("n").withColumnRenamed(key, "_key")
    different = df.where(F.col(value).isNotNull()).select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("distinct_values"))
    return different.join(chosen, different[key].eqNullSafe(chosen["_key"])).select(key, "distinct_values", "median", "p95")


def report(tallied: DataFrame, with_model: bool = False) -> DataFrame:
    """Metric rows; what was not measured says so instead of showing a number."""
    names = F
    for check, metric in V.CASE_CHECKS:
        names = names.when(F.col("check") == check, metric)
    measured = tallied.select(
        names.otherwise(F.col("check")).alias("name"),
        F.lit("measured").alias("status"),
        F.col("percent").alias("value"),
        F.lit("%").alias("unit"),
        F.col("hits").alias("numerator"),
        F.col("total").alias("denominator"),
        F.lit(None).cast("string").alias("reason_not_measured"),
    )
    if with_model:
        return measured
    missing = tallied.sparkSession.createDataFrame([(n,) for n in V.UNMEASURED_METRICS], "name string").select(
        "name",
        F.lit("not_measured").alias("status"),
        F.lit(None).cast("double").alias("value"),
        F.lit("%").alias("unit"),
        F.lit(None).cast("long").alias("numerator"),
        F.lit(None).cast("long").alias("denominator"),
        F.lit("No language model configured; this run generates no prose.").alias("reason_not_measured"),
    )
    return measured.unionByName(missing)
