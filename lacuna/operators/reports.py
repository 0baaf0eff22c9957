"""Findings, site panels, comparison matrix and coverage figures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.functions.places import feature_label
from lacuna.operators.ranges import rank_rows
from lacuna.operators.statements import type_summary

UNRESOLVABLE = "unresolvable_with_open_data"
#: What a comparison turns on.  The sentences decide nothing and may be replaced.
WORDING = {
    "everywhere": "All sites share one constraint that stays open: {title}. Open data does not tell them apart there. {resolver}",
    "somewhere": "{n} of these sites have a constraint that stays open and that the others do not have; this is what to decide on.",
    "nowhere": "For none of these sites was a conflict found that open data leaves open. Pages without text were not searched.",
}


def context(statements: DataFrame) -> DataFrame:
    """What was measured about the place."""
    return statements.where((F.col("type") == "fact") & (F.col("agent") == "site"))


def evidence(statements: DataFrame) -> DataFrame:
    """What the document says."""
    return statements.where((F.col("type") == "fact") & (F.col("agent") == "regulation"))


def assumptions(statements: DataFrame) -> DataFrame:
    return statements.where((F.col("type") == "assumption") & ~F.col("rejected"))


def change_my_mind(statements: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Every condition that would overturn a part of the finding."""
    from_assumptions = assumptions(statements).select(
        "finding_id",
        F.col("text").alias("current_position"),
        F.col("falsified_by").alias("would_change_if"),
        F.lit("assumption").alias("origin"),
    )
    from_conflicts = conflicts.select(
        "finding_id",
        F.concat_ws(": ", "title", "why_it_matters").alias("current_position"),
        F.explode("what_would_resolve_it").alias("would_change_if"),
        F.lit("conflict").alias("origin"),
    )
    return from_assumptions.unionByName(from_conflicts)


def verify_next(statements: DataFrame) -> DataFrame:
    """Open tasks with their place in the queue: priority first, then order made."""
    tasks = statements.where((F.col("type") == "recommendation") & ~F.col("rejected"))
    return rank_rows(tasks, "finding_id", [("priority", False)], "ordinal", "queue_position")


def finding_coverage(statements: DataFrame, conflicts: DataFrame, spots: DataFrame, interventions: DataFrame) -> DataFrame:
    """Counts of what a finding contains; every count is of real rows."""
    by_conflict = conflicts.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("conflicts"),
        F.count_if(F.col("resolvability") == UNRESOLVABLE).alias("unresolvable_conflicts"),
    )
    by_spot = spots.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("unreadable_regions"), F.sum("page_count").alias("unreadable_pages")
    )
    by_critic = interventions.groupBy("finding_id").agg(F.count(F.lit(1)).alias("critic_interventions"))
    counted = ["conflicts", "unresolvable_conflicts", "unreadable_regions", "unreadable_pages", "critic_interventions"]
    return (
        type_summary(statements, ["finding_id"])
        .join(by_conflict, "finding_id", "left")
        .join(by_spot, "finding_id", "left")
        .join(by_critic, "finding_id", "left")
        .fillna(0, counted)
        .withColumn("evidence_complete", F.col("unreadable_regions") == 0)
    )


def panel_of(text: Column) -> Column:
    """The first panel whose keyword occurs; a fact is shown in one panel only."""
    low = F.lower(text)
    out = F
    for key, keywords in V.PANELS:
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.contains(low, F.lit(word))
        out = out.when(hit, key)
    return out.otherwise(None)


def site_panels(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """Panels per finding with their facts in the order made; empty panels stay visible.

    The constraints panel never has facts: no open source fills it.  A finding has a
    fact or two for each category and source, so a panel's list is short.
    """
    keys = [k for k, _ in V.PANELS] + ["constraints"]
    all_panels = findings.select(
        "finding_id", F.posexplode(F.array(*[F.lit(k) for k in keys])).alias("panel_order", "panel")
    )
    per_panel = (
        facts.withColumn("panel", panel_of(F.col("text")))
        .where(F.col("panel").isNotNull())
        .groupBy("finding_id", "panel")
        .agg(
            F.count(F.lit(1)).alias("facts"),
            F.min_by("limitation", "ordinal").alias("limitation"),
            F.array_sort(F.collect_list(F.struct("ordinal", "id", "text", "proxy_for", "provider", "retrieved_at", "limitation"))).alias("statements"),
        )
    )
    return (
        all_panels.join(per_panel, ["finding_id", "panel"], "left")
        .withColumn("facts", F.coalesce("facts", F.lit(0)))
        .withColumn("available", F.col("facts") > 0)
        .withColumn("statements", F.coalesce("statements", F.slice(F.array(F.col("statements")[0]), 1, 0)))
    )


def comparison_cells(facts: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites x dimensions; the earliest fact that names the dimension fills the cell.

    A fact is tagged with every dimension it names, so no site is paired with all
    facts; cells nobody fills keep a null value.
    """
    dimensions = F.array(
        *[F.struct(F.lit(i).alias("row_order"), F.lit(k).alias("dimension"), F.lit(l).alias("label")) for i, (k, l, _) in enumerate(V.DIMENSIONS)]
    )
    grid = sites.select("site", F.explode(dimensions).alias("d")).select("site", "d.*")
    low = F.lower(F.col("text"))
    named = F.array_compact(
        F.array(*[F.when(_any(low, words), F.lit(key)) for key, _, words in V.DIMENSIONS])
    )
    tagged = facts.withColumn("dimension", F.explode(named))
    first = tagged.groupBy("site", "dimension").agg(
        F.min(F.struct("ordinal", F.col("text").alias("value"), "id", "provider", "limitation", "proxy_for")).alias("f")
    )
    return grid.join(first, ["site", "dimension"], "left").select(
        "site", "dimension", "label", "row_order", "f.value", F.col("f.id").alias("statement_id"),
        "f.provider", "f.limitation", "f.proxy_for", F.col("f.value").isNotNull().alias("established"),
    )


def _any(low: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def comparison_rows(cells: DataFrame) -> DataFrame:
    """Per dimension: whether all sites have a value, and whether values differ.

    Two different values exist exactly when the least and the greatest differ.
    """
    return cells.groupBy("dimension", "label", "row_order").agg(
        F.bool_and("established").alias("all_established"),
        F.coalesce(F.min("value") != F.max("value"), F.lit(False)).alias("differentiating"),
    )


def undifferentiating(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("differentiating") & F.col("all_established"))


def comparison_matrix(cells: DataFrame, sites: list[str]) -> DataFrame:
    """One row per dimension, one column for each site asked for.

    `cells` is the long form, for any number of sites; this is for showing a few.
    """
    return cells.groupBy("row_order", "label").pivot("site", sites).agg(F.first("value"))


def site_coverage(statements: DataFrame, conflicts: DataFrame, spots: DataFrame, cells: DataFrame) -> DataFrame:
    """Per-site counts of what was established."""
    base = type_summary(statements, ["site"]).drop("rejected", "weakened_by_critic")
    passages = evidence(statements).groupBy("site").agg(F.count(F.lit(1)).alias("evidence_passages"))
    by_conflict = conflicts.groupBy("site").agg(F.count(F.lit(1)).alias("conflicts"))
    by_spot = spots.groupBy("site").agg(F.sum("page_count").alias("unreadable_pages"))
    by_cell = cells.groupBy("site").agg(
        F.count_if("established").alias("cells_established"), F.count(F.lit(1)).alias("cells_total")
    )
    out = base
    for part in (passages, by_conflict, by_spot, by_cell):
        out = out.join(part, "site", "left")
    return out.fillna(0)


def critical_question(conflicts: DataFrame, sites: DataFrame) -> DataFrame:
    """The one difference that decides between the sites of a comparison.

    Counts unresolvable conflicts against the number of sites, so two on one site
    can stand in for one on each.
    """
    n_sites = sites.groupBy("comparison").agg(F.count(F.lit(1)).alias("n_sites"))
    open_ones = (
        conflicts.where(F.col("resolvability") == UNRESOLVABLE)
        .groupBy("comparison")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("site_order", "severity", "ordinal", "title", F.try_element_at("what_would_resolve_it", F.lit(1)).alias("resolver"))).alias("f"),
        )
    )
    joined = n_sites.join(open_ones, "comparison", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    words = (
        F.when(
            (F.col("n") > 0) & (F.col("n") >= F.col("n_sites")),
            X.filled(WORDING["everywhere"], title=F.lower("f.title"), resolver=F.coalesce("f.resolver", F.lit(""))),
        )
        .when(F.col("n") > 0, X.filled(WORDING["somewhere"], n=F.col("n")))
        .otherwise(WORDING["nowhere"])
    )
    return joined.select("comparison", "n_sites", F.col("n").alias("unresolvable"), words.alias("critical_question"))


def failed_agents(traces: DataFrame) -> DataFrame:
    return traces.where(~F.col("ok")).select("finding_id", "agent", "error")


def map_features(features: DataFrame, tags: int | None = None) -> DataFrame:
    """Features as shown on a map: label, link and tags, all or the first so many."""
    shown = F.col("tags") if tags is None else F.map_from_entries(F.slice(F.map_entries("tags"), 1, tags))
    return features.select(
        "osm_type", "osm_id", "category", feature_label(F.col("name"), F.col("category")).alias("label"),
        "latitude", "longitude", "distance_m",
        F.concat_ws("/", F.lit("https://www.openstreetmap.org"), "osm_type", "osm_id").alias("osm_url"),
        shown.alias("tags"),
    )


def recordings_summary(recordings: DataFrame, by: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """Count, age range and staleness of recorded responses."""
    at = F.current_timestamp() if now is None else now
    age = (F.unix_micros(at) - F.unix_micros("captured_at")) / 86_400e6
    aged = recordings.withColumn("_age", age)
    return aged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("recordings"),
        F.round(F.max("_age"), 1).alias("oldest_days"),
        F.round(F.min("_age"), 1).alias("newest_days"),
        F.bool_or(F.col("_age") > V.STALE_AFTER_DAYS).alias("any_stale"),
    )
