"""Transparency score and risk level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dims import COI_KEYWORDS, DATA_KEYWORDS, HIGH_RISK_BELOW, INDUSTRY_CONFIDENCE, INDUSTRY_KEYWORDS, MEDIUM_RISK_TO, MOST_POINTS, POINTS
from marginalia.functions.text import contains_any


def data_level(text: Column, patterns: tuple[tuple[str, str], ...] = DATA_KEYWORDS) -> Column:
    """What the first pattern found says of the data; ``unknown`` without one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    level = F.lit("unknown")
    for pattern, name in reversed(patterns):
        level = F.when(F.contains(low, F.lit(pattern)), name).otherwise(level)
    return level


def coi_disclosed(text: Column, patterns: tuple[str, ...] = COI_KEYWORDS) -> Column:
    return contains_any(text, list(patterns))


def is_industry(funder: Column, keywords: tuple[str, ...] = INDUSTRY_KEYWORDS) -> Column:
    return contains_any(funder, list(keywords))


def industry_funded(funders: Column, keywords: tuple[str, ...] = INDUSTRY_KEYWORDS) -> Column:
    return F.exists(funders, lambda f: is_industry(f, keywords))


def industry_confidence(funders: Column, known: Column | None = None, keywords: tuple[str, ...] = INDUSTRY_KEYWORDS) -> Column:
    """The highest confidence that a paper is funded by industry: what is known before, and that of each funder."""
    each = F.transform(funders, lambda f: F.when(is_industry(f, keywords), INDUSTRY_CONFIDENCE).otherwise(0.0))
    return F.greatest(F.coalesce(F.array_max(each), F.lit(0.0)), F.lit(0.0) if known is None else F.coalesce(known, F.lit(0.0)))


def score(has_funder: Column, coi: Column, level: Column, open_access: Column, cited: Column, registered: Column, results: Column) -> Column:
    """Points of what is known, at most 100; nulls count as no."""
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), POINTS[n]).otherwise(0)
    total = points(has_funder, "funder") + points(coi, "coi") + points(level == "full_open", "full_open") + points(level == "on_request", "on_request")
    total = total + points(open_access, "open_access") + points(cited, "cited") + points(registered, "registered") + points(registered & results, "results")
    return F.least(F.lit(MOST_POINTS), total)


def risk_level(points: Column, industry: Column, level: Column, coi: Column, threshold: int = HIGH_RISK_BELOW, industry_matters: bool = True, coi_matters: bool = True) -> Column:
    """The first rule that holds decides."""
    restricted = level.isin("restricted", "not_available", "not_stated")
    return (
        F.when(points < threshold, "high")
        .when(F.lit(industry_matters) & industry & restricted, "high")
        .when(F.lit(coi_matters) & ~coi, "high")
        .when(points <= MEDIUM_RISK_TO, "medium")
        .when(industry, "medium")
        .otherwise("low")
    )


def analyze(papers: DataFrame, threshold: int = HIGH_RISK_BELOW, coi: tuple[str, ...] = COI_KEYWORDS, data: tuple[tuple[str, str], ...] = DATA_KEYWORDS) -> DataFrame:
    """Adds coi_disclosed, data_level, industry, industry_confidence, score, risk_level and indicators.

    ``papers``: funders array<string>, abstract, is_open_access, cited_by_count, trial_ids array<string> (sorted),
    results_posted array<string>.  At most three trials are looked at.
    """
    looked = F.slice("trial_ids", 1, 3)
    registered, posted = F.size("trial_ids") > 0, F.arrays_overlap(looked, F.col("results_posted"))
    out = papers.withColumn("coi_disclosed", coi_disclosed(F.col("abstract"), coi)).withColumn("data_level", data_level(F.col("abstract"), data)).withColumn("industry", industry_funded(F.col("funders")))
    out = out.withColumn("score", score(F.size("funders") > 0, F.col("coi_disclosed"), F.col("data_level"), F.col("is_open_access"), F.col("cited_by_count") > 0, registered, posted))
    out = out.withColumn("risk_level", risk_level(F.col("score"), F.col("industry"), F.col("data_level"), F.col("coi_disclosed"), threshold))
    out = out.withColumn("industry_confidence", industry_confidence(F.col("funders")))
    named = F.transform(F.filter("funders", lambda f: is_industry(f)), lambda f: F.concat(F.lit("Industry funder: "), f))
    said = F.array_compact(
        F.array(
            F.when(F.size("funders") == 0, "No funder information"),
            F.when(F.col("abstract").isNotNull() & ~F.col("coi_disclosed"), "No COI disclosure found"),
            F.when(F.col("data_level") == "not_available", "Data explicitly not available"),
            F.when(registered & ~F.coalesce(posted, F.lit(False)), "Registered trial without posted results"),
        )
    )
    return out.withColumn("indicators", F.concat(F.coalesce(named, F.array().cast("array<string>")), said))


def downgraded(tier: Column, level: Column, amount: int = 1) -> Column:
    """The evidence tier after the downgrade that a high risk asks for."""
    return F.when(level == "high", F.greatest(tier - amount, F.lit(0))).otherwise(tier)
