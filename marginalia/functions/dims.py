"""Dimension tables and keyword lists: fixed values of the subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Publication type, study design.
TYPE_DESIGN = (
    ("Systematic Review", "systematic_review"),
    ("Meta-Analysis", "meta_analysis"),
    ("Randomized Controlled Trial", "rct"),
    ("Controlled Clinical Trial", "rct"),
    ("Clinical Trial", "rct"),
    ("Clinical Trial, Phase I", "rct"),
    ("Clinical Trial, Phase II", "rct"),
    ("Clinical Trial, Phase III", "rct"),
    ("Clinical Trial, Phase IV", "rct"),
    ("Pragmatic Clinical Trial", "rct"),
    ("Equivalence Trial", "rct"),
    ("Multicenter Study", "rct"),
    ("Observational Study", "cohort_prospective"),
    ("Cohort Study", "cohort_prospective"),
    ("Longitudinal Study", "cohort_prospective"),
    ("Prospective Study", "cohort_prospective"),
    ("Retrospective Study", "cohort_retrospective"),
    ("Case-Control Study", "case_control"),
    ("Cross-Sectional Study", "cross_sectional"),
    ("Twin Study", "cross_sectional"),
    ("Validation Study", "cross_sectional"),
    ("Comparative Study", "cross_sectional"),
    ("Case Reports", "case_report"),
    ("Practice Guideline", "guideline"),
    ("Guideline", "guideline"),
    ("Consensus Development Conference", "guideline"),
    ("Editorial", "editorial"),
    ("Letter", "letter"),
    ("Comment", "comment"),
    ("Review", "other"),
    ("Published Erratum", "other"),
    ("Retracted Publication", "other"),
)

# The order in which types decide, the most specific first.
TYPE_PRIORITY = (
    "Systematic Review",
    "Meta-Analysis",
    "Randomized Controlled Trial",
    "Controlled Clinical Trial",
    "Pragmatic Clinical Trial",
    "Clinical Trial, Phase III",
    "Clinical Trial, Phase IV",
    "Clinical Trial, Phase II",
    "Clinical Trial, Phase I",
    "Clinical Trial",
    "Case-Control Study",
    "Cohort Study",
    "Longitudinal Study",
    "Prospective Study",
    "Retrospective Study",
    "Cross-Sectional Study",
    "Observational Study",
    "Case Reports",
    "Practice Guideline",
    "Guideline",
    "Editorial",
    "Letter",
    "Comment",
)

# Study design, tier, default score.
DESIGN_TIER = (
    ("systematic_review", 5, 9.0),
    ("meta_analysis", 5, 9.0),
    ("guideline", 5, 8.5),
    ("rct", 4, 8.0),
    ("cohort_prospective", 3, 6.0),
    ("cohort_retrospective", 3, 5.0),
    ("case_control", 2, 4.5),
    ("cross_sectional", 2, 4.0),
    ("case_series", 1, 3.0),
    ("case_report", 1, 2.0),
    ("editorial", 1, 1.5),
    ("letter", 1, 1.5),
    ("comment", 1, 1.0),
    ("other", 0, 0.0),
    ("unknown", 0, 0.0),
)

# Confidence of a type with a priority, and the factor for other known types.
RANKED_CONFIDENCE, OTHER_FACTOR = 0.9, 0.8

# Words that mark industry funding, disclosure of interests, and data availability (the first decides).
INDUSTRY_CONFIDENCE = 0.8
INDUSTRY_KEYWORDS = ("pharma", "biotech", "therapeutics", "inc.", "corp.", "ltd.", "gmbh", "laboratories", "employee of", "speaker fee", "consultant for", "advisory board")
COI_KEYWORDS = ("conflict of interest", "competing interest", "no conflict", "nothing to disclose", "declare no", "financial disclosure")
DATA_KEYWORDS = (
    ("zenodo", "full_open"),
    ("figshare", "full_open"),
    ("dryad", "full_open"),
    ("github", "full_open"),
    ("available upon request", "on_request"),
    ("upon reasonable request", "on_request"),
    ("not available", "not_available"),
)

# Points of the transparency score and its limits.
POINTS = {"funder": 15, "coi": 10, "full_open": 20, "on_request": 10, "open_access": 15, "cited": 5, "registered": 20, "results": 15}
MOST_POINTS, HIGH_RISK_BELOW, MEDIUM_RISK_TO = 100, 40, 70

# Names of location versions, order of full-text formats.
VERSIONS = (("publishedVersion", "published"), ("acceptedVersion", "accepted"), ("submittedVersion", "preprint"))
FORMAT_RANK = (("xml", 0), ("pdf", 1), ("html", 2))


def type_dimension(spark: SparkSession) -> DataFrame:
    """(norm, canonical, design, rank): rank is null for types without a priority."""
    rank = {t: i for i, t in enumerate(TYPE_PRIORITY)}
    rows = [(t.strip().lower().replace("-", " ").replace("_", " "), t, d, rank.get(t)) for t, d in TYPE_DESIGN]
    return spark.createDataFrame(rows, "norm string, canonical string, design string, rank int")


def design_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DESIGN_TIER), "design string, tier int, default_score double")
