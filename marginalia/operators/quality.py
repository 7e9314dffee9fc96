"""Study design, evidence tier and quality filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dims import DESIGN_TIER, OTHER_FACTOR, RANKED_CONFIDENCE, design_dimension, type_dimension
from marginalia.functions.text import clamp, json_object, normalize_type, strip

DESIGNS = tuple(d for d, _, _ in DESIGN_TIER)
BIAS_DOMAINS = ("selection", "performance", "detection", "attrition", "reporting")


def classify_types(papers: DataFrame, id_col: str = "id", types_col: str = "publication_types") -> DataFrame:
    """(id, design, tier, default_score, confidence, assessment_tier) from publication types.

    The known type of best priority decides; without one, the first other known type with less confidence.  Types are
    compared without case, hyphens and underscores.  Papers without a known type are unclassified.
    """
    spark = papers.sparkSession
    seen = papers.select(F.col(id_col).alias("id"), F.posexplode_outer(types_col).alias("pos", "type")).withColumn("norm", normalize_type(F.col("type")))
    hit = seen.join(F.broadcast(type_dimension(spark)), "norm", "left")
    # ranked types first by rank, others after them by their place
    order = F.when(F.col("design").isNotNull(), F.struct(F.coalesce(F.col("rank"), F.lit(1000)).alias("r"), F.col("pos").alias("p")))
    best = hit.groupBy("id").agg(F.min_by("design", order).alias("design"), F.min(order)["r"].alias("r"))
    confidence = F.when(F.col("r") < 1000, RANKED_CONFIDENCE).when(F.col("r") == 1000, RANKED_CONFIDENCE * OTHER_FACTOR).otherwise(0.0)
    known = best.select("id", F.coalesce("design", F.lit("unknown")).alias("design"), confidence.alias("confidence"), F.when(F.col("r").isNotNull(), 1).otherwise(0).alias("assessment_tier"))
    return known.join(F.broadcast(design_dimension(spark)), "design").select("id", "design", "tier", "default_score", "confidence", "assessment_tier")


@dataclass(frozen=True)
class QualityFilter:
    min_tier: int = 0
    require_randomization: bool = False
    require_blinding: bool = False
    min_sample_size: int | None = None
    use_metadata_only: bool = False
    use_llm_classification: bool = True
    use_detailed_assessment: bool = False

    def predicate(self) -> Column:
        """A null sample size passes; a null randomisation or blinding does not, where it is required."""
        p = F.col("tier") >= self.min_tier
        if self.require_randomization:
            p = p & F.coalesce(F.col("is_randomized"), F.lit(False))
        if self.require_blinding:
            p = p & (F.coalesce(F.col("is_blinded"), F.lit("none")) != "none")
        if self.min_sample_size is not None:
            p = p & (F.col("sample_size").isNull() | (F.col("sample_size") >= self.min_sample_size))
        return p


def needed_tier(filter_: QualityFilter) -> Column:
    """Which assessor decides: 1 metadata, 2 classifier, 3 detailed assessor. Only rows above 1 go to a model."""
    if filter_.use_metadata_only:
        return F.lit(1)
    sure = (F.col("confidence") >= RANKED_CONFIDENCE) & (F.col("tier") > 0)
    if filter_.use_detailed_assessment:
        return F.lit(3)
    return F.when(sure, 1).otherwise(2 if filter_.use_llm_classification else 1)


#: Columns of an assessment by any tier.
ASSESSMENT = """id long, assessment_tier int, extraction_method string, study_design string, quality_tier int, quality_score double, evidence_level string,
    is_randomized boolean, is_controlled boolean, is_blinded string, is_prospective boolean, is_multicenter boolean, sample_size int, confidence double,
    bias_risk struct<selection:string,performance:string,detection:string,attrition:string,reporting:string>, strengths array<string>, limitations array<string>"""
BLINDING = ("none", "single", "double", "triple")


def _answer(answers: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_v``, the JSON object of an answer as a variant."""
    return answers.withColumn("_v", F.try_parse_json(json_object(F.col(text_col))))


def _value(path: str, kind: str) -> Column:
    return F.try_variant_get("_v", f"$.{path}", kind)


def _missing(path: str) -> Column:
    return F.variant_get("_v", f"$.{path}", "variant").isNull()


def _number(path: str, default: float, low: float, high: float) -> tuple[Column, Column]:
    """(value within bounds, whether the answer holds no other thing in its place); a JSON null is no number."""
    value = _value(path, "double")
    return clamp(F.coalesce(value, F.lit(default)), low, high), _missing(path) | value.isNotNull()


def _design() -> tuple[Column, Column]:
    named = F.lower(strip(_value("study_design", "string")))
    is_text = F.schema_of_variant(F.variant_get("_v", "$.study_design", "variant")) == "STRING"
    return F.when(named.isin(*DESIGNS), named).otherwise("unknown"), _missing("study_design") | is_text


def _sample_size() -> Column:
    return F.coalesce(_value("sample_size", "int"), _value("sample_size", "double").cast("int"))


def decode_classification(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """Adds study_design, confidence (0 to 1, 0.5 if missing), sample_size and is_blinded from a classifier's JSON.

    Without a valid answer the paper is unclassified: unknown design, confidence 0, the rest null.
    """
    design, named = _design()
    confidence, sure = _number("confidence", 0.5, 0.0, 1.0)
    valid = F.col("_v").isNotNull() & named & sure
    blinding = _value("blinding", "string")
    return (
        _answer(answers, text_col)
        .withColumn("is_valid", F.coalesce(valid, F.lit(False)))
        .withColumn("study_design", F.when(F.col("is_valid"), design).otherwise("unknown"))
        .withColumn("confidence", F.when(F.col("is_valid"), confidence).otherwise(0.0))
        .withColumn("sample_size", F.when(F.col("is_valid"), _sample_size()))
        .withColumn("is_blinded", F.when(F.col("is_valid") & blinding.isin(*BLINDING), blinding))
        .drop("_v")
    )


def decode_assessment(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """Adds what a detailed assessor's JSON says: design, score (0 to 10), characteristics, bias risk, strengths, limitations.

    Without a valid answer the paper is unclassified.  Values of a wrong kind are null, an unknown bias is unclear.
    """
    design, named = _design()
    score, scored = _number("quality_score", 0.0, 0.0, 10.0)
    confidence, sure = _number("confidence", 0.5, 0.0, 1.0)
    part = lambda name: _missing(name) | F.schema_of_variant(F.variant_get("_v", f"$.{name}", "variant")).startswith("OBJECT")
    valid = F.col("_v").isNotNull() & named & scored & sure & part("design_characteristics") & part("bias_risk")
    blinding = _value("design_characteristics.blinded", "string")
    said = {
        "study_design": design, "quality_score": score, "evidence_level": _value("evidence_level", "string"),
        **{f"is_{n}": _value(f"design_characteristics.{n}", "boolean") for n in ("randomized", "controlled", "prospective", "multicenter")},
        "is_blinded": F.when(blinding.isin(*BLINDING), blinding), "sample_size": _sample_size(), "confidence": confidence,
        "bias_risk": F.struct(*[validated_bias(_value(f"bias_risk.{d}", "string")).alias(d) for d in BIAS_DOMAINS]),
        **{n: F.coalesce(_value(n, "array<string>"), F.array().cast("array<string>")) for n in ("strengths", "limitations")},
    }
    none = {"study_design": F.lit("unknown"), "quality_score": F.lit(0.0), "confidence": F.lit(0.0)} | {n: F.array().cast("array<string>") for n in ("strengths", "limitations")}
    out = _answer(answers, text_col).withColumn("is_valid", F.coalesce(valid, F.lit(False)))
    return out.withColumns({n: F.when(F.col("is_valid"), c).otherwise(none.get(n, F.lit(None))) for n, c in said.items()}).drop("_v")


def assess(metadata: DataFrame, classifier: DataFrame, assessor: DataFrame, filter_: QualityFilter) -> DataFrame:
    """The result of the tier that decides each paper, in the columns of ``ASSESSMENT``.

    ``metadata``: the result of ``classify_types``; ``classifier`` and ``assessor``: (id, answer) of the papers asked.
    Only rows that a tier decides are joined with its answers; a paper without an answer is unclassified.
    """
    spark = metadata.sparkSession
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], ASSESSMENT).schema}
    decided = metadata.withColumn("_by", needed_tier(filter_))

    def shaped(frame: DataFrame) -> DataFrame:
        empty = F.array().cast("array<string>")
        return frame.select(*[(F.col(n) if n in frame.columns else empty if n in ("strengths", "limitations") else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    def by_model(tier: int, answers: DataFrame, method: str) -> DataFrame:
        asked = decided.where(F.col("_by") == tier).select("id").join(answers.select("id", "answer"), "id", "left")
        decoded = (decode_classification if tier == 2 else decode_assessment)(asked)
        graded = decoded.join(F.broadcast(design_dimension(spark)), decoded["study_design"] == F.col("design"))
        graded = graded.withColumn("quality_tier", F.col("tier")).withColumn("assessment_tier", F.when(F.col("is_valid"), tier).otherwise(0)).withColumn("extraction_method", F.when(F.col("is_valid"), method).otherwise("none"))
        return shaped(graded.withColumn("quality_score", F.col("default_score")) if tier == 2 else graded)

    first = decided.where("_by = 1").withColumnsRenamed({"design": "study_design", "tier": "quality_tier", "default_score": "quality_score"})
    first = shaped(first.withColumn("extraction_method", F.when(F.col("assessment_tier") > 0, "pubmed_metadata").otherwise("none")))
    return first.unionByName(by_model(2, classifier, "llm_classifier")).unionByName(by_model(3, assessor, "llm_deep_assessment"))


def validated_bias(domain: Column) -> Column:
    """One of the three levels as they are written; anything else is unclear."""
    return F.when(domain.isin("low", "unclear", "high"), domain).otherwise("unclear")
