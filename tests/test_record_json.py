import json

from pyspark.sql import functions as F

from marginalia.functions import record_json as R


def made(spark, f, *texts):
    return [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_assessments(spark):
    full = {"assessment_tier": 2, "extraction_method": "m", "study_design": "rct", "quality_tier": 4, "quality_score": 7.5, "evidence_level": "1b", "is_randomized": True, "is_controlled": None, "is_blinded": "double", "is_prospective": False, "is_multicenter": True, "sample_size": 12, "confidence": 0.5, "strengths": ["a"], "limitations": [], "transparency_adjusted": True, "bias_risk": {"selection": "low", "performance": "odd", "detection": None}}
    whole, bare, other, bad, none, broken = made(spark, R.assessment, json.dumps(full), "{}", '{"study_design": "novel", "strengths": null}', '{"quality_tier": 9}', None, "[1]")
    want = full | {"bias_risk": {"selection": "low", "performance": "unclear", "detection": "unclear", "attrition": "unclear", "reporting": "unclear"}}
    assert whole.asDict(recursive=True) == want
    assert (bare["extraction_method"], bare["study_design"], bare["quality_score"], bare["strengths"], bare["bias_risk"], bare["transparency_adjusted"]) == ("none", "unknown", 0.0, [], None, False)
    assert other["study_design"] == "unknown" and other["strengths"] is None
    assert bad is none is broken is None
    text = made(spark, lambda t: R.assessment_json(R.assessment(t)), json.dumps(full), "{}")
    assert json.loads(text[0]) == want and "bias_risk" not in json.loads(text[1]) and json.loads(text[1])["sample_size"] is None


def test_transparency_results(spark):
    given = {"document_id": "d", "transparency_score": 40, "risk_level": "high"}
    got, *none = made(spark, R.transparency, json.dumps(given), '{"document_id": "d"}', json.dumps(given | {"risk_level": "huge"}), "{")
    assert none == [None, None, None]
    assert (got["coi_disclosed"], got["data_availability_level"], got["analyzer_version"], got["risk_indicators"], got["analyzed_at"]) == (True, "unknown", "1.0", [], None)
    again = made(spark, lambda t: R.transparency_json(R.transparency(t)), json.dumps(given))[0]
    assert made(spark, R.transparency, again)[0] == got and list(json.loads(again))[:3] == ["document_id", "transparency_score", "risk_level"]


def test_full_text_entries(spark):
    a, b, c = made(spark, lambda t: R.entry_json(R.entry(t)), '{"url": "u", "format": "pdf", "source": "s"}', '{"url": "u", "format": "pdf", "source": "s", "open_access": false, "version": "accepted"}', '{"url": "u"}')
    assert json.loads(a) == {"url": "u", "format": "pdf", "source": "s", "open_access": True}
    assert json.loads(b) == {"url": "u", "format": "pdf", "source": "s", "open_access": False, "version": "accepted"} and c is None
