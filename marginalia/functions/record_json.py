"""Assessments, transparency results and full-text entries as JSON text and back, as expressions.

A key that is missing gets its field's default; one that is there keeps what it holds, null included.  A record without a
required key, with a value that its field does not allow, or that is no JSON object, is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.dims import DESIGN_TIER

_DESIGNS = [d for d, *_ in DESIGN_TIER]
_NONE = "[]"


@dataclass(frozen=True)
class Field:
    """``default`` is JSON (null by default); ``allowed``: other values make the record null, or ``otherwise`` if given."""

    name: str
    kind: str
    default: str = "null"
    required: bool = False
    allowed: tuple = ()
    otherwise: str | None = None


BIAS = tuple(Field(n, "string", '"unclear"', allowed=("low", "unclear", "high"), otherwise="unclear") for n in ("selection", "performance", "detection", "attrition", "reporting"))
ASSESSMENT = (
    Field("assessment_tier", "int", "0"), Field("extraction_method", "string", '"none"'), Field("study_design", "string", '"unknown"', allowed=tuple(_DESIGNS), otherwise="unknown"),
    Field("quality_tier", "int", "0", allowed=tuple(range(6))), Field("quality_score", "double", "0.0"), Field("evidence_level", "string"), *(Field(f"is_{n}", "boolean") for n in ("randomized", "controlled")),
    Field("is_blinded", "string"), *(Field(f"is_{n}", "boolean") for n in ("prospective", "multicenter")), Field("sample_size", "int"), Field("confidence", "double", "0.0"),
    Field("strengths", "array<string>", _NONE), Field("limitations", "array<string>", _NONE), Field("transparency_adjusted", "boolean", "false"),
)
TRANSPARENCY = (
    Field("document_id", "string", required=True), Field("transparency_score", "int", required=True), Field("risk_level", "string", required=True, allowed=("low", "medium", "high", "unknown")),
    Field("industry_funding_detected", "boolean", "false"), Field("industry_funding_confidence", "double", "0.0"), Field("data_availability_level", "string", '"unknown"'), Field("coi_disclosed", "boolean", "true"),
    Field("trial_registered", "boolean", "false"), Field("trial_results_compliant", "boolean", "false"), Field("outcome_switching_detected", "boolean", "false"), Field("risk_indicators", "array<string>", _NONE),
    Field("tier_downgrade_applied", "int", "0"), Field("analyzed_at", "string"), Field("analyzer_version", "string", '"1.0"'),
)
ENTRY = (Field("url", "string", required=True), Field("format", "string", required=True), Field("source", "string", required=True), Field("open_access", "boolean", "true"), Field("version", "string"))


def schema(fields: tuple[Field, ...], more: str = "") -> str:
    return ", ".join([f"{f.name} {f.kind}" for f in fields] + ([more] if more else []))


def _checked(f: Field, value: Column) -> Column:
    if f.allowed and f.otherwise is not None:
        return F.when(value.isin(*f.allowed), value).otherwise(f.otherwise)
    return value


def decoded(text: Column, fields: tuple[Field, ...]) -> Column:
    """The record as a struct of its fields."""
    r, keys = F.from_json(text, schema(fields)), F.json_object_keys(text)
    has = lambda f: F.array_contains(keys, f.name)
    default = lambda f: F.lit(None).cast(f.kind) if f.default == "null" else F.from_json(F.lit(f'{{"x":{f.default}}}'), f"x {f.kind}")["x"]
    made = F.struct(*[_checked(f, F.when(has(f), r[f.name]).otherwise(default(f))).alias(f.name) for f in fields])
    ok = keys.isNotNull()
    for f in fields:
        if f.required:
            ok = ok & has(f)
        if f.allowed and f.otherwise is None:
            ok = ok & (~has(f) | F.coalesce(r[f.name].isin(*f.allowed), F.lit(False)))
    return F.when(ok, made)


def encoded(field: Callable[[str], Column], fields: tuple[Field, ...], optional: tuple[str, ...] = ()) -> Column:
    """The record as JSON, nulls included, but for ``optional`` keys, which stand only where they have a value."""
    plain = [f.name for f in fields if f.name not in optional]
    whole = F.to_json(F.struct(*[field(n).alias(n) for n in plain]), {"ignoreNullFields": "false"})
    if not optional:
        return whole
    rest = F.to_json(F.struct(*[field(n).alias(n) for n in optional]))
    return F.when(rest == "{}", whole).otherwise(F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))


def assessment(text: Column) -> Column:
    """An assessment from its JSON; ``bias_risk`` is null where its key is missing, and its words are checked one by one."""
    inner = F.get_json_object(text, "$.bias_risk")
    record = decoded(text, ASSESSMENT)
    return F.when(record.isNotNull(), record.withField("bias_risk", decoded(inner, BIAS)))


def assessment_json(record: Column) -> Column:
    """An assessment as JSON; ``bias_risk`` stands only where there is one."""
    return F.when(record.isNotNull(), encoded(lambda n: record[n], (*ASSESSMENT, Field("bias_risk", "")), ("bias_risk",)))


def transparency(text: Column) -> Column:
    return decoded(text, TRANSPARENCY)


def transparency_json(record: Column) -> Column:
    return F.when(record.isNotNull(), encoded(lambda n: record[n], TRANSPARENCY))


def entry(text: Column) -> Column:
    return decoded(text, ENTRY)


def entry_json(record: Column) -> Column:
    """A full-text entry as JSON; ``version`` stands only where there is one, a blank one being none."""
    return F.when(record.isNotNull(), encoded(lambda n: F.nullif(record[n], F.lit("")) if n == "version" else record[n], ENTRY, ("version",)))
