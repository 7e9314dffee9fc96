"""Registered queries over models' answers, the store of publications and the full-text cache, each with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import record_json
from marginalia.functions import text as T
from marginalia.operators import enrichment, fulltext, merge, quality, record_store, store, usage
from marginalia.operators.shared import fresh_path
from marginalia.plans.catalog import CLASSIFIED_SQL, HOST, classified, query, read


def classifier_answers(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Events as answers of a classifier: fenced, in prose, twice, and one with a null where a number belongs."""
    k = F.col("k")
    said = read(spark, sf_dir, "events").select(F.col("event_id").alias(name), F.get_json_object("props", "$.k").cast("int").alias("k"))
    answer = (
        F.when(k % 4 == 0, F.concat(F.lit('Sure:\n```json\n{"study_design": " RCT ", "confidence": '), (k / 10 - 1).cast("string"), F.lit(', "sample_size": '), k.cast("string"), F.lit("}\n```")))
        .when(k % 4 == 1, F.concat(F.lit('I think {"study_design": "cohort_prospective", "blinding": "'), F.when(k % 3 == 0, "Double").otherwise("double"), F.lit('"} fits')))
        .when(k % 4 == 2, F.lit('{"study_design": "rct"} and {"study_design": "letter"}'))
        .otherwise(F.lit('{"study_design": "rct", "confidence": null}'))
    )
    return said.withColumn("answer", answer)


@query("""
    with a as (select event_id, (props->>'k')::int as k from events)
    select event_id, case k % 4 when 0 then 'rct' when 1 then 'cohort_prospective' else 'unknown' end as study_design, case when k % 4 = 1 and k % 3 <> 0 then 'double' end as is_blinded,
           case k % 4 when 0 then least(1.0, greatest(0.0, k / 10.0 - 1))::double when 1 then 0.5 else 0.0 end as confidence, case when k % 4 = 0 then k end::varchar as sample_size from a
""")
def llm_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = quality.decode_classification(classifier_answers(spark, sf_dir, "event_id"))
    return decoded.select("event_id", "study_design", "is_blinded", "confidence", F.col("sample_size").cast("string").alias("sample_size"))


def assessor_answers(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Events as answers of a detailed assessor; every fifth has no object where one belongs."""
    k = F.col("k")
    said = read(spark, sf_dir, "events").select(F.col("event_id").alias(name), F.get_json_object("props", "$.k").cast("int").alias("k"))
    yes = F.when(k % 2 == 0, "true").otherwise("false")
    characteristics = F.when(k % 5 == 0, "null").otherwise(F.concat(F.lit('{"randomized": '), yes, F.lit(', "controlled": null, "blinded": "'), F.when(k % 3 == 0, "triple").otherwise("unsure"), F.lit('"}')))
    answer = F.concat(
        F.lit('{"study_design": "Case_Control", "quality_score": '), (k / 4).cast("string"), F.lit(', "confidence": "0.75", "evidence_level": "3b", "design_characteristics": '), characteristics,
        F.lit(', "bias_risk": {"selection": "high", "attrition": "HIGH"}, "strengths": ["size '), k.cast("string"), F.lit('"], "limitations": []}'),
    )
    return said.withColumn("answer", answer)


ASSESSED_SQL = """
    a as (select event_id, (props->>'k')::int as k from events),
    said as (select event_id, k % 5 <> 0 as ok, case when k % 5 <> 0 then least(10, k / 4.0)::double else 0.0 end as score, case when k % 5 <> 0 and k % 3 = 0 then 'triple' end as blinded,
             case when k % 5 <> 0 then k % 2 = 0 end as randomized, case when k % 5 <> 0 then concat('size ', k) else '' end as strengths from a)
"""


@query(f"""
    with {ASSESSED_SQL}
    select event_id, case when ok then 'case_control' else 'unknown' end as study_design, score as quality_score, case when ok then 0.75 else 0.0 end::double as confidence, case when ok then '3b' end as evidence_level,
           randomized as is_randomized, null::boolean as is_controlled, blinded as is_blinded, case when ok then 'high' end as selection, case when ok then 'unclear' end as attrition, strengths from said
""")
def assessor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.decode_assessment(assessor_answers(spark, sf_dir, "event_id"))
    return d.select("event_id", "study_design", "quality_score", "confidence", "evidence_level", "is_randomized", "is_controlled", "is_blinded", "bias_risk.selection", "bias_risk.attrition", F.array_join("strengths", ",").alias("strengths"))


def cascade_sql(detailed: bool) -> str:
    """The tiers' results united: events are the models' answers on the parts of the same number."""
    decided = "3" if detailed else "case when confidence >= 0.9 and tier > 0 then 1 else 2 end"
    return f"""
    with {CLASSIFIED_SQL}, {ASSESSED_SQL},
    by_tier as (select *, {decided} as decided_by from classified),
    two as (select event_id, case k % 4 when 0 then 'rct' when 1 then 'cohort_prospective' else 'unknown' end as d, case k % 4 when 0 then least(1.0, greatest(0.0, k / 10.0 - 1))::double when 1 then 0.5 else 0.0 end as c, k % 4 < 2 as fine from a)
    select id, assessment_tier, case assessment_tier when 1 then 'pubmed_metadata' else 'none' end as extraction_method, design as study_design, tier as quality_tier, default_score as quality_score, confidence from by_tier where decided_by = 1
    union all select id, case when fine then 2 else 0 end, case when fine then 'llm_classifier' else 'none' end, t.design, t.tier::int, t.default_score::double, coalesce(c, 0.0) from by_tier b left join two on event_id = id join tiers t on t.design = coalesce(d, 'unknown') where decided_by = 2
    union all select id, case when ok then 3 else 0 end, case when ok then 'llm_deep_assessment' else 'none' end, t.design, t.tier::int, coalesce(score, 0.0), case when ok then 0.75 else 0.0 end from by_tier b left join said on event_id = id join tiers t on t.design = case when ok then 'case_control' else 'unknown' end where decided_by = 3
    """


def cascade(spark: SparkSession, sf_dir: str, detailed: bool) -> DataFrame:
    met = quality.assess(classified(spark, sf_dir), classifier_answers(spark, sf_dir, "id"), assessor_answers(spark, sf_dir, "id"), quality.QualityFilter(use_detailed_assessment=detailed))
    return met.select("id", "assessment_tier", "extraction_method", "study_design", "quality_tier", "quality_score", "confidence")


@query(cascade_sql(False))
def cascade_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(spark, sf_dir, False)


@query(cascade_sql(True))
def cascade_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(spark, sf_dir, True)


@query("""
    with c as (select conv_id, turn, length(text) % 4 as k, conv_id * 100 + turn as n from conversations)
    select conv_id, turn, case k when 0 then concat('[', n, ', 2]') when 1 then concat('{"a": ', n, '}') when 2 then concat('{"a": 1} and {"b": ', n, '}') else concat('none in ', n) end as json from c
""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON text in an answer: fenced, in prose, two objects (none), none."""
    k, n = F.length("text") % 4, (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    fence = F.lit("```")
    answer = (
        F.when(k == 0, F.concat(F.lit("So {not this}: "), fence, F.lit("json\n["), n, F.lit(", 2]\n"), fence))
        .when(k == 1, F.concat(F.lit("Here "), fence, F.lit("\nnot json\n"), fence, F.lit(' or {"a": '), n, F.lit("} then")))
        .when(k == 2, F.concat(F.lit('{"a": 1} and {"b": '), n, F.lit("}")))
        .otherwise(F.concat(F.lit("none in "), n))
    )
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.extract_json(answer).alias("json"))


@query("""
    with r as (select p_partkey as i, p_name as t, p_brand as s, p_size as z, p_type as raw from part)
    select i as id, case when i % 7 = 0 then raw else concat_ws('. ', case i % 3 when 0 then 'Ann Roe' when 1 then 'Ann Roe, Bo Li, et al.' end, t, s, concat('(', 1950 + z, ')'),
        case when i % 2 = 0 then concat('v', z, case when i % 4 = 0 then '(s)' else '' end, ':', i, '-', i + z) else concat(i, '') end, case when i % 5 <> 0 then concat('doi:10.5/', i) end) end as citation from r
""")
def plain_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, z = F.col("p_partkey"), F.col("p_size")
    kept = lambda c: F.when(i % 7 != 0, c).otherwise("")
    names = F.when(i % 3 == 0, F.array(F.lit("Ann Roe"))).when(i % 3 == 1, F.array(*map(F.lit, ("Ann Roe", "Bo Li", "Cy Po", "Di Ka"))))
    r = F.struct(
        F.coalesce(F.when(i % 7 != 0, names), F.array().cast("array<string>")).alias("authors"), kept(F.col("p_name")).alias("article_title"), kept(F.col("p_brand")).alias("source"), kept((z + 1950).cast("string")).alias("year"),
        kept(F.when(i % 2 == 0, F.concat(F.lit("v"), z)).otherwise("")).alias("volume"), kept(F.when(i % 4 == 0, "s").otherwise("")).alias("issue"), kept(i.cast("string")).alias("first_page"), kept(F.when(i % 2 == 0, (i + z).cast("string")).otherwise("")).alias("last_page"),
        kept(F.when(i % 5 != 0, F.concat(F.lit("10.5/"), i)).otherwise("")).alias("doi"), F.col("p_type").alias("citation"),
    )
    return read(spark, sf_dir, "part").select(i.alias("id"), T.plain_citation(r).alias("citation"))


@query("select row_number() over (order by doc_id) + (select max(page_id) from pages) as id, md5(text) as title, source as first_seen_source, '2023-05-06 07:08:09' as created_at from documents")
def insert_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as new publications behind the pages as stored ones; then dumped as text and read again."""
    none = F.lit(None).cast("string")
    texts = [none.alias(c) for c in store.TEXTS if c not in ("title", "first_seen_source")]
    lists = [F.array("source").alias(c) for c in store.LISTS]
    new = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.md5("text").alias("title"), *texts, F.col("source").alias("first_seen_source"), *lists, F.lit(True).alias("is_open_access"))
    rows = store.insert_rows(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), new, "2023-05-06T07:08:09")
    again = store.decode_rows(store.encode_rows(rows)).where(F.col("is_open_access") & (F.col("sources") == F.array("first_seen_source")))
    return again.select("id", "title", "first_seen_source", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("""
    select doc_id as id, concat('{"id":', doc_id, ',"title":', to_json(lang), ',"doi":null,"sources":[', to_json(source), ']}') as json, source, false as is_open_access, 0::int as n_authors from documents
""")
def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON text, and typed again with what is missing filled in."""
    text = store.record_json({"id": F.col("doc_id"), "title": F.col("lang"), "doi": F.lit(None).cast("string"), "sources": F.array("source")})
    r = F.col("r")
    rows = read(spark, sf_dir, "documents").select(text.alias("json")).withColumn("r", store.record_from_json(F.col("json")))
    return rows.select(r["id"].alias("id"), "json", r["sources"][0].alias("source"), r["is_open_access"].alias("is_open_access"), F.size(r["authors"]).alias("n_authors"))


@query("""
    with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as identifier, html from pages),
    w as (select identifier, 'html' as kind, page_id, html as body from p where html is not null union all select identifier, 'pdf', page_id, '%PDFx' from p where page_id % 3 = 0)
    select identifier, kind, max(page_id) as page_id, md5(arg_max(body, page_id)) as body_md5 from w where identifier not in (select identifier from p where page_id % 50 = 7) group by identifier, kind
""")
def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to a cache by host, some with a PDF, some with what is none; then some hosts are deleted."""
    p = F.col("page_id")
    pages = read(spark, sf_dir, "pages").select(p, F.regexp_extract("url", HOST, 1).alias("identifier"), "html")
    body = F.when(p % 3 == 0, F.lit("%PDFx")).when(p % 3 == 1, F.lit("<html>")).cast("binary")
    written = fulltext.cache_rows(pages.withColumn("pdf", body), "page_id")
    kept = fulltext.cache_without(fulltext.cache_after(written.limit(0), written, "page_id"), pages.where("page_id % 50 = 7"))
    return kept.select("identifier", "kind", "page_id", F.md5(F.coalesce(F.col("html").cast("binary"), "pdf")).alias("body_md5"))


#: Orders through a store of two unique keys, as rounds that repeat until no outcome changes.
FOLD_SQL = """
    with recursive base as (select o_orderkey as seq, case when o_orderkey % 4 <> 0 then concat('d', o_custkey) end as doi, case when o_orderkey % 3 <> 0 then concat('p', o_orderkey // 3) end as pmid from orders),
    r as (
        select 0 as i, seq, doi, pmid, null::bigint as publication, '' as outcome, false as td, false as tp, false as same from base
        union all (
            with hd as (select doi, min(seq) as s, arg_min(publication, seq) as p from r where td group by doi), hp as (select pmid, min(seq) as s, arg_min(publication, seq) as p from r where tp group by pmid),
            fd as (select publication as p, min(seq) as s from r where td group by publication), fp as (select publication as p, min(seq) as s from r where tp group by publication),
            j as (select r.*, case when hd.s < seq then hd.p end as bd, case when hp.s < seq then hp.p end as bp from r left join hd on r.doi = hd.doi left join hp on r.pmid = hp.pmid),
            k as (select j.*, coalesce(bd, bp, seq) as target, bd is null and bp is null as added from j),
            l as (select k.*, coalesce(fd.s >= seq, true) as free_d, coalesce(fp.s >= seq, true) as free_p from k left join fd on fd.p = target left join fp on fp.p = target),
            m as (select l.*, not added and free_p and coalesce(bp <> target, false) as failed from l),
            n as (select m.*, case when added then 'added' when failed then 'failed' else 'merged' end as o, doi is not null and (added or (not failed and free_d)) as nd, pmid is not null and (added or (not failed and free_p)) as np from m)
            select i + 1, seq, doi, pmid, target, o, nd, np, publication is not distinct from target and outcome = o and td = nd and tp = np from n where (select not bool_and(same) from r)
        )
    )
"""
LAST_ROUND = "r where i = (select max(i) from r)"


@query(f"{FOLD_SQL} select seq, publication, outcome from {LAST_ROUND}")
def component_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records with two identifiers: many customers share one, some orders bridge two."""
    return merge.merge_records(order_records(spark, sf_dir))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(o.alias("seq"), F.when(o % 4 != 0, F.concat(F.lit("d"), F.col("o_custkey"))).alias("doi"), F.when(o % 3 != 0, F.concat(F.lit("p"), F.floor(o / 3))).alias("pmid"))


@query(f"""{FOLD_SQL}, done as (select seq, publication, outcome from {LAST_ROUND}), ids as (select seq as publication, row_number() over (order by seq) as id from done where outcome = 'added')
    select seq, outcome, id, 'added' = outcome as is_new from done join ids using (publication)
""")
def store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders in two batches through a store on disk: what happened to each, and the id it has there."""
    rows = order_records(spark, sf_dir)
    names = [f.strip().split(" ") for f in record_store.FIELDS.split(", ")]
    rows = rows.select(*[F.col(n) if n in ("seq", "doi", "pmid") else F.lit("orders").alias(n) if n == "source" else F.lit(None).cast(kind).alias(n) for n, kind in names])
    kept = record_store.RecordStore(spark, f"store_{uuid.uuid4().hex[:12]}", fresh_path(spark, "store"), buckets=16)
    middle = rows.agg(F.floor(F.avg("seq"))).first()[0] or 0
    both = kept.add(0, rows.where(F.col("seq") <= middle)).unionByName(kept.add(1, rows.where(F.col("seq") > middle)))
    return both.select("seq", "outcome", "id", (F.col("outcome") == "added").alias("is_new"))


@query(r"""
    with d as (select doc_id as id, source, string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(10)) as lines from documents),
    p as (select *, list_transform(list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), lambda x: concat('<p>', regexp_replace(
            replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '\[([^\]]+)\]\(([^)]+)\)', '<a href="\2">\1</a>', 'g'), '</p>')) as shown from d),
    h as (select *, array_to_string(list_concat([concat('<p class="journal-info"><em>', source, '</em></p>'), concat('<p class="identifiers">DOI: <a href="https://doi.org/10.1/', id, '">10.1/', id, '</a></p>'), '<h2>T</h2>'], shown), chr(10)) as html from p)
    select id, source as journal, concat('10.1/', id) as doi, len(lines)::int as n_paragraphs, length(html)::int as n_html, md5(html) as html_md5, null::varchar as error from h
""")
def jats_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as journal articles and parsed again."""
    from marginalia.operators import jats

    body = F.array_join(F.transform(F.split(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), "\n"), lambda x: F.concat(F.lit("<p>"), T.html_escape(x), F.lit("</p>"))), "")
    xml = F.concat(F.lit("<article><front><journal-meta><journal-title>"), "source", F.lit('</journal-title></journal-meta><article-meta><article-id pub-id-type="doi">10.1/'), "doc_id", F.lit("</article-id></article-meta></front><body><sec><title>T</title>"), body, F.lit("</sec></body></article>"))
    parsed = jats.articles(read(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), "doc_id", "xml")
    return parsed.select("id", "journal", "doi", F.size(F.col("body_sections")[0]["paragraphs"]).alias("n_paragraphs"), F.length("html").alias("n_html"), F.md5(F.col("html").cast("binary")).alias("html_md5"), "error")


@query("""
    with l as (select user_id, ts, case when value >= 10 then concat('v', event_id) end as answer from events where event_id % 3 = 0),
    r as (select event_id, user_id, ts from events where event_id % 3 = 1),
    j as (select r.event_id, r.ts, l.ts as looked_at, l.answer from r asof left join l on r.user_id = l.user_id and r.ts >= l.ts)
    select event_id, case when ts - looked_at <= interval 2 day then answer end as answer, coalesce(ts - looked_at <= interval 2 day, false) as known from j
""")
def enrichment_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event as a lookup of its user, some without an answer; others take the newest of the last two days."""
    e = read(spark, sf_dir, "events")
    lookups = e.where("event_id % 3 = 0").select("user_id", F.col("ts").alias("at"), F.when(F.col("value") >= 10, F.concat(F.lit("v"), "event_id")).alias("answer"))
    rows = enrichment.as_of(e.where("event_id % 3 = 1").select("event_id", "user_id", F.col("ts").alias("at")), lookups, "user_id", 2)
    return rows.select("event_id", F.col("lookup.answer").alias("answer"), F.col("lookup").isNotNull().alias("known"))


@query("""
    with q as (select o_orderpriority as model, date_trunc('quarter', o_orderdate) as q, count(*) as n from orders group by all),
    p as (select model, q::timestamp as valid_from, case when n % 4 <> 0 then (q + interval 3 month)::timestamp end as valid_to, 1.0 + n % 7 as input_price, 2.0 + n % 5 as output_price from q where extract(quarter from q) % 2 = 1),
    s as (select *, lead(valid_from) over (partition by model order by valid_from) as later from p),
    f as (select o_orderpriority as model, (max(o_orderkey) % 10)::double as input_price, (max(o_custkey) % 10)::double as output_price from orders where o_orderpriority < '4' group by 1),
    c as (select o_orderkey as call_id, o_orderpriority as model, o_orderdate as called, floor(o_totalprice) as i, o_orderkey % 1000 as o from orders)
    select call_id, c.i / 1e6 * coalesce(s.input_price, f.input_price, 1.5) + c.o / 1e6 * coalesce(s.output_price, f.output_price, 6.0) as cost
    from c left join s on c.model = s.model and called >= valid_from and called < least(coalesce(valid_to, later, timestamp '9999-01-01'), coalesce(later, timestamp '9999-01-01')) left join f on c.model = f.model
""")
def cost_by_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls, priced by a list of each model's quarters with gaps and open ends, then by fallback lists."""
    o = read(spark, sf_dir, "orders")
    quarters = o.groupBy(F.col("o_orderpriority").alias("model"), F.date_trunc("quarter", "o_orderdate").alias("valid_from")).agg(F.count(F.lit(1)).alias("n")).where(F.quarter("valid_from") % 2 == 1)
    end = F.when(F.col("n") % 4 != 0, F.date_trunc("quarter", F.add_months("valid_from", 3)))
    prices = quarters.select("model", "valid_from", end.alias("valid_to"), (1.0 + F.col("n") % 7).alias("input_price"), (2.0 + F.col("n") % 5).alias("output_price"))
    fallback = o.where("o_orderpriority < '4'").groupBy(F.col("o_orderpriority").alias("model")).agg((F.max("o_orderkey") % 10).cast("double").alias("input_price"), (F.max("o_custkey") % 10).cast("double").alias("output_price"))
    calls = o.select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("at"), F.floor("o_totalprice").cast("double").alias("input_tokens"), (F.col("o_orderkey") % 1000).alias("output_tokens"))
    return usage.with_cost_at(calls, prices, fallback, (1.5, 6.0)).select("call_id", "cost")


@query("""
    with e as (select event_id, (props->>'k')::int as k, event_type from events)
    select event_id, case when k % 7 = 0 then null when k % 5 = 0 then null else concat('{"document_id":"', event_id, '","transparency_score":', k, ',"risk_level":"', case k % 3 when 0 then 'low' when 1 then 'high' else 'unknown' end,
           '","industry_funding_detected":', case when k % 2 = 0 then 'true' else 'false' end, ',"industry_funding_confidence":0.0,"data_availability_level":', case when k % 4 = 1 then 'null' when k % 4 = 2 then '"on_request"' else '"unknown"' end,
           ',"coi_disclosed":true,"trial_registered":false,"trial_results_compliant":false,"outcome_switching_detected":false,"risk_indicators":', case when k % 2 = 0 then concat('["', event_type, '"]') else '[]' end,
           ',"tier_downgrade_applied":0,"analyzed_at":null,"analyzer_version":"1.0"}') end as json from e
""")
def transparency_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transparency results from JSON with keys missing, null, or of no allowed value, and as JSON again."""
    k = F.get_json_object("props", "$.k").cast("int")
    risk = F.when(k % 5 == 0, "extreme").otherwise(F.element_at(F.array(*map(F.lit, ("low", "high", "unknown"))), k % 3 + 1))
    flags = F.when(k % 2 == 0, F.concat(F.lit(',"industry_funding_detected":true,"risk_indicators":["'), "event_type", F.lit('"]'))).otherwise("")
    level = F.when(k % 4 == 1, ',"data_availability_level":null').when(k % 4 == 2, ',"data_availability_level":"on_request"').otherwise("")
    known = F.when(k % 7 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"document_id":"'), "event_id", F.lit('",')))
    text = F.concat(known, F.lit('"transparency_score":'), k.cast("string"), F.lit(',"risk_level":"'), risk, F.lit('"'), flags, level, F.lit("}"))
    rows = read(spark, sf_dir, "events").select("event_id", record_json.transparency(text).alias("r"))
    return rows.select("event_id", record_json.transparency_json(F.col("r")).alias("json"))
