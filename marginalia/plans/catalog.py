"""Registered queries over the given tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.dims import DESIGN_TIER, OTHER_FACTOR, RANKED_CONFIDENCE, TYPE_DESIGN, TYPE_PRIORITY
from marginalia.operators import fulltext, ledger, merge, quality, records, transparency, usage
from marginalia.plans import sql as passthrough

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as publication records: the text's hash is the key, doc_id the order of arrival."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.md5("text").alias("key"), F.col("doc_id").alias("seq"), "source", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("journal"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("L"), F.col("doc_id"))).alias("license"))


@query("""
    with s as (select md5(text) as key, source, min(doc_id) as s, count(*) as n from documents group by all)
    select key, min(s) as first_seq, sum(n)::bigint as n_rows, arg_min(source, s) as first_seen_source, string_agg(source, ',' order by s) as sources from s group by key
""")
def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = merge.fold_by_key(paper_records(spark, sf_dir), ["key"])
    return folded.select("key", "first_seq", "n_rows", "first_seen_source", F.array_join("sources", ",").alias("sources"))


@query("""
    with r as (select md5(text) as key, doc_id as seq, case when doc_id % 3 <> 0 then lang end as journal, case when doc_id % 2 = 0 then concat('L', doc_id) end as license from documents)
    select key, arg_min(journal, seq) filter (where journal is not null) as journal, arg_min(license, seq) filter (where license is not null) as license, min(seq) as first_seq from r group by key
""")
def merge_fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = merge.fold_by_key(paper_records(spark, sf_dir), ["key"], filled=["journal", "license"])
    return folded.select("key", "journal", "license", "first_seq")


@query("""
    with s as (select md5(text) as key, source, min(doc_id) as s from documents group by all)
    select key, string_agg(source, '|' order by s) as sources, count(*) as n_sources from s group by key having count(*) > 1
""")
def merged_sources_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = merge.fold_by_key(paper_records(spark, sf_dir), ["key"])
    return folded.where(F.size("sources") > 1).select("key", F.array_join("sources", "|").alias("sources"), F.size("sources").cast("long").alias("n_sources"))


@query("select doc_id as seq, source, case when row_number() over (partition by md5(text) order by doc_id) = 1 then 'added' else 'merged' end as outcome from documents")
def row_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.outcomes(paper_records(spark, sf_dir), ["key"]).select("seq", "source", "outcome")


@query("""
    select md5(text) as key, bool_or(coalesce(quality = 1, false)) as is_open_access, count(*) as n_rows
    from documents left join labels using (doc_id) group by key
""")
def merge_open_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), (F.col("quality") == 1).alias("is_open_access"))
    folded = merge.fold_by_key(paper_records(spark, sf_dir).join(marks, "seq", "left"), ["key"], flags=["is_open_access"])
    return folded.select("key", "is_open_access", "n_rows")


#: Pages as full-text rows: the host is the publication, the address without query and fragment its source.
HOST, PATH = r"^[a-z]+://([^/?#]+)", r"^([^?#]+)"


@query("""
    with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^([^?#]+)', 1) as url from pages),
    stored as (select distinct host, url from p where page_id % 10 = 0)
    select host, url, min(page_id) as page_id from p where page_id % 10 <> 0 and not exists (select 1 from stored s where s.host = p.host and s.url = p.url) group by all
""")
def fulltext_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("host"), F.regexp_extract("url", PATH, 1).alias("url"))
    return merge.insert_ignore(p.where("page_id % 10 = 0"), p.where("page_id % 10 <> 0"), ["host", "url"], seq="page_id").select("host", "url", "page_id")


def sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger writes: the type is the source, low values are failures."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("day"), F.when(F.col("value") < 2, "failed").otherwise("completed").alias("status"), F.to_date("ts").alias("last_verified"), F.col("event_id").alias("seq"))


LEDGER_SQL = "select event_type as source, cast(ts as date) as day, case when value < 2 then 'failed' else 'completed' end as status, cast(ts as date) as last_verified, event_id as seq from events"


@query(f"select source, cast(day as varchar) as day, arg_max(status, seq) as status, count(*) as writes from ({LEDGER_SQL}) group by source, cast(day as varchar)")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sync_events(spark, sf_dir)
    kept = ledger.upsert(e.select("source", "day", "status").limit(0), e)
    return kept.join(e.groupBy("source", "day").agg(F.count(F.lit(1)).alias("writes")), ["source", "day"]).withColumn("day", F.col("day").cast("string"))


@query(f"""
    with l as (select source, day, arg_max(status, seq) as status, arg_max(last_verified, seq) as last_verified from ({LEDGER_SQL}) group by all),
    d as (select source, cast(day as date) as day from (select distinct event_type as source from events), generate_series(date '2023-12-28', date '2024-02-02', interval 1 day) as g(day))
    select d.source, cast(d.day as varchar) as day from d left join l on d.source = l.source and d.day = l.day
    where d.day = date '2024-01-30' or l.source is null or l.status = 'failed' or l.last_verified is null or l.last_verified < date '2024-01-30' - 21
""")
def days_needing_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events make the ledger; the range asked for begins before its first day and ends after its last."""
    e = sync_events(spark, sf_dir)
    kept = ledger.upsert(e.select("source", "day", "status", "last_verified").limit(0), e)
    sources = read(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct()
    return ledger.days_needing_fetch(sources, kept, "2023-12-28", "2024-02-02", "2024-01-30", recheck_days=21).withColumn("day", F.col("day").cast("string"))


@query("""
    with r as (select source, case when row_number() over (partition by md5(text) order by doc_id) = 1 then 'added' else 'merged' end as outcome, doc_id % 30 as d from documents),
    c as (select source, d, count(*) filter (where outcome = 'added') as added, count(*) filter (where outcome = 'merged') as merged from r group by all)
    select string_agg(distinct source, ',' order by source) as sources_synced, count(*) as days_processed, sum(added)::bigint as records_added, sum(merged)::bigint as records_merged, 0::bigint as records_failed from c
""")
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.outcomes(paper_records(spark, sf_dir), ["key"]).withColumn("day", F.col("seq") % 30)
    return ledger.report(ledger.day_counters(rows)).select(F.array_join("sources_synced", ",").alias("sources_synced"), "days_processed", "records_added", "records_merged", "records_failed")


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    cell = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


#: Publication types of a part: its number picks three of the known types (one of them in another spelling) or an unknown one.
N_TYPES = len(TYPE_DESIGN)
TYPE_ROWS = [(i, t, t.lower().replace("-", " "), d, TYPE_PRIORITY.index(t) if t in TYPE_PRIORITY else None) for i, (t, d) in enumerate(TYPE_DESIGN)]
CLASSIFIED_SQL = f"""
    dim as (select * from {values(TYPE_ROWS)} as v(no, name, norm, design, rank)),
    tiers as (select * from {values([*DESIGN_TIER])} as v(design, tier, default_score)),
    picks as (select p_partkey as id, unnest([0, 1, 2]) as pos, unnest([(p_partkey * 7) % {N_TYPES + 9}, (p_partkey * 5 + p_size) % {N_TYPES + 9}, (p_size * 3) % {N_TYPES + 9}]) as no from part),
    hits as (select id, pos, design, coalesce(rank, 1000) as r from picks left join dim using (no)),
    best as (select id, arg_min(design, r * 10 + pos) filter (where design is not null) as design, min(r) filter (where design is not null) as r from hits group by id),
    classified as (select id, coalesce(best.design, 'unknown') as design, tier::int as tier, default_score::double as default_score,
        case when r < 1000 then {RANKED_CONFIDENCE} when r = 1000 then round({RANKED_CONFIDENCE} * {OTHER_FACTOR}, 6) else 0.0 end::double as confidence, case when r is null then 0 else 1 end::int as assessment_tier
        from best join tiers on tiers.design = coalesce(best.design, 'unknown'))
"""


def typed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t, _ in TYPE_DESIGN])
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n: F.coalesce(F.get(names, (n % (N_TYPES + 9)).cast("int")), F.lit("Some Unknown Type"))
    types = F.array(pick(key * 7), F.concat(F.lit(" "), F.translate(F.lower(pick(key * 5 + size)), " ", "_")), F.upper(pick(size * 3)))
    return read(spark, sf_dir, "part").select(key.alias("id"), types.alias("publication_types"), size.alias("sample_size"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_types(typed_papers(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"with {CLASSIFIED_SQL} select id, design, tier, default_score, confidence, assessment_tier from classified")
def type_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir)


@query(f"""
    with {CLASSIFIED_SQL}
    select id, tier from classified join part on p_partkey = id
    where tier >= 2 and id % 3 <> 0 and (case when id % 5 = 0 then 'none' when id % 5 = 1 then null else 'double' end) <> 'none' and (p_size > 40 or p_size >= 10)
""")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = classified(spark, sf_dir).join(typed_papers(spark, sf_dir).select("id", "sample_size"), "id")
    papers = papers.withColumn("is_randomized", F.when(F.col("id") % 6 != 0, F.col("id") % 3 != 0)).withColumn("is_blinded", F.when(F.col("id") % 5 == 0, "none").when(F.col("id") % 5 != 1, "double")).withColumn("sample_size", F.when(F.col("sample_size") <= 40, F.col("sample_size")))
    return papers.where(quality.QualityFilter(min_tier=2, require_randomization=True, require_blinding=True, min_sample_size=10).predicate()).select("id", "tier")


@query(f"with {CLASSIFIED_SQL} select id, tier, case when confidence >= 0.9 and tier > 0 then 1 else 2 end::int as decided_by from classified")
def tier_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("id", "tier", quality.needed_tier(quality.QualityFilter()).alias("decided_by"))


@query("""
    with b as (select doc_id, case quality when 1 then 'LOW' when 0 then 'high' end as selection, case toxic when 1 then 'severe' else 'unclear' end as detection from labels)
    select doc_id, case when selection in ('low', 'unclear', 'high') then selection else 'unclear' end as selection, case when detection in ('low', 'unclear', 'high') then detection else 'unclear' end as detection from b
""")
def bias_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "LOW").when(F.col("quality") == 0, "high").alias("selection"), F.when(F.col("toxic") == 1, "severe").otherwise("unclear").alias("detection"))
    return raw.select("doc_id", quality.validated_bias(F.col("selection")).alias("selection"), quality.validated_bias(F.col("detection")).alias("detection"))


#: Patterns that occur in the given texts; the subject's own are in the dimension module and tested apart.
HERE_COI, HERE_DATA = ("license", "rights reserved"), (("under cc", "full_open"), ("@", "on_request"), ("the", "not_available"))
TRANSPARENCY_SQL = """
    p as (select doc_id as id, lower(coalesce(text, '')) as t, case when doc_id % 4 = 0 then ['Acme Pharma'] when doc_id % 4 = 1 then ['A University'] else [] end as funders,
                 doc_id % 2 = 0 as oa, doc_id % 5 as cited, doc_id % 6 as trials from documents),
    q as (select *, (contains(t, 'license') or contains(t, 'rights reserved')) as coi,
                 case when contains(t, 'under cc') then 'full_open' when contains(t, '@') then 'on_request' when contains(t, 'the') then 'not_available' else 'unknown' end as data_level, id % 4 = 0 as industry from p),
    s as (select *, least(100, (case when len(funders) > 0 then 15 else 0 end) + (case when coi then 10 else 0 end) + (case data_level when 'full_open' then 20 when 'on_request' then 10 else 0 end)
          + (case when oa then 15 else 0 end) + (case when cited > 0 then 5 else 0 end) + (case when trials > 2 then 20 else 0 end) + (case when trials > 4 then 15 else 0 end)) as score from q)
"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("doc_id"), read(spark, sf_dir, "documents")
    papers = d.select(
        i.alias("id"),
        F.col("text").alias("abstract"),
        F.when(i % 4 == 0, F.array(F.lit("Acme Pharma"))).when(i % 4 == 1, F.array(F.lit("A University"))).otherwise(F.array().cast("array<string>")).alias("funders"),
        (i % 2 == 0).alias("is_open_access"),
        (i % 5).alias("cited_by_count"),
        F.when(i % 6 > 2, T.trial_ids(F.concat(F.lit("see NCT12345678 and NCT0000"), F.lpad((i % 10000).cast("string"), 4, "0")))).otherwise(F.array().cast("array<string>")).alias("trial_ids"),
        F.when(i % 6 > 4, F.array(F.lit("NCT12345678"))).otherwise(F.array().cast("array<string>")).alias("results_posted"),
    )
    return transparency.analyze(papers, coi=HERE_COI, data=HERE_DATA)


@query(f"with {TRANSPARENCY_SQL} select id, coi as coi_disclosed, data_level, industry, score from s")
def transparency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("id", "coi_disclosed", "data_level", "industry", "score")


@query(f"""
    with {TRANSPARENCY_SQL}
    select id, case when score < 40 then 'high' when industry and data_level in ('restricted', 'not_available', 'not_stated') then 'high' when not coi then 'high' when score <= 70 then 'medium' when industry then 'medium' else 'low' end as risk_level from s
""")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("id", "risk_level")


@query("""
    with n as (select o_orderkey as id, concat('Trial NCT', lpad((o_orderkey % 100000)::varchar, 8, '0'), '; NCT', lpad((o_custkey % 100000)::varchar, 8, '0'), ' and NCT12') as t from orders)
    select id, list_aggregate(list_sort(list_distinct(regexp_extract_all(t, 'NCT\\d{8}'))), 'string_agg', ',') as trials from n
""")
def nct_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = lambda c: F.lpad((F.col(c) % 100000).cast("string"), 8, "0")
    t = F.concat(F.lit("Trial NCT"), eight("o_orderkey"), F.lit("; NCT"), eight("o_custkey"), F.lit(" and NCT12"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(T.trial_ids(t), ",").alias("trials"))


@query("""
    select case when grouping(role) = 1 then '*' else role end as model, sum(length(text))::bigint as chars, sum(length(text) // 4)::bigint as tokens, count(*) as calls from conversations group by grouping sets ((role), ())
""")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("role").alias("model"), F.length("text").cast("long").alias("input_tokens"), T.token_estimate(F.col("text")).alias("output_tokens"), F.lit(0.0).alias("cost"))
    return usage.by_model(c).select(F.coalesce("model", F.lit("*")).alias("model"), F.col("input_tokens").alias("chars"), F.col("output_tokens").alias("tokens"), "calls")


PRICES = [("user", 3.0, 15.0), ("assistant", 0.25, 1.25)]


@query(f"""
    with p as (select * from {values(PRICES)} as v(model, i, o)),
    c as (select role as model, length(text) // 4 as n from conversations)
    select c.model, round(sum(n / 1e6 * coalesce(i, 1.0) + n / 1e6 * coalesce(o, 3.0))::double, 6) as cost, count(*) as calls from c left join p on c.model = p.model group by c.model
""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("role").alias("model"), T.token_estimate(F.col("text")).alias("input_tokens")).withColumn("output_tokens", F.col("input_tokens"))
    priced = usage.with_cost(c, spark.createDataFrame(PRICES, "model string, input_price double, output_price double"), (1.0, 3.0))
    return priced.groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("calls"))


@query("select event_id, event_type, user_id from events order by event_id desc limit 25")
def recent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.recent(read(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), 25, "event_id")


@query(r"""
    select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') as abstract from documents
""")
def abstract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of each text, and the text rebuilt from it."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
    docs = read(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", F.coalesce(T.inverted_index_text(T.inverted_index(F.col("w"))), F.lit("")).alias("abstract"))


@query("""
    with n as (select c_custkey as id, concat(c_name, ' ;', c_mktsegment, ';; ', 'N', c_nationkey, ' ; ') as a from customer)
    select id, list_aggregate(list_filter(list_transform(string_split(a, ';'), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', '|') as authors from n
""")
def author_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("c_name", F.lit(" ;"), "c_mktsegment", F.lit(";; "), F.lit("N"), "c_nationkey", F.lit(" ; "))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(T.split_authors(raw), "|").alias("authors"))


@query("""
    select o_orderkey as id, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then strftime(o_orderdate, '%Y') when 3 then concat(strftime(o_orderdate, '%Y'), '-Spring') else strftime(o_orderdate, '%Y') end as publication_date from orders
""")
def pubdate_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    year = F.when(k < 4, F.date_format(d, "yyyy"))
    month = F.when(k == 0, F.date_format(d, "MMMM")).when(k == 1, F.date_format(d, "M")).when(k == 3, "Spring")
    day = F.when(k == 0, F.date_format(d, "d"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.publication_date(year, month, day, F.date_format(d, "yyyy MMM-MMM")).alias("publication_date"))


@query("""
    with p as (select page_id, url from pages)
    select page_id, page_id::varchar as doi, 'html' as format, url, case when page_id % 3 = 0 then 'published' when page_id % 3 = 1 then 'preprint' end as version from p where url <> ''
    union all select page_id, page_id::varchar, 'pdf', concat(url, '.pdf'), case when page_id % 3 = 0 then 'published' when page_id % 3 = 1 then 'preprint' end from p where page_id % 2 = 0
""")
def openalex_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    place = F.struct(F.struct(F.lit("x").alias("display_name")).alias("source"), F.col("url").alias("landing_page_url"), F.when(p % 2 == 0, F.concat("url", F.lit(".pdf"))).alias("pdf_url"), F.when(p % 3 == 0, "publishedVersion").when(p % 3 == 1, "submittedVersion").otherwise("").alias("version"))
    work = F.to_json(F.struct(F.concat(F.lit("https://doi.org/"), p).alias("doi"), F.array(place).alias("locations")))
    rows = records.works(read(spark, sf_dir, "pages").select("page_id", work.alias("json")))
    return rows.select("page_id", "doi", F.explode("fulltext_sources").alias("s")).select("page_id", "doi", "s.format", "s.url", "s.version")


@query("""
    with f as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, url, case page_id % 4 when 0 then 'html' when 1 then 'pdf' when 2 then 'xml' else 'epub' end as format from pages)
    select host, arg_min(url, (case format when 'xml' then 0 when 'pdf' then 1 when 'html' then 2 else 99 end) * 1000000000 + page_id) as url from f where format <> 'epub' group by host
""")
def fulltext_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("host"), "url", F.element_at(F.array(*map(F.lit, ("html", "pdf", "xml", "epub"))), (F.col("page_id") % 4 + 1).cast("int")).alias("format"))
    # the best page of each host and format first, so that no list of a host's pages is gathered
    best = p.groupBy("host", "format").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("url"))
    sources = best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "url", "format"))), lambda x: F.struct(x["url"].alias("url"), x["format"].alias("format"), F.lit("web").alias("source"))).alias("sources"))
    blank = F.lit(None).cast("string")
    found = fulltext.resolve(sources.select("host", "sources", *[blank.alias(c) for c in ("cached_html", "cached_pdf", "pmc_id", "unpaywall_url", "doi", "pmid")]))
    return found.where("resolved is not null").select("host", F.col("resolved.url").alias("url"))


@query("select page_id, regexp_replace(url, '[^A-Za-z0-9_.\\-]', '_', 'g') as cache_id from pages")
def sanitize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.sanitize_identifier(F.col("url")).alias("cache_id"))


@query("select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) as escaped_md5 from pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped_md5"))


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as normal_md5 from documents")
def ws_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("normal_md5"))


@query("select distinct o_custkey % 100 as version from orders where o_custkey % 100 not in (select c_custkey % 100 from customer where c_mktsegment = 'BUILDING' and c_nationkey < 5) order by 1")
def pending_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("version")).distinct()
    applied = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_nationkey < 5").select((F.col("c_custkey") % 100).alias("version"))
    return given.join(applied, "version", "left_anti").orderBy("version")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        read(spark, sf_dir, n).createOrReplaceTempView(n)


STAR = """
    select n_name, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    group by n_name
"""


@query(STAR)
def star_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    return passthrough.execute(spark, STAR)


RANK = "select o_custkey, o_orderkey, r from (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) x where r <= 3"


@query(RANK)
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("r", F.rank().over(top)).where("r <= 3").select("o_custkey", "o_orderkey", F.col("r").cast("long").alias("r"))


@query("select coalesce(c_mktsegment, '*') as c_mktsegment, coalesce(c_nationkey, -1)::int as c_nationkey, count(*) as n from customer group by cube (c_mktsegment, c_nationkey)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = read(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce("c_mktsegment", F.lit("*")).alias("c_mktsegment"), F.coalesce("c_nationkey", F.lit(-1)).alias("c_nationkey"), "n")


@query("""
    select o_orderkey, 'returned' as kind from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
    union all select o_orderkey, 'kept' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    back = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(back, "o_orderkey", "left_semi").withColumn("kind", F.lit("returned")).unionByName(orders.join(back, "o_orderkey", "left_anti").withColumn("kind", F.lit("kept")))


@query("""
    with b as (select c_custkey from customer where c_mktsegment = 'BUILDING'), o as (select o_custkey from orders where o_totalprice > 100000)
    select c_custkey, 'both' as kind from (select * from b intersect select * from o) union all select c_custkey, 'building only' from (select * from b except select * from o)
""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = read(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return b.intersect(o).withColumn("kind", F.lit("both")).unionByName(b.subtract(o).withColumn("kind", F.lit("building only")))


@query("""
    with c as (select c_custkey as id, split_part(c_name, '#', 2) as number, c_mktsegment as s from customer)
    select id, case when id % 3 = 0 then 'doi' when id % 3 = 1 then 'pmc' when length(number) >= 7 then 'pmid' end as kind, concat('PMC', id) as pmc,
           concat('vol', '(', id % 12, ')', ':', id, '-', id + 9) as pages, concat('https://europepmc.org/articles/PMC', id, '/bin/f', case when id % 2 = 0 then '.PNG' else '.jpg' end) as figure from c
""")
def identifier_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    number = F.split_part("c_name", F.lit("#"), F.lit(2))
    article = F.when(i % 3 == 0, F.concat(F.lit("10."), i)).when(i % 3 == 1, F.concat(F.lit("PMC"), i)).otherwise(number)
    s = i.cast("string")
    return read(spark, sf_dir, "customer").select(
        i.alias("id"),
        T.article_id_kind(article).alias("kind"),
        T.with_pmc_prefix(F.when(i % 2 == 0, F.concat(F.lit("PMC"), s)).otherwise(s)).alias("pmc"),
        T.volume_part(F.lit("vol"), (i % 12).cast("string"), s, (i + 9).cast("string")).alias("pages"),
        T.figure_url(F.when(i % 2 == 0, "f.PNG").otherwise("f"), s).alias("figure"),
    )


from marginalia.plans import answers  # noqa: E402, F401  (registers its queries here)
