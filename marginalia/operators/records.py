"""Normalising source records to one schema, as projections."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.dims import VERSIONS
from marginalia.functions.text import blank_to_null, inverted_index_text, publication_date, split_authors

ENTRY = "struct<url:string,format:string,source:string,open_access:boolean,version:string>"
WORK = """doi string, ids struct<pmid:string>, title string, abstract_inverted_index map<string,array<int>>,
    authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>,
    locations array<struct<source:struct<display_name:string>,landing_page_url:string,pdf_url:string,version:string,is_oa:boolean>>,
    primary_topic struct<display_name:string>, open_access struct<is_oa:boolean>, license string, type string, publication_date string"""
PREPRINT = "doi string, title string, authors string, date string, category string, abstract string, jatsxml string, published string, server string"


def entry(url: Column, kind: str, source: Column, open_access: Column, version: Column) -> Column:
    return F.when(blank_to_null(url).isNotNull(), F.struct(url.alias("url"), F.lit(kind).alias("format"), source.alias("source"), open_access.alias("open_access"), version.alias("version")))


def location_entries(locations: Column) -> Column:
    """A web and a PDF entry of each location that has them, in order."""
    def version(raw: Column) -> Column:
        named = raw
        for theirs, ours in VERSIONS:
            named = F.when(raw == theirs, ours).otherwise(named)
        return blank_to_null(named)

    def both(x: Column) -> Column:
        source = F.coalesce(blank_to_null(x["source"]["display_name"]), F.lit("unknown"))
        oa, v = F.coalesce(x["is_oa"], F.lit(False)), version(x["version"])
        return F.array_compact(F.array(entry(x["landing_page_url"], "html", source, oa, v), entry(x["pdf_url"], "pdf", source, oa, v)))

    return F.coalesce(F.flatten(F.transform(locations, both)), F.array().cast(f"array<{ENTRY}>"))


def works(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Scholarly-graph works (JSON text) as records; other columns stay."""
    w = F.col("_w")
    names = F.filter(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), lambda n: blank_to_null(n).isNotNull())
    one = lambda c: F.when(blank_to_null(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return (
        raw.withColumn("_w", F.from_json(json_col, WORK))
        .withColumn("title", F.coalesce(w["title"], F.lit("")))
        .withColumn("doi", blank_to_null(F.regexp_replace(w["doi"], "^https://doi\\.org/", "")))
        .withColumn("pmid", blank_to_null(F.regexp_replace(w["ids"]["pmid"], "^https://pubmed\\.ncbi\\.nlm\\.nih\\.gov/", "")))
        .withColumn("abstract", inverted_index_text(w["abstract_inverted_index"]))
        .withColumn("authors", F.coalesce(names, F.array().cast("array<string>")))
        .withColumn("journal", w["primary_location"]["source"]["display_name"])
        .withColumn("keywords", one(w["primary_topic"]["display_name"]))
        .withColumn("publication_types", one(w["type"]))
        .withColumn("publication_date", w["publication_date"])
        .withColumn("is_open_access", F.coalesce(w["open_access"]["is_oa"], F.lit(False)))
        .withColumn("license", w["license"])
        .withColumn("fulltext_sources", location_entries(w["locations"]))
        .drop("_w")
    )


def preprints(raw: DataFrame, server: str, json_col: str = "json", blank_is_null: bool = True) -> DataFrame:
    """Preprint-server records (JSON text) as records; a blank abstract or date becomes null unless told otherwise."""
    p, keep = F.col("_p"), (blank_to_null if blank_is_null else lambda c: F.coalesce(c, F.lit("")))
    doi = blank_to_null(p["doi"])
    pdf = entry(F.concat(F.lit(f"https://www.{server}.org/content/"), doi, F.lit("v1.full.pdf")), "pdf", F.lit(server), F.lit(True), F.lit(None).cast("string"))
    return (
        raw.withColumn("_p", F.from_json(json_col, PREPRINT))
        .withColumn("title", F.coalesce(p["title"], F.lit("")))
        .withColumn("doi", doi)
        .withColumn("abstract", keep(p["abstract"]))
        .withColumn("authors", F.coalesce(split_authors(p["authors"]), F.array().cast("array<string>")))
        .withColumn("publication_date", keep(p["date"]))
        .withColumn("extras", F.create_map(F.lit("category"), F.coalesce(p["category"], F.lit("")), F.lit("published"), F.coalesce(p["published"], F.lit("")), F.lit("server"), F.coalesce(p["server"], F.lit(server))))
        .withColumn("is_open_access", F.lit(True))
        .withColumn("fulltext_sources", F.array_compact(F.array(pdf, entry(p["jatsxml"], "xml", F.lit(server), F.lit(True), F.lit(None).cast("string")))))
        .drop("_p")
    )


CITATION = "id long, pmid string, title string, abstract string, authors array<string>, journal string, year string, month string, day string, medline string, doi string, pmc_id string, keywords array<string>"


def citations(raw: DataFrame, id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """Citation XML as records.  Mixed content needs a parser; dates and sources are expressions again.

    A malformed document gives a row with nulls.
    """
    def fields(i: int, text: str | None) -> tuple:
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return (i, None, None, None, [], None, None, None, None, None, None, None, [])
        at = lambda path: root.findtext(path) or None
        parts = [(p.get("Label"), "".join(p.itertext()).strip()) for p in root.findall("MedlineCitation/Article/Abstract/AbstractText")]
        people = [(a.findtext("LastName"), a.findtext("ForeName")) for a in root.findall("MedlineCitation/Article/AuthorList/Author")]
        ids = {a.get("IdType"): a.text for a in root.findall("PubmedData/ArticleIdList/ArticleId")}
        date = "MedlineCitation/Article/Journal/JournalIssue/PubDate/"
        return (
            i, at("MedlineCitation/PMID"), at("MedlineCitation/Article/ArticleTitle"),
            "\n".join(f"{label}: {t}" if label else t for label, t in parts if t) or None,
            [", ".join(filter(None, (last, fore))) for last, fore in people if last],
            at("MedlineCitation/Article/Journal/Title"), *(at(date + n) for n in ("Year", "Month", "Day", "MedlineDate")),
            ids.get("doi"), ids.get("pmc"), [k.text for k in root.findall("MedlineCitation/MeshHeadingList/MeshHeading/DescriptorName") if k.text],
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([fields(i, t) for i, t in zip(f["id"], f["xml"], strict=True)], columns=[c.split()[0] for c in CITATION.split(", ")])

    parsed = raw.select(F.col(id_col).cast("long").alias("id"), F.col(xml_col).alias("xml")).mapInPandas(run, CITATION)
    none = F.lit(None).cast("string")
    pmc = entry(F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), "pmc_id", F.lit("/")), "html", F.lit("pmc"), F.lit(True), none)
    publisher = entry(F.concat(F.lit("https://doi.org/"), "doi"), "html", F.lit("publisher"), F.lit(False), none)
    dated = parsed.withColumn("publication_date", publication_date(F.col("year"), F.col("month"), F.col("day"), F.col("medline"))).drop("year", "month", "day", "medline")
    return dated.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("fulltext_sources", F.array_compact(F.array(pmc, publisher)))


def to_publications(records: DataFrame, source: str) -> DataFrame:
    return records.withColumn("sources", F.array(F.lit(source))).withColumn("first_seen_source", F.lit(source))


def fulltext_rows(records: DataFrame, id_col: str = "id") -> DataFrame:
    one = records.select(F.col(id_col).alias("publication_id"), F.explode("fulltext_sources").alias("s"))
    return one.select("publication_id", F.coalesce("s.source", F.lit("unknown")).alias("source"), "s.url", F.coalesce("s.format", F.lit("html")).alias("format"), "s.version")


def citation_files(spark: SparkSession, path: str, tag: str = "PubmedArticle") -> DataFrame:
    """(id, xml) of every ``tag`` element in large XML files, which are split at the elements' ends.

    A file of thirty thousand articles is as many tasks as its size asks for: what a task reads ends with the element's
    closing tag (``lineSep`` of the text source, which also finds its place in the middle of a file), and what stands
    before the opening tag, a file's head, is left out; so is a file's end.  ``id`` is a hash of the element's text.
    Compressed files are read by one task each, as their formats ask.
    """
    parts = spark.read.option("lineSep", f"</{tag}>").text(path)
    found = F.regexp_extract("value", rf"(?s).*?(<{tag}[\s>].*)", 1)
    return parts.select(found.alias("_x")).where("_x <> ''").select(F.xxhash64("_x").alias("id"), F.concat("_x", F.lit(f"</{tag}>")).alias("xml"))
