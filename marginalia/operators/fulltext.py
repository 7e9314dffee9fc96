"""Full-text sources: ranking and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dims import FORMAT_RANK
from marginalia.functions.text import blank_to_null


def format_rank(c: Column) -> Column:
    rank = F.lit(99)
    for name, n in reversed(FORMAT_RANK):
        rank = F.when(c == name, n).otherwise(rank)
    return rank


def by_priority(sources: Column) -> Column:
    """An array of sources ordered by format, stably."""
    tagged = F.transform(sources, lambda s, i: F.struct(format_rank(s["format"]).alias("r"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(tagged), lambda t: t["s"])


def best_location(answer: Column) -> Column:
    """The PDF address, else the address, of the best location; else of the first location with either."""
    either = lambda loc: F.coalesce(blank_to_null(loc["url_for_pdf"]), blank_to_null(loc["url"]))
    return F.coalesce(either(answer["best_oa_location"]), F.try_element_at(F.array_compact(F.transform(answer["oa_locations"], either)), F.lit(1)))


def resolve(papers: DataFrame) -> DataFrame:
    """Adds ``resolved`` (source, url): the first of cache, known sources by format, article page, DOI, PubMed.

    ``papers``: cached_html, cached_pdf, sources, pmc_id, unpaywall_url, doi, pmid; null where there is none.  Formats
    other than xml, pdf and html are passed over.  Null if nothing is left.
    """
    pick = lambda source, url: F.when(blank_to_null(url).isNotNull(), F.struct(F.lit(source).alias("source"), url.alias("url")))
    known = F.try_element_at(F.filter(by_priority(F.col("sources")), lambda s: s["format"].isin(*[f for f, _ in FORMAT_RANK])), F.lit(1))
    found = F.coalesce(
        pick("cached", F.col("cached_html")),
        pick("cached", F.col("cached_pdf")),
        F.when(known.isNotNull(), F.struct(known["source"].alias("source"), known["url"].alias("url"))),
        pick("europepmc", F.concat(F.lit("https://europepmc.org/article/PMC/"), F.regexp_replace("pmc_id", "^PMC", ""))),
        pick("unpaywall", F.col("unpaywall_url")),
        pick("doi", F.concat(F.lit("https://doi.org/"), blank_to_null(F.col("doi")))),
        pick("pubmed", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), blank_to_null(F.col("pmid")), F.lit("/"))),
    )
    return papers.withColumn("resolved", found)


def cache_rows(papers: DataFrame, seq: str = "seq") -> DataFrame:
    """(identifier, kind, html, pdf, seq) to write to the cache, of (identifier, html, pdf, seq): what is no PDF is left out."""
    none = F.lit(None)
    html = papers.where("html is not null").select("identifier", F.lit("html").alias("kind"), "html", none.cast("binary").alias("pdf"), seq)
    return html.unionByName(papers.where(is_pdf(F.col("pdf"))).select("identifier", F.lit("pdf").alias("kind"), none.cast("string").alias("html"), "pdf", seq))


def cache_after(cache: DataFrame, written: DataFrame, seq: str = "seq") -> DataFrame:
    """The cache after rows were written to it: the last of each (identifier, kind) stays; ``seq`` orders both sides."""
    columns = [c for c in cache.columns if c not in ("identifier", "kind")]
    last = cache.unionByName(written).groupBy("identifier", "kind").agg(F.max_by(F.struct(*columns), seq).alias("_r"))
    return last.select("identifier", "kind", *[F.col("_r")[c].alias(c) for c in columns])


def cache_without(cache: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """The cache without some identifiers (HTML and PDF), or cleared."""
    return cache.limit(0) if identifiers is None else cache.join(identifiers.select("identifier").distinct(), "identifier", "left_anti")


def is_pdf(data: Column) -> Column:
    return F.substring(data, 1, 4) == F.unhex(F.lit("25504446"))
