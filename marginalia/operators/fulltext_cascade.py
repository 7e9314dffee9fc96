"""Full text by tiers that fall through: each tier is a stage over the papers that no tier before it has resolved.

A transport (address -> bytes, an exception where there is nothing) is shipped by value and runs where the tasks run.
What a stage fetched is written before anything is made of it, so that nothing is fetched twice; all attempts are united
at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.dims import FORMAT_RANK
from marginalia.operators import fulltext, jats
from marginalia.operators.shared import cut

Transport = Callable[[str], bytes]
#: Addresses of the services (fixed values).
EUROPE_PMC, UNPAYWALL = "https://www.ebi.ac.uk/europepmc/webservices/rest", "https://api.unpaywall.org/v2"
#: Bytes of bodies that a task hands on at once.
RUN_BYTES = 1 << 24
HIT = "resultList struct<result:array<struct<inEPMC:string,pmcid:string>>>"
PLACE = "struct<url_for_pdf:string,url:string>"
ANSWER = f"best_oa_location {PLACE}, oa_locations array<{PLACE}>"


def fetched(asked: DataFrame, get: Transport) -> DataFrame:
    """``asked`` (row, source, format, url) with ``body``, or ``error`` where the transport raised; web pages are not fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, formats, start, size = batch.column("url").to_pylist(), batch.column("format").to_pylist(), 0, 0
            bodies, errors = [], []
            for i, (url, kind) in enumerate(zip(urls, formats, strict=True)):
                body = error = None
                if kind != "html":
                    try:
                        body = get(url)
                    except Exception as e:  # a source that fails is what the next tier is for
                        error = f"{type(e).__name__}: {e}"
                bodies.append(body)
                errors.append(error)
                size += len(body or b"")
                if size >= RUN_BYTES or i + 1 == len(urls):
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bodies, pa.binary()), pa.array(errors, pa.string())], [*part.schema.names, "body", "error"])
                    start, size, bodies, errors = i + 1, 0, [], []

    return cut(asked.select("row", "source", "format", "url").mapInArrow(run, "row long, source string, format string, url string, body binary, error string"))


class Cascade:
    """Papers on their way through the tiers."""

    def __init__(self, papers: DataFrame, get: Transport):
        self.get, self.papers = get, cut(papers.withColumn("row", F.monotonically_increasing_id()))
        self.open, self.found, self.tried = self.papers, [], []

    def _settle(self, done: DataFrame) -> None:
        self.found.append(done)
        self.open = cut(self.open.join(done.select("row"), "row", "left_anti"))

    def take(self, source: str, kind: str, value: Column) -> None:
        """Resolves, without an attempt, the papers for which ``value`` is not null."""
        self._settle(cut(self.open.where(value.isNotNull()).select("row", F.lit(source).alias("source"), *result(**{kind: value}))))

    def attempt(self, tier: str, asked: Column) -> None:
        """One try for each open paper for which ``asked`` (source, format, url) is not null.

        XML must parse.  A PDF's address is a result even where what comes from it is no PDF; a web page's is one as it is.
        """
        rows = self.open.select("row", asked.alias("a")).where(F.col("a.url").isNotNull()).select("row", "a.source", "a.format", "a.url")
        got = fetched(rows, self.get)
        parsed = jats.articles(got.where("format = 'xml' and error is null").select(F.col("row").alias("id"), F.decode("body", "UTF-8").alias("xml"))).select(F.col("id").alias("row"), F.col("html").alias("made"), F.col("error").alias("bad"))
        is_xml, is_pdf = F.col("format") == "xml", F.col("format") == "pdf"
        done = cut(got.join(parsed, "row", "left").withColumn("ok", F.when(is_xml, F.col("made").isNotNull()).otherwise(True)))
        self.tried.append(done.select("row", F.lit(tier).alias("tier"), "source", "url", "ok", F.coalesce("error", "bad").alias("error")))
        pdf = F.when(is_pdf & fulltext.is_pdf(F.col("body")), F.col("body"))
        self._settle(cut(done.where("ok").select("row", "source", *result(html=F.when(is_xml, F.col("made")), pdf=pdf, pdf_url=F.when(is_pdf, F.col("url")), web_url=F.when(~is_xml & ~is_pdf, F.col("url"))))))

    def look_up(self, tier: str, url: Column, schema: str, answer: Callable[[Column], Column], name: str) -> None:
        """Asks a service about open papers; what ``answer`` makes of its JSON becomes the column ``name`` (null: nothing known)."""
        asked = self.open.select("row", F.lit(tier).alias("source"), F.lit("json").alias("format"), url.alias("url")).where("url is not null")
        got = fetched(asked, self.get).withColumn("found", answer(F.from_json(F.decode("body", "UTF-8"), schema)))
        got = cut(got.select("row", "source", "url", "error", "found"))
        self.tried.append(got.select("row", F.lit(tier).alias("tier"), "source", "url", F.col("found").isNotNull().alias("ok"), "error"))
        self.open = cut(self.open.drop(name).join(got.select("row", F.col("found").alias(name)), "row", "left"))


def result(html: Column | None = None, pdf: Column | None = None, pdf_url: Column | None = None, web_url: Column | None = None) -> list[Column]:
    none = F.lit(None)
    given = (("html", "string", html), ("pdf", "binary", pdf), ("pdf_url", "string", pdf_url), ("web_url", "string", web_url))
    return [(none.cast(kind) if c is None else c).alias(n) for n, kind, c in given]


def fetch_fulltext(papers: DataFrame, get: Transport, email: str = "") -> tuple[DataFrame, DataFrame]:
    """(found, attempts) for ``papers``: identifier, doi, pmid, pmc_id, sources, cached_html, cached_pdf; null where there is none.

    ``sources`` are (url, format, source) structs.  Tiers: the cache; the known sources, XML before PDF before web page,
    one after the other; the article in Europe PMC by its id, or else by an id found there; an open PDF by Unpaywall; the
    DOI's page; PubMed's.  found: (identifier, source, html, pdf, pdf_url, web_url), a row for each paper, with all null
    but the identifier if nothing is left.  attempts: (identifier, n, tier, source, url, ok, error) in order of ``n``; a
    paper is asked for in no tier after its success.  Repeated papers are separate rows.
    """
    known = F.filter(fulltext.by_priority(F.coalesce("sources", F.array())), lambda s: s["format"].isin(*[f for f, _ in FORMAT_RANK]) & s["url"].isNotNull())
    run = Cascade(papers.withColumn("_known", known), get)
    run.take("cached", "html", T.blank_to_null(F.col("cached_html")))
    run.take("cached", "pdf", F.col("cached_pdf"))
    ask = lambda source, kind, url: F.when(url.isNotNull(), F.struct(source.alias("source"), F.lit(kind).alias("format") if isinstance(kind, str) else kind.alias("format"), url.alias("url")))
    for n in range(run.open.agg(F.max(F.size("_known"))).first()[0] or 0):  # as many rounds as a paper has sources
        s = F.get(F.col("_known"), n)
        run.attempt("known", ask(s["source"], s["format"], s["url"]))

    doi, pmid, pmc = (T.blank_to_null(F.col(c)) for c in ("doi", "pmid", "pmc_id"))
    article = lambda c: F.concat(F.lit(f"{EUROPE_PMC}/"), T.with_pmc_prefix(c), F.lit("/fullTextXML"))
    run.attempt("europepmc", ask(F.lit("europepmc"), "xml", article(pmc)))
    query = F.coalesce(F.concat(F.lit("DOI:"), doi), F.concat(F.lit("EXT_ID:"), pmid))
    search = F.concat(F.lit(f"{EUROPE_PMC}/search?query="), T.quote_url(query, ":"), F.lit("&format=json&resultType=core&pageSize=1"))
    hit = lambda a: F.get(a["resultList"]["result"], 0)
    run.look_up("europepmc search", F.when(pmc.isNull(), search), HIT, lambda a: F.when(hit(a)["inEPMC"] == "Y", T.blank_to_null(hit(a)["pmcid"])), "_pmc")
    run.attempt("europepmc", ask(F.lit("europepmc"), "xml", article(F.col("_pmc"))))
    run.look_up("unpaywall search", F.concat(F.lit(f"{UNPAYWALL}/"), T.quote_url(doi), F.lit(f"?email={email}")), ANSWER, fulltext.best_location, "_pdf")
    run.attempt("unpaywall", ask(F.lit("unpaywall"), "pdf", F.col("_pdf")))
    run.take("doi", "web_url", F.concat(F.lit("https://doi.org/"), doi))
    run.take("pubmed", "web_url", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")))

    found = run.found[0]
    for part in run.found[1:]:
        found = found.unionByName(part)
    tried = None
    for n, part in enumerate(run.tried):
        part = part.withColumn("n", F.lit(n))
        tried = part if tried is None else tried.unionByName(part)
    names = run.papers.select("row", "identifier")
    return names.join(found, "row", "left").drop("row"), names.join(tried, "row").select("identifier", "n", "tier", "source", "url", "ok", "error")
