import json
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from marginalia.operators.fulltext_cascade import fetch_fulltext

PAPER = "identifier string, doi string, pmid string, pmc_id string, sources array<struct<url:string,format:string,source:string>>, cached_html string, cached_pdf binary"
XML = b"<article><front><article-meta><title-group><article-title>Title</article-title></title-group></article-meta></front><body><sec><title>One</title><p>Words.</p></sec></body></article>"


def get(url):
    """A transport without a network: what each address gives."""
    if "refused" in url:
        raise ConnectionError(url)
    if url.endswith(".pdf"):
        return b"%PDF-1.7 x" if "good" in url else b"<html>login</html>"
    if "broken" in url:
        return b"<article"
    if url.endswith("/fullTextXML"):
        if "PMC404" in url:
            raise LookupError("HTTP 404")
        return XML
    if "/search?" in url:
        hit = {"10.1%2Fin": {"inEPMC": "Y", "pmcid": "PMC7"}, "10.1%2Fgone": {"inEPMC": "Y", "pmcid": "PMC404"}, "EXT_ID:55": {"inEPMC": "Y", "pmcid": "PMC8"}, "10.1%2Fout": {"inEPMC": "N", "pmcid": "PMC9"}}
        return json.dumps({"resultList": {"result": [h for k, h in hit.items() if k in url]}}).encode()
    if "unpaywall" in url:
        if "10.1%2Fgone" in url:
            return b'{"best_oa_location": null, "oa_locations": [{"url": "https://x/good.pdf"}]}'
        return b'{"best_oa_location": null, "oa_locations": null}'
    return XML


@pytest.fixture(scope="module")
def results(spark):
    s = lambda url, kind, source="s": (url, kind, source)
    papers = [
        ("cached", "10.1/c", None, None, [s("https://x/a.xml", "xml")], "<p>kept</p>", None),
        ("cached pdf", "10.1/c", None, None, None, "", b"%PDF"),
        ("xml first", None, None, None, [s("https://x/w", "html"), s("https://x/good.pdf", "pdf"), s("https://x/a.xml", "xml", "best")], None, None),
        ("xml fails", None, None, None, [s("https://refused/a.xml", "xml"), s("https://broken/b.xml", "xml"), s("https://x/good.pdf", "pdf", "p"), s("https://x/w", "html")], None, None),
        ("no pdf", None, None, None, [s("https://x/bad.pdf", "pdf")], None, None),
        ("refused pdf", None, None, None, [s("https://refused/x.pdf", "pdf")], None, None),
        ("web", None, None, None, [s("https://x/w", "html"), s("https://x/z", "epub")], None, None),
        ("pmc", "10.1/c", None, "7", None, None, None),
        ("pmc gone", "10.1/nothing", None, "PMC404", None, None, None),
        ("found by doi", "10.1/in", "1", None, [], None, None),
        ("found by pmid", None, "55", None, [], None, None),
        ("unpaywall", "10.1/gone", None, None, [s("https://refused/a.xml", "xml")], None, None),
        ("doi page", "10.1/out", "3", None, None, None, None),
        ("pubmed page", "", "9", None, None, None, None),
        ("nothing", None, "", "", None, None, None),
    ]
    found, tried = fetch_fulltext(spark.createDataFrame(papers, PAPER), get, "me@x.org")
    attempts = defaultdict(list)
    for r in tried.orderBy("identifier", "n").collect():
        attempts[r["identifier"]].append(r)
    return {r["identifier"]: r for r in found.collect()}, attempts


def test_results(results):
    found, _ = results
    says = {k: (r["source"], bool(r["html"]), None if r["pdf"] is None else bytes(r["pdf"])[:4], r["pdf_url"], r["web_url"]) for k, r in found.items()}
    assert says == {
        "cached": ("cached", True, None, None, None),
        "cached pdf": ("cached", False, b"%PDF", None, None),
        "xml first": ("best", True, None, None, None),
        "xml fails": ("p", False, b"%PDF", "https://x/good.pdf", None),
        "no pdf": ("s", False, None, "https://x/bad.pdf", None),
        "refused pdf": ("s", False, None, "https://refused/x.pdf", None),
        "web": ("s", False, None, None, "https://x/w"),
        "pmc": ("europepmc", True, None, None, None),
        "pmc gone": ("doi", False, None, None, "https://doi.org/10.1/nothing"),
        "found by doi": ("europepmc", True, None, None, None),
        "found by pmid": ("europepmc", True, None, None, None),
        "unpaywall": ("unpaywall", False, b"%PDF", "https://x/good.pdf", None),
        "doi page": ("doi", False, None, None, "https://doi.org/10.1/out"),
        "pubmed page": ("pubmed", False, None, None, "https://pubmed.ncbi.nlm.nih.gov/9/"),
        "nothing": (None, False, None, None, None),
    }
    assert "<h1>Title</h1>" in found["pmc"]["html"] and "Words." in found["xml first"]["html"]


def test_attempts(results):
    _, attempts = results
    tiers = {k: [(r["tier"], r["ok"]) for r in v] for k, v in attempts.items()}
    assert "cached" not in tiers and "cached pdf" not in tiers and "nothing" not in tiers
    assert tiers["xml fails"] == [("known", False), ("known", False), ("known", True)]
    assert tiers["xml first"] == [("known", True)]
    assert tiers["pmc gone"] == [("europepmc", False), ("unpaywall search", False)]  # with an id, nothing is searched for
    assert tiers["unpaywall"] == [("known", False), ("europepmc search", True), ("europepmc", False), ("unpaywall search", True), ("unpaywall", True)]
    assert "ConnectionError" in attempts["xml fails"][0]["error"] and attempts["xml fails"][1]["error"]
    for rows in attempts.values():  # an attempt that gave the full text is the last
        assert not any(r["ok"] and not r["tier"].endswith("search") for r in rows[:-1])


def test_no_papers(spark):
    found, tried = fetch_fulltext(spark.createDataFrame([], PAPER), get)
    assert found.count() == 0 and tried.count() == 0


def test_repeated_papers_are_rows_of_their_own(spark):
    rows = [("x", None, None, None, [("https://x/w", "html", "s")], None, None)] * 2
    found, tried = fetch_fulltext(spark.createDataFrame(rows, PAPER), get)
    assert found.count() == tried.count() == 2 and found.where(F.col("web_url") == "https://x/w").count() == 2
