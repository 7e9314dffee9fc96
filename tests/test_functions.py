import json
from html import escape
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.dims import TYPE_DESIGN
from marginalia.operators import fulltext, quality, records, transparency, usage


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text(spark):
    odd = ["a  b\n", "  ", "", "x<y>&\"'", "1*~ é/:"]
    assert column(spark, odd, T.normalize_space) == [" ".join(v.split()) for v in odd]
    assert column(spark, odd, T.html_escape) == [escape(v) for v in odd]
    assert column(spark, odd, T.quote_url) == [quote(v, safe="") for v in odd]
    assert column(spark, odd, lambda c: T.quote_url(c, ":")) == [quote(v, safe=":") for v in odd]
    assert column(spark, ["pii:S0140(23)x/7.b-c", "é/ß x"], T.sanitize_identifier) == ["pii_S0140_23_x_7.b-c", "é_ß_x"]
    assert column(spark, ["see [Fig <1>](#f1) & more"], T.inline_links) == ['see <a href="#f1">Fig &lt;1&gt;</a> &amp; more']
    assert column(spark, ["A; B;; C ", "", None], T.split_authors) == [["A", "B", "C"], [], None]
    assert column(spark, ["NCT123456789 NCT00000001 NCT12345678"], T.trial_ids) == [["NCT00000001", "NCT12345678"]]
    assert column(spark, ["10.1/x", "PMC1", "1234567", "123456", "x"], T.article_id_kind) == ["doi", "pmc", "pmid", None, None]
    assert column(spark, ["abcdefg", "é" * 9, None], T.token_estimate) == [1, 2, None]
    assert column(spark, [1.5, -1.0, None], lambda c: T.clamp(c, 0.0, 1.0), "double") == [1.0, 0.0, None]
    assert column(spark, [["a"] * 2, ["a", "b", "c", "d"]], lambda c: T.name_list(c, 3, 2), "array<string>") == ["a, a", "a, b, et al."]


def test_publication_date(spark):
    rows = [("1987", "September", "9", None), ("1987", None, "4", None), ("2011", "07", "8", None), (None, "May", "2", "1999 Winter"), ("2003", "Autumn", "30", None), (None, None, None, None), ("2020", "11", None, "x"), (None, None, None, "87"), ("1990", " FEB ", "28", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, y string, m string, d string, l string")
    got = [r["o"] for r in frame.select("i", T.publication_date(*map(F.col, "ymdl")).alias("o")).orderBy("i").collect()]
    assert got == ["1987-09-09", "1987", "2011-07-08", "1999", "2003-Autumn-30", None, "2020-11", None, "1990-02-28"]


def test_inverted_index(spark):
    cases = [None, {}, {"x": []}, {"Kidney": [3], "of": [2, 5], "a": [1], "trial": [0]}, {"b": [0], "a": [0]}]
    assert column(spark, cases, T.inverted_index_text, "map<string,array<int>>") == [None, None, None, "trial a of Kidney of", "a b"]
    words = ["we saw what we saw", "", "once", "b a b a b"]
    index = lambda c: T.inverted_index(F.array_remove(F.split(c, " "), ""))
    want = [{w: [i for i, x in enumerate(t.split()) if x == w] for w in t.split()} or None for t in words]
    assert column(spark, words, index) == want
    assert column(spark, words, lambda c: T.inverted_index_text(index(c))) == [t or None for t in words]


def test_json_in_answers(spark):
    good = ['{"a": 1}', '```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', 'so {"a": 1} it is', '{"a": "}{", "b": {"c": 2}}']
    bad = ["no json", '{"a":1} and {"b":2}', "", None, '{"a": 1} x }', '{"a":1}], [{"b":2}', '{"a":1}},{"x":{"b":2}', '{"a":1},{"b":2}', '{"a":1},"z":{"b":2}', "{} {}", "{"]
    got = column(spark, good + bad, T.json_object)
    assert [json.loads(x) for x in got[:5]] == [{"a": 1}] * 4 + [{"a": "}{", "b": {"c": 2}}]
    assert got[5:] == [None] * len(bad)
    assert column(spark, ["```\n[1, 2]\n```", 'x {"a": [1]} y', "{1} {2}", "none", None], T.extract_json) == ["[1, 2]", '{"a": [1]}', "{1} {2}", "none", None]


def classify(spark, *types):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(types)], "id int, publication_types array<string>")
    return {r["id"]: r for r in quality.classify_types(frame).collect()}


def test_classification(spark):
    got = classify(spark, ["Letter", "Case Reports"], ["Multicenter Study", "Comment"], None, ["Poem", "Portrait"], ["Review", "Multicenter Study"], ["  case_REPORTS"], ["Multicenter Study"], [])
    kinds = dict(TYPE_DESIGN)
    assert [got[i]["design"] for i in (0, 1, 2, 3, 5, 6, 7)] == [kinds["Case Reports"], kinds["Comment"], "unknown", "unknown", kinds["Case Reports"], kinds["Multicenter Study"], "unknown"]
    assert got[4]["design"] == kinds["Review"]  # of types without a rank the first
    assert (got[0]["tier"], got[0]["confidence"], got[6]["tier"]) == (1, 0.9, 4)
    assert got[6]["confidence"] == got[4]["confidence"] == pytest.approx(0.72)
    assert (got[4]["tier"], got[4]["assessment_tier"], got[7]["assessment_tier"]) == (0, 1, 0)
    every = classify(spark, *[[t] for t, _ in TYPE_DESIGN])
    assert [every[i]["design"] for i in range(len(TYPE_DESIGN))] == [d for _, d in TYPE_DESIGN]
    assert sum(every[i]["confidence"] < 0.8 for i in range(len(TYPE_DESIGN))) == 9


def test_decode_classification(spark):
    answers = ['{"study_design": "RCT", "confidence": 1.7, "sample_size": 12.7}', '{"study_design": "nonsense"}', '{"study_design": "letter", "confidence": null}', "junk", '{"study_design":"letter","sample_size":"9"}']
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")
    got = [(r["study_design"], r["confidence"], r["sample_size"]) for r in quality.decode_classification(frame).orderBy("i").collect()]
    assert got == [("rct", 1.0, 12), ("unknown", 0.5, None), ("unknown", 0.0, None), ("unknown", 0.0, None), ("letter", 0.5, 9)]


def test_decode_assessment(spark):
    whole = {"study_design": "Cohort_Prospective ", "quality_score": 14, "confidence": -1, "evidence_level": "2a", "sample_size": "31", "strengths": ["s"], "design_characteristics": {"randomized": False, "blinded": "single", "multicenter": True}, "bias_risk": {"selection": "low", "reporting": "Low", "attrition": 3}}
    answers = [json.dumps(whole), "{}", '{"bias_risk": null}', '{"quality_score": "high"}', '{"study_design": 4}', "[1]", None]
    got = {r["i"]: r for r in quality.decode_assessment(spark.createDataFrame(list(enumerate(answers)), "i int, answer string")).collect()}
    a = got[0]
    assert (a["study_design"], a["quality_score"], a["confidence"], a["evidence_level"], a["sample_size"], a["strengths"], a["limitations"]) == ("cohort_prospective", 10.0, 0.0, "2a", 31, ["s"], [])
    assert (a["is_randomized"], a["is_controlled"], a["is_multicenter"], a["is_blinded"], tuple(a["bias_risk"])) == (False, None, True, "single", ("low", "unclear", "unclear", "unclear", "unclear"))
    assert [got[i]["is_valid"] for i in range(7)] == [True, True, False, False, False, False, False]
    assert (got[1]["study_design"], got[1]["quality_score"], got[1]["confidence"]) == ("unknown", 0.0, 0.5)
    assert (got[5]["confidence"], got[5]["bias_risk"], got[5]["strengths"]) == (0.0, None, [])


def test_risk_levels(spark):
    def plain(score, industry, data, coi):
        if score < 40 or (industry and data in ("restricted", "not_available", "not_stated")) or not coi:
            return "high"
        return "medium" if score <= 70 or industry else "low"

    levels = ("full_open", "on_request", "restricted", "not_available", "not_stated", "unknown")
    cases = [(s, i, d, c, plain(s, i, d, c)) for s in (0, 39, 40, 41, 70, 71, 100) for i in (False, True) for d in levels for c in (False, True)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s int, ind boolean, d string, c boolean, want string")
    rows = frame.withColumn("got", transparency.risk_level(F.col("s"), F.col("ind"), F.col("d"), F.col("c"))).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    off = transparency.risk_level(F.col("s"), F.col("ind"), F.col("d"), F.col("c"), threshold=0, industry_matters=False, coi_matters=False)
    assert {r["o"] for r in frame.where("not ind or s <= 70").select(off.alias("o")).collect()} == {"low", "medium"}


def test_transparency(spark):
    papers = [(1, ["Acme Pharma Inc."], "We declare no competing interest; data on GitHub.", True, 3, ["NCT00000001"], ["NCT00000001"]), (2, [], None, None, None, [], []), (3, ["U"], "Data not available upon request? available upon request", False, 0, ["NCT1", "NCT2", "NCT3", "NCT4"], ["NCT4"])]
    frame = spark.createDataFrame(papers, "id int, funders array<string>, abstract string, is_open_access boolean, cited_by_count int, trial_ids array<string>, results_posted array<string>")
    got = {r["id"]: r for r in transparency.analyze(frame).collect()}
    assert (got[1]["score"], got[1]["risk_level"], got[1]["industry"], got[1]["data_level"]) == (100, "medium", True, "full_open")
    assert (got[2]["score"], got[2]["risk_level"]) == (0, "high")
    assert (got[3]["data_level"], got[3]["score"]) == ("on_request", 15 + 10 + 20)
    assert "Registered trial without posted results" in got[3]["indicators"]
    assert "Industry funder: Acme Pharma Inc." in got[1]["indicators"]
    assert [got[i]["industry_confidence"] for i in (1, 2, 3)] == [0.8, 0.0, 0.0]
    assert column(spark, ["PARAMETER num_ctx  8192\nx", "", None], lambda c: T.context_window(c, 4096)) == [8192, 4096, 4096]


def test_fulltext(spark):
    src = "array<struct<url:string,format:string,source:string>>"
    rows = [(1, None, None, [("p", "pdf", "a"), ("x", "xml", "b"), ("y", "xml", "c")], None, None, "d", "9"), (2, "<html>", None, [("x", "xml", "b")], None, None, None, None), (3, None, None, [("e", "epub", "a")], "PMC7", "u", None, None), (4, None, None, None, None, None, "10.1/x", "9"), (5, None, None, None, None, None, "", "9"), (6, None, None, [], "", "", None, None)]
    frame = spark.createDataFrame(rows, f"id int, cached_html string, cached_pdf string, sources {src}, pmc_id string, unpaywall_url string, doi string, pmid string")
    got = {r["id"]: r["resolved"] and tuple(r["resolved"]) for r in fulltext.resolve(frame).collect()}
    assert got[1] == ("b", "x")
    assert got[2] == ("cached", "<html>")
    assert got[3] == ("europepmc", "https://europepmc.org/article/PMC/7")
    assert got[4] == ("doi", "https://doi.org/10.1/x")
    assert got[5] == ("pubmed", "https://pubmed.ncbi.nlm.nih.gov/9/")
    answers = [({"url_for_pdf": None, "url": "w"}, []), (None, [{"url_for_pdf": "", "url": ""}, {"url_for_pdf": "p", "url": "q"}]), (None, None)]
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a struct<best_oa_location:struct<url_for_pdf:string,url:string>,oa_locations:array<struct<url_for_pdf:string,url:string>>>")
    assert [r["o"] for r in frame.select("i", fulltext.best_location(F.col("a")).alias("o")).orderBy("i").collect()] == ["w", "p", None]
    assert column(spark, [b"%PDF-1", b"<html", b""], fulltext.is_pdf, "binary") == [True, False, False]


def test_usage(spark):
    calls = spark.createDataFrame([(1, "m", 100, 50), (2, "m", 200, 100), (3, "n", 5, 5)], "seq int, model string, input_tokens long, output_tokens long")
    priced = usage.with_cost(calls, spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_price double, output_price double"), (3.0, 15.0))
    got = {r["model"]: r for r in usage.by_model(priced).collect()}
    assert (got["m"]["input_tokens"], got["m"]["output_tokens"], got["m"]["calls"]) == (300, 150, 2)
    assert got["m"]["cost"] == pytest.approx(0.0006)
    assert (got[None]["calls"], got[None]["input_tokens"]) == (3, 305)
    assert [r["seq"] for r in usage.recent(calls, 2).collect()] == [2, 3]
    assert usage.recent(calls, 0).count() == 0


WORK = {
    "doi": "https://doi.org/10.1/x", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/7"}, "title": "T", "abstract_inverted_index": {"a": [1], "b": [0]},
    "authorships": [{"author": {"display_name": "A"}}, {"author": {"display_name": None}}], "primary_location": {"source": {"display_name": "J"}},
    "locations": [{"source": {"display_name": "S"}, "landing_page_url": "l", "pdf_url": "p", "version": "publishedVersion", "is_oa": True}, {"source": None, "landing_page_url": "m", "version": "odd"}],
    "primary_topic": {"display_name": "K"}, "open_access": {"is_oa": True}, "type": "article", "publication_date": "2024-01-01",
}


def test_works(spark):
    full, bare = records.works(spark.createDataFrame([(1, json.dumps(WORK)), (2, "{}")], "id int, json string")).orderBy("id").collect()
    assert (full["doi"], full["pmid"], full["abstract"], full["authors"], full["journal"], full["keywords"], full["publication_types"]) == ("10.1/x", "7", "b a", ["A"], "J", ["K"], ["article"])
    assert [tuple(s) for s in full["fulltext_sources"]] == [("l", "html", "S", True, "published"), ("p", "pdf", "S", True, "published"), ("m", "html", "unknown", False, "odd")]
    assert (bare["title"], bare["doi"], bare["authors"], bare["is_open_access"], bare["fulltext_sources"]) == ("", None, [], False, [])


def test_preprints(spark):
    rows = [(1, json.dumps({"doi": "10.1101/1", "title": "T", "authors": "A; B; C", "date": "2024-01-01", "abstract": "", "jatsxml": "u", "category": "c"})), (2, "{}")]
    one, two = records.preprints(spark.createDataFrame(rows, "id int, json string"), "biorxiv").orderBy("id").collect()
    assert (one["authors"], one["abstract"], one["is_open_access"], one["extras"]["category"]) == (["A", "B", "C"], None, True, "c")
    assert [tuple(s)[:3] for s in one["fulltext_sources"]] == [("https://www.biorxiv.org/content/10.1101/1v1.full.pdf", "pdf", "biorxiv"), ("u", "xml", "biorxiv")]
    assert (two["doi"], two["authors"], two["fulltext_sources"]) == (None, [], [])


CITATION = """<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">x <i>y</i> z</AbstractText><AbstractText>w</AbstractText></Abstract>
<AuthorList><Author><LastName>Smith</LastName><ForeName>Jo</ForeName></Author><Author><LastName>Group</LastName></Author><Author><ForeName>No</ForeName></Author></AuthorList>
<Journal><Title>J</Title><JournalIssue><PubDate><Year>2024</Year><Month>Jan</Month><Day>5</Day></PubDate></JournalIssue></Journal></Article>
<MeshHeadingList><MeshHeading><DescriptorName>M</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/a</ArticleId><ArticleId IdType="pmc">PMC5</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


def test_citations(spark):
    full, bare, broken = records.citations(spark.createDataFrame([(1, CITATION), (2, "<PubmedArticle/>"), (3, "<oops")], "id int, xml string")).orderBy("id").collect()
    assert (full["pmid"], full["abstract"], full["authors"], full["publication_date"], full["keywords"]) == ("12", "AIM: x y z\nw", ["Smith, Jo", "Group"], "2024-01-05", ["M"])
    assert [(s["source"], s["open_access"]) for s in full["fulltext_sources"]] == [("pmc", True), ("publisher", False)]
    assert (bare["title"], bare["doi"], bare["authors"]) == ("", None, [])
    assert broken["pmid"] is None
