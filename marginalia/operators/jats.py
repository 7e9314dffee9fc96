"""Journal articles in JATS XML: nested records and an HTML rendering.

The document is walked as a tree: each rule below asks for a path, so that no state is kept between elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape  # of table cells; all else is escaped by expressions
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

SCHEMA = """id long, title string, authors array<string>, journal string, volume string, issue string, pages string, year string, doi string, pmc_id string, pmid string,
    abstract_sections array<struct<title:string,content:string>>,
    body_sections array<struct<path:array<int>,depth:int,title:string,paragraphs:array<string>>>,
    figures array<struct<id:string,label:string,caption:string,graphic_url:string>>,
    tables array<struct<id:string,label:string,caption:string,html_content:string>>,
    references array<struct<id:string,label:string,citation:string,authors:array<string>,article_title:string,source:string,year:string,volume:string,issue:string,first_page:string,last_page:string,doi:string,pmid:string>>,
    error string"""
#: Characters of the documents that are parsed and handed on together.
RUN_CHARS = 1 << 21
HREF = "{http://www.w3.org/1999/xlink}href"
LINKED = {"fig": "Figure", "figure": "Figure", "table": "Table", "table-wrap": "Table"}


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def rich_text(node: Element | None, inside: frozenset[str] = frozenset()) -> str:
    """Text of an element with its inline markup; links to figures and tables become ``[text](#id)``.

    Paragraph-like children (lists, formulas on lines of their own, figures, tables) are not part of it.
    """
    if node is None:
        return ""
    out = [node.text or ""]
    for child in node:
        tag = child.tag
        if tag == "xref" and child.get("ref-type") in LINKED and child.get("rid"):
            out.append(f"[{squeezed(rich_text(child)) or LINKED[child.get('ref-type')]}](#{child.get('rid')})")
        elif tag not in ("list", "disp-formula", "fig", "table-wrap", "label", *inside):
            out.append(rich_text(child, inside))
        out.append(child.tail or "")
    return "".join(out)


def line(node: Element | None) -> str:
    return squeezed(rich_text(node))


def found(node: Element | None, path: str) -> str:
    hit = node.find(path) if node is not None else None
    return squeezed("".join(hit.itertext())) if hit is not None else ""


def person(node: Element) -> str:
    return " ".join(filter(None, (found(node, "given-names"), found(node, "surname"))))


def sections(parent: Element, path: tuple[int, ...] = ()) -> Iterator[dict]:
    """Sections in document order, each with its place in the tree; an explicit stack, for any depth."""
    todo = [(s, (*path, i)) for i, s in enumerate(parent.findall("sec"))][::-1]
    while todo:
        sec, at = todo.pop()
        paragraphs = [line(p) for p in sec.findall("p")]
        yield {"path": list(at), "depth": len(at), "title": line(sec.find("title")), "paragraphs": paragraphs}
        todo += [(s, (*at, i)) for i, s in enumerate(sec.findall("sec"))][::-1]


def abstract_sections(front: Element) -> list[dict]:
    out = []
    for abstract in front.iter("abstract"):
        groups: list[tuple[str, list[str]]] = [("", [])]
        for node in abstract.iter():
            if node.tag == "title":
                groups.append((squeezed("".join(node.itertext())), []))
            elif node.tag == "p" and (text := line(node)):
                groups[-1][1].append(text)
        out += [{"title": t, "content": " ".join(ps)} for t, ps in groups if ps]
    return out


def table_html(wrap: Element) -> str:
    """Header rows (those in thead, or a first row of th cells) and body rows, padded to the first row's width."""
    head: list[list[str]] = []
    body: list[list[str]] = []
    in_head = {r for t in wrap.iter("thead") for r in t.iter("tr")}
    in_body = {r for t in wrap.iter("tbody") for r in t.iter("tr")}
    for row in wrap.iter("tr"):
        cells: list[str] = []
        for cell in row:
            if cell.tag in ("th", "td"):
                span = cell.get("colspan", "1")
                cells += [squeezed("".join(cell.itertext()))] + [""] * (max(1, int(span) if span.isdigit() else 1) - 1)
        if cells:
            names = row.find("th") is not None
            (head if row in in_head or (names and row not in in_body and not head) else body).append(cells)
    width = max(len(rows[0]) if rows else 0 for rows in (head, body))
    if not width:
        return ""
    fit = lambda cells: (cells + [""] * width)[:width]
    lines = ["<table>"]
    for outer, cell, rows, always in (("thead", "th", head, False), ("tbody", "td", body, True)):
        if rows or always:
            lines.append(f"  <{outer}>")
            for r in rows:
                lines += ["    <tr>", *(f"      <{cell}>{escape(c)}</{cell}>" for c in fit(r)), "    </tr>"]
            lines.append(f"  </{outer}>")
    return "\n".join([*lines, "</table>"])


def reference(ref: Element) -> dict:
    cite = next((c for c in ref.iter() if c.tag in ("mixed-citation", "element-citation")), None)
    names = [] if cite is None else [person(n) for g in cite.iter("person-group") for n in g.iter("name") if found(n, "surname")]
    names += [] if cite is None else [t for c in cite.iter("collab") if (t := squeezed("".join(c.itertext())))]
    ids = [] if cite is None else [squeezed("".join(x.itertext())) for x in cite.iter("pub-id")]
    return {
        "id": ref.get("id", ""), "label": found(ref, "label"), "citation": "" if cite is None else squeezed("".join(cite.itertext())), "authors": names,
        "article_title": found(cite, ".//article-title"), "source": found(cite, ".//source"), "year": found(cite, ".//year"), "volume": found(cite, ".//volume"), "issue": found(cite, ".//issue"),
        "first_page": found(cite, ".//fpage"), "last_page": found(cite, ".//lpage"), "doi": next((x for x in reversed(ids) if x.startswith("10.")), ""), "pmid": next((x for x in reversed(ids) if x.isdigit() and len(x) >= 7), ""),
    }


def identifiers(front: Element, known_pmc: str) -> dict[str, str]:
    out = {"doi": "", "pmc": known_pmc, "pmid": ""}
    kinds = {"doi": "doi", "pmc": "pmc", "pmcid": "pmc", "pmid": "pmid", "pubmed": "pmid"}
    for node in front.iter("article-id"):
        text, kind = squeezed("".join(node.itertext())), kinds.get((node.get("pub-id-type") or "").lower())
        if kind:
            out[kind] = text
        elif text.startswith("10."):
            out["doi"] = text
        elif text.startswith("PMC"):
            out["pmc"] = text
        elif text.isdigit() and len(text) >= 7:
            out["pmid"] = out["pmid"] or text
    return out


def parse(i: int, xml: str | bytes | None, known_pmc: str = "") -> dict:
    """One article; a document that is not XML gives its error and nulls."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError as e:
        return {"id": i, "error": str(e)}
    front = root.find(".//front")
    front = front if front is not None else Element("front")
    meta = front.find(".//article-meta")
    ids = identifiers(front, known_pmc)
    first, last = found(meta, "fpage"), found(meta, "lpage")
    parents = [p for p in (root.find(".//body"), root.find(".//back")) if p is not None]
    body: list[dict] = []
    for p in parents:
        shift = 1 + max((s["path"][0] for s in body), default=-1)
        body += [s | {"path": [s["path"][0] + shift, *s["path"][1:]]} for s in sections(p)]
    return {
        "id": i, "title": line(meta.find("title-group/article-title") if meta is not None else None), "authors": [n for c in front.iter("contrib") if c.get("contrib-type") == "author" and (n := person(c.find("name") if c.find("name") is not None else c))],
        "journal": found(front, ".//journal-title"), "volume": found(meta, "volume"), "issue": found(meta, "issue"), "pages": f"{first}-{last}" if first and last else first, "year": found(meta, ".//year"), "doi": ids["doi"], "pmc_id": ids["pmc"], "pmid": ids["pmid"],
        "abstract_sections": abstract_sections(front), "body_sections": body,
        "figures": [{"id": f.get("id", ""), "label": found(f, "label"), "caption": "".join(line(p) for p in f.iterfind("caption/p")), "graphic_url": next((g.get(HREF) or g.get("href") or "" for g in f.iter("graphic")), "")} for f in root.iter("fig")],
        "tables": [{"id": t.get("id", ""), "label": found(t, "label"), "caption": "".join(line(p) for p in t.iterfind("caption/p")), "html_content": table_html(t)} for t in root.iter("table-wrap")],
        "references": [reference(r) for r in root.iter("ref")], "error": None,
    }


def element(tag: str, *content: Column, attributes: str = "") -> Column:
    """An element around texts that are HTML already; null if one of them is."""
    return F.concat(F.lit(f"<{tag}{attributes}>"), *content, F.lit(f"</{tag}>"))


def some(c: Column, f: Callable[[Column], Column] = T.html_escape) -> Column:
    """``f`` of a text that is not empty; else null."""
    return F.when(c != "", f(c))


def lines(*parts: Column, between: str = "\n") -> Column:
    """Parts that are not null, one below the other."""
    return F.concat_ws(between, *parts)


def reference_html(r: Column) -> Column:
    """A reference as HTML; its raw citation if no part of it is known."""
    link = lambda doi: F.concat(F.lit('<a href="https://doi.org/'), T.html_escape(doi), F.lit('">doi:'), T.html_escape(doi), F.lit("</a>"))
    names = some(T.name_list(r["authors"], 3, 2))
    year = some(r["year"], lambda y: F.concat(F.lit("("), T.html_escape(y), F.lit(")")))
    numbers = T.html_escape(T.volume_part(r["volume"], r["issue"], r["first_page"], r["last_page"]))
    whole = lines(names, some(r["article_title"]), element("em", some(r["source"])), year, numbers, some(r["doi"], link), between=". ")
    return F.when(whole != "", whole).otherwise(T.html_escape(r["citation"]))


def figure_html(f: Column, place: Column, pmc: Column) -> Column:
    number = (place + 1).cast("string")
    name = T.html_escape(F.coalesce(T.blank_to_null(f["label"]), F.concat(F.lit("Figure "), number)))
    image = some(f["graphic_url"], lambda path: F.concat(F.lit('  <img src="'), T.html_escape(T.figure_url(path, pmc)), F.lit('" alt="'), name, F.lit('" loading="lazy">')))
    caption = lines(F.lit("  <figcaption>"), F.concat(F.lit("    "), element("strong", name)), F.concat(F.lit("    "), element("p", some(f["caption"]))), F.lit("  </figcaption>"))
    return lines(F.concat(F.lit('<figure id="'), T.html_escape(F.coalesce(T.blank_to_null(f["id"]), F.concat(F.lit("fig"), number))), F.lit('">')), image, caption, F.lit("</figure>"))


def table_block(t: Column, place: Column) -> Column:
    number = (place + 1).cast("string")
    head = F.concat(F.lit('<div class="table-container" id="'), T.html_escape(F.coalesce(T.blank_to_null(t["id"]), F.concat(F.lit("table"), number))), F.lit('">'))
    name = element("h3", T.html_escape(F.coalesce(T.blank_to_null(t["label"]), F.concat(F.lit("Table "), number))))
    return lines(head, F.concat(F.lit("  "), name), F.concat(F.lit("  "), element("p", some(t["caption"]), attributes=' class="table-caption"')), T.blank_to_null(t["html_content"]), F.lit("</div>"))


def titled(heading: str, items: Column) -> Column:
    """A part of the page with its heading; null if it has no items."""
    return F.when(F.size(items) > 0, lines(F.lit(f"<h2>{heading}</h2>"), items))


def html(c: Callable[[str], Column] = F.col) -> Column:
    """The article as an HTML fragment, of the columns of a parsed record."""
    authors = c("authors")
    shown = F.concat(F.array_join(F.slice(authors, 1, 5), ", "), F.when(F.size(authors) > 5, " et al.").otherwise(""))
    pages = some(c("pages"), lambda p: F.concat(F.lit(": "), p))
    numbers = F.concat(c("volume"), F.coalesce(some(c("issue"), lambda i: F.concat(F.lit("("), i, F.lit(")"))), F.lit("")), F.coalesce(pages, F.lit("")))
    info = lines(element("em", some(c("journal"))), some(numbers), some(c("year"), lambda y: F.concat(F.lit("("), T.html_escape(y), F.lit(")"))), between=" ")
    # name, address before and after the number, and the number in the address
    kinds = (("DOI", "https://doi.org/", "", c("doi"), c("doi")), ("PMC", "https://europepmc.org/article/PMC/", "", c("pmc_id"), F.regexp_replace(c("pmc_id"), "^PMC", "")), ("PMID", "https://pubmed.ncbi.nlm.nih.gov/", "/", c("pmid"), c("pmid")))
    ids = lines(*[F.when(x != "", F.concat(F.lit(f'{name}: <a href="{base}'), T.html_escape(number), F.lit(f'{tail}">'), T.html_escape(x), F.lit("</a>"))) for name, base, tail, x, number in kinds], between=" | ")
    abstract = F.transform(c("abstract_sections"), lambda s: element("p", F.coalesce(element("strong", some(s["title"]), F.lit(":")), F.lit("")), F.when(s["title"] != "", " ").otherwise(""), T.html_escape(s["content"])))

    def section(s: Column) -> Column:
        level = F.least(s["depth"] + 1, F.lit(6)).cast("string")
        heading = some(s["title"], lambda t: F.concat(F.lit("<h"), level, F.lit(">"), T.html_escape(t), F.lit("</h"), level, F.lit(">")))
        return lines(heading, F.transform(F.filter(s["paragraphs"], lambda p: p != ""), lambda p: element("p", T.inline_links(p))))

    body = F.filter(F.transform(c("body_sections"), section), lambda x: x != "")
    items = F.transform(c("references"), lambda r: F.concat(F.lit('  <li id="ref-'), T.html_escape(r["id"]), F.lit('">'), reference_html(r), F.lit("</li>")))
    return lines(
        element("h1", some(c("title"))),
        F.when(F.size(authors) > 0, element("p", F.lit("<strong>Authors:</strong> "), T.html_escape(shown), attributes=' class="authors"')),
        element("p", some(info, lambda x: x), attributes=' class="journal-info"'),
        element("p", some(ids, lambda x: x), attributes=' class="identifiers"'),
        titled("Abstract", abstract),
        body,
        titled("Figures", F.transform(c("figures"), lambda f, i: figure_html(f, i, c("pmc_id")))),
        titled("Tables", F.transform(c("tables"), table_block)),
        F.when(F.size(items) > 0, lines(F.lit("<h2>References</h2>"), F.lit('<ol class="references">'), items, F.lit("</ol>"))),
    )


def articles(raw: DataFrame, id_col: str = "id", xml_col: str = "xml", pmc_col: str | None = None) -> DataFrame:
    """JATS documents (one per row) as nested records with their HTML.

    Python only makes the nested record of the XML, some megabytes of documents at a time; the rest are expressions.
    A document that is not XML gives its error, and nulls.
    """
    names = ["id", "title", "authors", "journal", "volume", "issue", "pages", "year", "doi", "pmc_id", "pmid", "abstract_sections", "body_sections", "figures", "tables", "references", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # rows of about RUN_CHARS together; null and broken documents are short
            for _, some_rows in f.groupby(f["xml"].fillna("").str.len().cumsum() // RUN_CHARS):
                rows = [parse(i, x, p or "") for i, x, p in zip(some_rows["id"], some_rows["xml"], some_rows["pmc"], strict=True)]
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    pmc = F.col(pmc_col) if pmc_col else F.lit("")
    return raw.select(F.col(id_col).cast("long").alias("id"), F.col(xml_col).alias("xml"), pmc.alias("pmc")).mapInPandas(run, SCHEMA).withColumn("html", F.when(F.col("error").isNull(), html()))
