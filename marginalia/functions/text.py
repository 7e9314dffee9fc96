"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five characters that HTML escapes, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
#: Month abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def named(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it (a lambda over one element names it)."""
    return F.transform(F.array(c), f)[0]


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense (``trim`` knows the space only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_space(c: Column) -> Column:
    """Runs of white space become one space, none stays at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def html_escape(c: Column) -> Column:
    for raw, escaped in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def inline_links(c: Column) -> Column:
    """``[text](#anchor)`` becomes a link, the rest is escaped; escaping makes none of the four brackets."""
    return F.regexp_replace(html_escape(c), r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')


def sanitize_identifier(c: Column) -> Column:
    """What is neither a word character, a dot nor a hyphen becomes an underscore."""
    return F.regexp_replace(c, r"(?U)[^\w.\-]", "_")


def normalize_type(c: Column) -> Column:
    """A publication type's form for comparison."""
    return F.translate(F.lower(strip(c)), "-_", "  ")


def quote_url(c: Column, safe: str = "") -> Column:
    """Percent-encoding that spares letters, digits, ``_.-~`` and ``safe``."""
    out = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    for s in safe:
        out = F.replace(out, F.url_encode(F.lit(s)), F.lit(s))
    return out


def zero_pad(c: Column) -> Column:
    """Two digits at least (``lpad`` would cut longer ones)."""
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def publication_date(year: Column, month: Column, day: Column, medline: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``; unknown month texts stay as they are."""
    key = F.left(strip(F.lower(month)), F.lit(3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), key)
    m = F.when(number > 0, F.lpad(number.cast("string"), 2, "0")).otherwise(zero_pad(month))
    dated = F.when(month.isNull(), year).when(day.isNull(), F.concat_ws("-", year, m)).otherwise(F.concat_ws("-", year, m, zero_pad(day)))
    return F.when(year.isNotNull(), dated).when(F.length(medline) >= 4, F.left(medline, F.lit(4)))


def article_id_kind(c: Column) -> Column:
    return F.when(c.startswith("10."), "doi").when(c.startswith("PMC"), "pmc").when(c.rlike(r"^\d{7,}$"), "pmid")


def with_pmc_prefix(c: Column) -> Column:
    return F.when(c.startswith("PMC"), c).otherwise(F.concat(F.lit("PMC"), c))


def figure_url(path: Column, pmc_id: Column) -> Column:
    """Absolute addresses stay; others are looked for beside the article, with an image extension."""
    base = F.concat(F.lit("https://europepmc.org/articles/"), with_pmc_prefix(pmc_id), F.lit("/bin/"), path)
    named = F.when(path.rlike(r"(?i)\.(gif|jpg|jpeg|png|svg)$"), base).otherwise(F.concat(base, F.lit(".jpg")))
    return F.when(path.startswith("http://") | path.startswith("https://"), path).when(F.coalesce(pmc_id, F.lit("")) != "", named).otherwise(path)


def trial_ids(c: Column) -> Column:
    """Distinct trial registration numbers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(NCT\d{8})"), 1)))


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), strip), lambda x: x != "")


def name_list(names: Column, most: int, shown: int) -> Column:
    """Names joined by commas; beyond ``most``, the first ``shown`` and *et al.*"""
    return F.when(F.size(names) <= most, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.lit(", et al." if shown < most else " et al.")))


def full_name(given: Column, surname: Column) -> Column:
    return F.concat_ws(" ", blank_to_null(given), surname)


def volume_part(volume: Column, issue: Column, first: Column, last: Column) -> Column:
    """``volume(issue):first-last`` with what is there."""
    vol = F.coalesce(F.concat(blank_to_null(volume), F.coalesce(F.concat(F.lit("("), blank_to_null(issue), F.lit(")")), F.lit(""))), F.lit(""))
    pages = F.concat(blank_to_null(first), F.coalesce(F.concat(F.lit("-"), blank_to_null(last)), F.lit("")))
    return blank_to_null(F.concat(vol, F.coalesce(F.concat(F.when(vol != "", ":").otherwise(""), pages), F.lit(""))))


def truncated(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def model_parts(model: Column, default: str) -> tuple[Column, Column]:
    """(provider, model name) of ``provider:name``; without a colon, the default provider."""
    parts = F.split(model, ":", 2)
    return F.when(F.size(parts) == 2, F.lower(parts[0])).otherwise(F.lit(default)), F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(model)


def context_window(model_file: Column, fallback: int) -> Column:
    """The ``num_ctx`` that a model's file states."""
    return F.coalesce(blank_to_null(F.regexp_extract(model_file, r"num_ctx\s+(\d+)", 1)).cast("int"), F.lit(fallback))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether the lower-case text holds one of the keywords, literally."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(low, F.lit(k))
    return found


def inverted_index(words: Column) -> Column:
    """word -> positions of an array of words: sorted once by (word, position), then cut into the runs of equal words."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def cut(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda x, k: F.when((k == 0) | (F.get(all_, k - 1)["w"] != x["w"]), k)), lambda k: k.isNotNull())
        return named(starts, lambda s: runs(all_, s))

    def runs(all_: Column, starts: Column) -> Column:
        stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(all_)))
        run = lambda a, b: F.struct(F.get(all_, a)["w"].alias("key"), F.transform(F.slice(all_, a + 1, b - a), lambda x: x["i"]).alias("value"))
        return F.map_from_entries(F.zip_with(starts, stops, run))

    return F.when(F.size(words) > 0, named(placed, cut))


def inverted_index_text(index: Column) -> Column:
    """The text of a word -> positions map; null if there is no position. Ties go by the word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return named(pairs, lambda p: F.when(F.size(p) > 0, F.array_join(F.transform(F.sort_array(p), lambda x: x["w"]), " ")))


def _candidates(c: Column) -> tuple[Column, Column]:
    """What stands in the first fenced block, and from the first to the last brace; null where there is none."""
    fenced = blank_to_null(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1))
    return strip(fenced), blank_to_null(F.regexp_extract(c, r"(?s)\{.*\}", 0))


def one_json(t: Column) -> Column:
    """The text if it is one JSON value and nothing else, else null.

    The parser stops after the first value.  So the text is parsed as the element of an array and as the member of an
    object: what follows the value can't close both.
    """
    inside = lambda before, after: F.try_parse_json(F.concat(F.lit(before), t, F.lit(after))).isNotNull()
    return F.when(inside("[", "]") & inside('{"v":', "}"), blank_to_null(t))


def json_object(c: Column) -> Column:
    """The JSON object in a model's answer: all of it, a fenced block, or from the first to the last brace.

    The text must be one object and nothing else: two objects with words between are none.
    """
    strict = lambda t: F.when(t.startswith("{") & t.endswith("}"), one_json(t))
    return F.coalesce(*[named(t, strict) for t in (strip(c), *_candidates(c))])


def extract_json(c: Column) -> Column:
    """The JSON text in an answer: any value in a fenced block, else from the first to the last brace; else the answer as it is."""
    return F.coalesce(*[named(t, one_json) for t in _candidates(c)], c)


def plain_citation(r: Column) -> Column:
    """A reference (struct) as plain text; its raw citation if no part of it is known."""
    text = lambda name: blank_to_null(r[name])
    named = F.when(F.size(r["authors"]) > 0, name_list(r["authors"], 3, 2))
    parts = [named, text("article_title"), text("source"), F.concat(F.lit("("), text("year"), F.lit(")")), volume_part(r["volume"], r["issue"], r["first_page"], r["last_page"]), F.concat(F.lit("doi:"), text("doi"))]
    return F.coalesce(blank_to_null(F.concat_ws(". ", *parts)), r["citation"])
