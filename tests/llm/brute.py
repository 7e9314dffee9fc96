"""Plain-Python versions of what the operators compute."""

import re
from collections import Counter
from html.parser import HTMLParser

WORD = re.compile("[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components(rows, k, percent):
    """{doc_id: smallest reachable} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter()
    for ids in holders.values():
        for n, i in enumerate(ids):
            for j in ids[n + 1 :]:
                shared[i, j] += 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return {i: top(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def statistics(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeated = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


class _Article(HTMLParser):
    def __init__(self, tag):
        super().__init__(convert_charrefs=True)
        self.tag, self.depth, self.out = tag, 0, [""]

    def handle_starttag(self, tag, attributes):
        if tag == self.tag and (self.depth or self.tag == "article" or not attributes):
            self.depth += 1
        elif tag == "br":
            self.out[-1] += " "
        elif tag in ("p", "h1"):
            self.out.append("")

    def handle_endtag(self, tag):
        if tag == self.tag and self.depth:
            self.depth -= 1
        if tag in ("p", "h1"):
            self.out.append("")

    def handle_data(self, data):
        if self.depth:
            self.out[-1] += data


def article_text(page, tag="article"):
    """The blocks of a page's articles, for pages that hold headings, paragraphs, bold text and line breaks in them only."""
    parser = _Article(tag)
    parser.feed(page or "")
    parser.close()
    return "\n\n".join(t for t in (" ".join(x.split()) for x in parser.out) if t)
