import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import html_text, mixing, multi_index, near_dedup, warc
from marginalia.llm.common import scratch
from marginalia.llm.queries import op2_warc, warc_rows

from . import brute

SF = "/root/testdata/sf0.001"


def near_rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["", " \n", "one", "ONE", "a b", "a  B", "a b c d", "A b c D"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows, strict=True), (1000, None)]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_match_all_pairs(spark, words):
    rows = near_rows() + [(r["doc_id"] + 2000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, sizes = brute.components(rows, words, 80)
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None), rows[3]], "doc_id long, text string").withColumn("rep", F.lit("clash"))
    got = near_dedup.near_duplicates(docs, words=words).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == Counter((i, sizes[i], want[i], i == want[i]) for i, _ in [*rows, rows[3]])
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_documents_of_several_texts(spark):
    """Rows that share an id are one document, which links by each of its texts, in any order of the rows."""
    one, other, third = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, one), (1, other), (2, one + " x"), (3, other + " y"), (4, third), (5, ""), (5, third + " z"), (6, None), (6, ""), (7, third + " v w"), (7, one + " v"), (9, "q")]
    for some in (rows, rows[::-1]):
        got = near_dedup.near_duplicates(spark.createDataFrame(some, "doc_id long, text string").repartition(3, "text")).collect()
        assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter((i, 1 if i in (1, 2, 3, 4, 5, 7) else i, i in (1, 6, 9)) for i, _ in rows)


def test_rest_of_a_bucket_is_compared(spark):
    """A chain: neighbours link, the first member links with hardly any."""
    words = [f"x{i}" for i in range(900)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(90)]
    want, _ = brute.components(rows, 4, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["v"]: r["c"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    adjacent = defaultdict(set)
    for a, b in edges:
        if a != b:
            adjacent[a].add(b)
            adjacent[b].add(a)
    for v in adjacent:
        seen, todo = {v}, [v]
        while todo:
            for x in adjacent[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[v] == min(seen)


def test_likelihood_estimate():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    a, b = np.sort(values[:2000]), np.sort(values[500:2500])
    regs = near_dedup.sketch(np.concatenate((a, b)), np.array([len(a), len(b)]), 1024)
    assert near_dedup.likely_similarity(regs[:1], regs[1:], np.array([2000.0]), np.array([2000.0]))[0] == pytest.approx(1500 / 2500, abs=0.06)
    both = near_dedup.sketch(np.sort(np.union1d(a, b)), np.array([2500]), 1024)
    assert (both[0] == np.maximum(regs[0], regs[1])).all()


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    got = {r["doc_id"]: r for r in mixing.taken(mixing.mix_plan(docs)).collect()}
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in rows}
    of = defaultdict(int)
    for r in rows:
        of[r["source"]] += size[r["doc_id"]]
    assert len(got) == len(rows)
    total, names = sum(size.values()), sorted(of)
    want = mixing.capped_targets([of[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], total)
    assert sum(want) == pytest.approx(total)
    taken = defaultdict(int)
    for r in rows:
        g = got[r["doc_id"]]
        assert (g["size"], g["source_size"]) == (size[r["doc_id"]], of[r["source"]])
        assert g["target"] == pytest.approx(want[names.index(r["source"])])
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[r["source"]] += g["taken"]
    for n, t in zip(names, want, strict=True):
        assert abs(taken[n] - t) <= max(2 * mixing.BLOCK, 0.01 * t)
    again = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix_plan(docs.repartition(7))).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    texts = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        texts[r["doc_id"]] += len(brute.words(r["text"]))
    assert texts == {i: r["taken"] for i, r in got.items() if r["taken"]}


def test_mixing_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "p q r", None), (4, "w " * 500, "b"), (5, "z " * 70, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("no", F.lit(1))
    plan = mixing.taken(mixing.mix_plan(docs)).collect()
    assert Counter(r["doc_id"] for r in plan) == Counter(r[0] for r in rows)
    assert sum(r["taken"] for r in plan) == sum(len(brute.words(r["text"])) for r in mixing.mixed_documents(docs).collect())
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_equal_sources_tie_by_place(spark):
    """Blocks left over go to the earlier of equal sources; a rerun gives the same."""
    rows = [(10 * s + d, "w " * 64, src) for s, src in enumerate(("a", "b", "c", None)) for d in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [{r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix_plan(d, weights=(1,))).collect()} for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1] == {i: 64 for i, _, _ in rows}
    assert mixing.sainte_lague([4.0, 4.0, 4.0], 4, [9, 9, 9]) == [2, 1, 1]


def test_highest_quotients():
    rng = random.Random(3)
    for _ in range(60):
        votes = [rng.choice([0, rng.uniform(0, 50), rng.randint(1, 9)]) for _ in range(rng.randint(1, 7))]
        limits, seats = [rng.randint(0, 30) for _ in votes], rng.randint(0, 60)
        want = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i, v in enumerate(votes) if v > 0 and want[i] < limits[i]]
            if open_:
                want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, limits) == want
    assert mixing.capped_targets([10, 100, 1000], [5, 2, 1], 1110) == [30.0, 300.0, 780.0]


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_multi_index_recall(spark, table):
    """The dealt queries against brute force; the share visited falls as the table grows."""
    vectors = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    found = defaultdict(dict)
    for r in multi_index.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0")).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - data[q]) ** 2).sum(1))
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert len(found[q]) == 10
        hits += len(set(best) & set(found[q]))
        total += 10
        for v, s in found[q].items():
            assert s == pytest.approx(float(np.sqrt(((data[v] - data[q]) ** 2).sum())), rel=1e-12)
    assert hits >= 0.9 * total


def test_multi_index_grows_with_the_table():
    sizes = [300, 2000, 10_000, 50_000, 10**6, 10**9]
    assert [multi_index.centroids_for(n) for n in sizes] == [32, 64, 128, 256, 1024, 1024]
    shares = [multi_index.share_for(n) for n in sizes]
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.06


def test_multi_index_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 40, rng.normal(size=6).tolist()) for i in range(200)]
    got = defaultdict(list)
    for r in multi_index.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id in (0, 7)"), visit=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 7):
        own = np.array(min(v for i, v in rows if i == q))
        near = {i: min(float(np.linalg.norm(np.array(v) - own)) for j, v in rows if j == i) for i in range(40) if i != q}
        assert [i for i, _ in got[q]] == sorted(near, key=near.get)[:10]
        assert [s for _, s in got[q]] == pytest.approx(sorted(near.values())[:10])


def test_multi_index_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [0.5, 0.1]), (8, [0.5, 0.1]), (9, [1.0]), (100, [-0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("cell", F.lit(0))
    got = multi_index.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 7), (0, 3, 8), (0, 4, 100), (100, 1, 8), (100, 2, 0), (100, 3, 1), (100, 4, 7)]
    assert multi_index.nearest_neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


def test_multi_index_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(1000 + i, [float(i % 7), 1.0, 2.0, float(i % 5)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multi_index.nearest_neighbours(vectors, vectors.where("vec_id in (0, 200)")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [*range(1, 11), *range(10)]


PAGES = [
    ("<article><h1>T &amp; x</h1><p>One <b>two</b><br>three<p>four&nbsp;five</article><footer>f</footer>", "T & x\n\nOne two three\n\nfour five"),
    ("<nav>menu</nav><main><section><p>a</p><ul><li>b<li>c</ul></section><aside>s</aside><form>q</form></main>", "a\n\nb\n\nc"),
    ("<header>site</header><div class='cookie-notice'>ok?</div><div id=content><p>text &lt;b&gt;</p></div><div class=\"comments\"><p>first!</p></div>", "text <b>"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes<!-- <p>no</p> -->", "yes"),
    ("<article><p>open <i>tags <p>and &#233;&#x1F600; &amp</p></div></article>", "open tags\n\nand é😀 &"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><article class=comment>reader</article></article>", "a b\n\nc"),
    ("plain < text & more", "plain < text & more"),
    ("", ""),
    (None, ""),
    ("<article></article>", ""),
    ("<div role=banner>x</div><p hidden>y</p><p aria-hidden='true'>z</p><p>w</p>", "w"),
    ("<p>a</p><script>never closed <p>b</p>", "a"),
]


def test_html_blocks(spark):
    rows = [(i, f"http://h{i}.example/", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>x"), (0, "u", "<p>dup"), (0, "u", "<p>dup")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    want = Counter((i, f"http://h{i}.example/", t, len(t)) for i, (_, t) in enumerate(PAGES)) + Counter({(None, None, "x", 1): 1, (0, "u", "dup", 3): 2})
    assert Counter(map(tuple, got)) == want
    assert html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_site_template(spark, monkeypatch):
    boiler = "<div><p>All about our paper</p><p>Call us</p></div>"
    shared = "<p>A passage that several articles quote.</p>"
    page = lambda host, i, body: (i, f"https://{host}/a/{i}", f"<body>{boiler}<div><p>Story {i} of the day</p>{body}</div></body>")
    rows = [page("a.example", i, "") for i in range(9)] + [page("b.example", 100 + i, "") for i in range(2)]
    rows += [(200 + i, "https://c.example/x", f"<article><p>Story {i}</p>{shared}<div>Share this story</div></article>") for i in range(9)]
    rows += [(300 + i, f"https://d.example/{i}", "<div><div><p>copied story</p></div></div>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {i} of the day" for i in range(9)} | {100 + i: f"All about our paper\n\nCall us\n\nStory {100 + i} of the day" for i in range(2)}
    want |= {200 + i: f"Story {i}\n\nA passage that several articles quote." for i in range(9)} | {300 + i: "copied story" for i in range(9)}
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == want
    monkeypatch.setattr(html_text, "BROADCAST_TEMPLATES", 0)  # the way beyond the broadcast's bound
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == want


def test_names_are_left_to_the_counts(spark):
    names = ("id='discussion'", "class='related-work'", "class=search-results", "class='social-history'", "class='section-header'", "class=notice", "class=share")
    own = [(i, f"https://one.example/{i}", "<article><p>Story</p>" + f"<section {n}><p>Text {i}</p></section></article>") for i, n in enumerate(names)]
    bar = "<span class='share'>Share on all sites</span>"
    own += [(100 + i, f"https://two.example/{i}", f"<article><p>Story {i}</p><div class='ad'>Buy {i}</div><p>End</p>{bar}</article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(own, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story\n\nText {i}" for i in range(len(names))} | {100 + i: f"Story {i}\n\nEnd" for i in range(9)}


def test_pages_match_a_plain_version(spark):
    for sf in ("sf0.001", "sf0.1"):
        pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
        want = Counter((r["page_id"], r["url"], brute.article_text(r["html"]), len(brute.article_text(r["html"]))) for r in pages.collect())
        assert Counter(map(tuple, html_text.extract(pages).collect())) == want


def test_templates_do_the_work(spark):
    """On the given pages, most elements that go were found by the counts; also with the article's tag hidden."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.xxhash64("html").alias("page"))
    for hide in (False, True):
        if hide:
            pages = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
        template = defaultdict(set)
        for r in html_text.template_subtrees(html_text.hashed_pages(pages)).collect():
            template[r["host"]].add(r["hash"] & ((1 << 64) - 1))
        counted = ruled = same = 0
        rows = pages.collect()
        for r in rows:
            root = html_text.parse(r["html"])
            c, k = html_text.prune(root, template[r["host"]], html_text.articles(root) != [root])
            counted, ruled = counted + c, ruled + k
            same += "\n\n".join(html_text.blocks(html_text.articles(root))) == brute.article_text(r["html"], "div" if hide else "article")
        assert counted > 20 * max(1, ruled)
        # without the tag, a paragraph that recurs on its host is template
        assert same >= (0.9 if hide else 1) * len(rows)


def test_menus_and_advertisements_of_a_site(spark):
    """Apparatus whose words differ on every page is found by its shape; a host of few pages keeps what only counts could tell."""
    page = lambda i: f"<div class='top-menu'><p>Go {i}</p></div><div><a href=/{i}>one {i}</a><a>two {i}</a><a>three</a></div><div id=story-{i}><p>Story {i}</p><p>More {i}</p></div><div class='promo-{i}'>Buy {i}</div>"
    rows = [(i, f"https://many.example/{i}", page(i)) for i in range(9)] + [(100 + i, f"https://few.example/{i}", page(i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\n\nMore {i}" for i in range(9)} | {100 + i: f"Go {i}\n\none {i}two {i}three\n\nStory {i}\n\nMore {i}\n\nBuy {i}" for i in range(3)}


def test_warc_round_trip(spark):
    long_page = "é<p>" * 60_000
    rows = [(5, "http://a", "x" * 200), (3, "http://b\r\nX: y", "x" * 200), (9, None, "x" * 200), (4, "http://c", None), (6, "http://c", ""), (7, "d", "y" * 99), (8, "d", "y" * 99), (10, "e", long_page), (2, "f", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (11, "g", long_page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages, scratch(spark, "warc")).collect()}
    assert len(got) == len(rows)
    assert all(r["verified"] for r in got.values())
    refers = {5: 3, 9: 3, 11: 10}
    for i, _, h in rows:
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", refers[i]) if i in refers else ("response", None))
        assert i in refers or bytes(got[i]["payload"]) == (h or "").encode()
    assert warc.archive_round_trip(pages.limit(0), scratch(spark, "warc")).count() == 0


def test_warc_keeps_every_row(spark):
    long, other = "é<p>" * 60_000, "other" * 30_000
    rows = [(1, "u", long), (1, "u", long), (1, "u", other), (2, "v", long), (None, "w", other), (None, "w", other), (None, "x", None), (3, "s", "short"), (3, "s", "short"), (None, "y", "n" * 200)]
    read = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark, "warc"))
    got = Counter(map(tuple, warc_rows(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    sha = lambda h: warc.hashlib.sha256((h or "").encode()).hexdigest()
    assert got == Counter((i, len((h or "").encode()), sha(h), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows)
    with pytest.raises(Exception, match="unverified record of page 2"):
        warc_rows(read.limit(0).unionByName(spark.createDataFrame([(2, "response", None, None, "d", False)], read.schema))).collect()


def test_warc_damage(spark):
    records = [r for n in (1, 2) for r in warc.page_records(n, "u", b"z" * 90, warc.hashlib.sha256(b"z" * 90).hexdigest(), None, segment=50)]
    rows = [(h["warc-record-id"], h["warc-type"], int(h["x-page-id"]), h["warc-payload-digest"][7:], None, int(h["warc-segment-number"]), h.get("warc-segment-origin-id"), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, bytearray(b)) for h, b in warc.parse(b"\r\n".join(records))]
    lost = [r for r in rows if not (r[2] == 2 and r[5] == 2)]
    random.Random(1).shuffle(lost)
    got = {r["page_id"]: r["verified"] for r in warc.reassemble(spark.createDataFrame(lost, warc.RECORDS)).collect()}
    assert got == {1: True, 2: False}


def test_chunked_framing():
    body = bytes(range(256)) * 90
    assert warc.dechunked(warc.chunked(body, 700)) == body
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_warc_query_matches_sql(spark):
    import duckdb

    from marginalia.llm.queries import ORACLE_SQL

    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    want = Counter(db.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({ORACLE_SQL['op2_warc']})").fetchall())
    assert Counter(map(tuple, op2_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == want


def test_strays_meet_all_blocks(spark, monkeypatch):
    """The way for large buckets, on small ones: one band of one register makes buckets of unlike texts."""
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    common = [f"c{i}" for i in range(40)]
    rng = random.Random(8)
    rows = []
    for g in range(8):
        own = [f"g{g}w{i}" for i in range(30)]
        for _ in range(5):
            copy = own + common
            copy[rng.randrange(30)] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    want, _ = brute.components(rows, 4, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.sketches(docs, 4, 24, "doc_id", "text")
    classes = sets.select("set_key", F.col("doc_id").alias("rep"), "n_shingles", "regs")
    members = classes.select(F.lit(1).alias("bucket"), "rep", F.col("rep").alias("c"))
    links = near_dedup.rest_links(members, classes, docs.toDF("v", "text"), 4, 80)
    got = {r["v"]: r["c"] for r in near_dedup.components(links).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == want
