"""Operators against brute force, exact round trips, held-out accuracy and edge cases."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import common, html, lines, minhash, mixing, packing, queries, suffix, tokens, topk, toxicity, urls

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def odd_texts():
    base = words(120, 1)
    near = [*base[:60], "changed", *base[61:]]
    return [None, "", " \n\t", "one", "One two\nthree", " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(base), " ".join(words(30_000, 2)), "a  b\n\n c ", " ".join(words(70, 3) + base[:55])]


def odd_docs(spark):
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(odd_texts())]
    rows += [(5, rows[5][1], "en", "c", 1), (None, "no id " * 60, None, None, None)]
    # columns of the operators' own names must not disturb them
    return spark.createDataFrame(rows, DOCS).withColumn("part", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("size", F.lit("y"))


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def test_word_boundaries():
    texts = ["a b", "c", "", "d\x0be f g ", None, "é\tß"]
    w = common.Words(*common.text_buffers(pa.array(texts)))
    data = w.data.tobytes()
    got = [[data[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [brute.WORD.findall(t or "") for t in texts]


@pytest.mark.parametrize("few", [0, 500_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b or find(x) != x or x in got}


def test_op1_equals_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_minhash_forest(spark, DATA).collect()}
    assert got == brute.near_duplicates(docs)


@pytest.mark.parametrize("spread, block", [(30, (1 << 19, 2048)), (150, (1200, 8))])
def test_op1_open_regions_lose_no_link(spark, monkeypatch, spread, block):
    # a chain of texts in which only neighbours are linked, in one block and in many
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block[0])
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block[1])
    text, r, rows = words(150, 11), random.Random(11), []
    for i in range(80):
        text = list(text)
        for at in r.sample(range(spread), 2):
            text[at] = f"y{r.random()}"
        rows.append((i, " ".join(text)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(rows).items()} and len(set(got.values())) == 1


def test_op1_family_of_20000_around_one_text(spark):
    # each is linked with the first text alone, none of those with four changes with any other
    base, r = words(150, 7), random.Random(7)

    def changed(n):
        t = list(base)
        for at in r.sample(range(5, 145, 5), n):
            t[at] = f"x{r.random()}"
        return " ".join(t)

    rows = [(0, " ".join(base)), *((i, changed(2)) for i in range(1, 20_000)), *((i, changed(4)) for i in range(20_000, 20_040))]
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(got[i] == 0 for i in range(20_000)) and all(got[i] == i for i in range(20_000, 20_040))


def test_op1_regular_words_do_not_collide(spark):
    # a Thue-Morse word and its complement level out any polynomial modulo a power of two
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    w = common.Words(*common.text_buffers(pa.array([one, other])))
    assert w.hash[0] != w.hash[1]
    rows = [(1, " ".join([one] * 9)), (2, " ".join([other] * 9))]
    assert {x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}


def test_op1_repeated_ids(spark):
    a, b = words(100, 1), words(100, 2)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b[:-1])), (3, " ".join(a)), (None, " ".join(b)), (None, "zz yy"), (None, "zz yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True)]))
    # columns of the operator's own names are left as they are; one row of each group stays
    kept = minhash.keep_one_each(df.withColumn("key", F.lit(1)).withColumn("root", F.lit("r"))).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(str(x) for x in [rows[0], rows[1], rows[5]]) and {(r.key, r.root) for r in kept} == {(1, "r")}


def test_op1_edges(spark):
    rows = minhash.near_duplicates(odd_docs(spark)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 14 and [got[i].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert {got[i].component_id for i in (5, 6, 7, 8)} == {5} and got[None].component_id is None and got[None].kept  # nothing like it has an id
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_op2(spark):
    rows = {r.doc_id: r for r in lines.judge_lines(odd_docs(spark)).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept and rows[5].kept and rows[9].n_words == 30_000
    assert lines.line_fails("Home | About | Shop | Help") == "navigation" and lines.line_fails("All rights reserved.") == "boilerplate"
    assert lines.line_fails("THE!! AND!! OF!!") == "punctuation" and lines.line_fails("go " * 9) == "repetition" and lines.line_fails("A fine line.") is None
    assert lines.clean_text("Good line here.\nx | y | z | w\nNo end to it")[0] == "Good line here."
    for text in ("Released under the MIT License.", "Todos los derechos reservados.", "Tous droits réservés.", "Alle Rechte vorbehalten.", "Política de privacidad.", "Datenschutzerklärung."):
        assert lines.line_fails(text) == "boilerplate", text
    assert lines.line_fails('He said "yes." ') is None and lines.line_fails("An end without a mark") == "punctuation"
    assert "clean_text" not in lines.judge_lines(odd_docs(spark), with_text=False).columns and len([r for r in lines.judge_lines(odd_docs(spark).unionByName(odd_docs(spark))).collect() if r.doc_id == 5]) == 4
    assert lines.judge_lines(empty_docs(spark)).count() == 0


def test_op3(spark):
    urls_ = [None, "", "nope", "http://A.example.NET/en/1?x", "https://b.org/fr/2", "https://xorg/fr/2", "http://c.example.com/de/", "http://d.net", "http://d.net/x#y", "https://h.com/q/1.html"]
    rows = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert [rows[i].rule for i in range(10)] == [None, None, None, "example.net/en/", "org/fr/", None, "example.com/de/", None, "net/", None]
    assert rows[3].host == "a.example.net" and rows[3].path == "/en/1" and rows[0].host == "" and rows[9].template.endswith(".html")
    rules = [("s.com", "/bad/1", "block"), ("s.com", "/ok/1", "allow"), ("s.com", "/ok/2", "allow"), ("t.com", "/a/x/", "block"), ("u.com", "/en/", "block"), ("u.com", "/fr/", "allow")]
    # a branch with bad labels and one with good ones are told apart, at any depth
    shop = [f"http://s.com/{branch}/{i}" for branch in ("bad", "ok") for i in range(40)]
    # planted: unlabelled siblings of a bad branch are judged like it, several levels down
    deep = [f"http://t.com/a/{x}/b/c/d/e/f/g/{i}.html" for x in "xyz" for i in range(20)]
    # siblings that disagree leave a third one open; a host without labels is allowed
    open_ = [f"http://u.com/{x}/{i}" for x in ("en", "fr", "de") for i in range(30)] + [f"http://v.com/{i}" for i in range(30)]
    given = [*shop, *deep, *open_, *open_[:3], "http://w.com/" + "long/" * 3000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = {given[r.page_id]: r for r in urls.judge_urls(df, rules).collect()}
    assert {got[u].verdict for u in shop[:40]} == {"block"} and {got[u].verdict for u in shop[40:]} == {"allow"}
    assert {got[u].verdict for u in deep} == {"block"} and len({got[u].template for u in deep}) == 3 and all(got[u].rule is None for u in deep[20:])
    assert {got[u].verdict for u in open_ if "/en/" in u} == {"block"} and {got[u].verdict for u in open_ if "u.com/fr/" in u or "v.com" in u} == {"allow"}
    assert got[given[-1]].verdict == "allow" and len(got[given[-1]].template) > 14_000
    assert urls.judge_urls(df).count() == len(given)
    # names that vary are one template
    names = [(i, f"http://n.com/user/{''.join(random.Random(i).choices('abcdef', k=9))}") for i in range(30)]
    assert {r.template for r in urls.judge_urls(spark.createDataFrame(names, "page_id long, url string")).collect()} == {"/user/*"}
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_op3_blocks_pages_without_a_rule(spark):
    rows = urls.judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_op4_edges_and_ties(spark):
    rows = [(0, [0.5, -0.25]), (50, [1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, []), (7, [1e7, -1e7]), (None, [1.0]), (8, [-3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i in (0, 50, 1, 2, 7, 8)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for q in (0, 50):
        best = sorted((-dot(fine[q], v), i) for i, v in fine.items() if i != q)[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, 50, 3).collect())) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    # rows of one id are one query and one candidate
    twice = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.5, 0.0]), (1, [0.25, 0.75]), (2, [0.0, 0.5]), (2, [0.0, 0.5])]
    got = topk.top_k(spark.createDataFrame(twice, "vec_id long, embedding array<double>").withColumn("block", F.lit("b")).withColumn("score", F.lit(1)), 50, 3).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 1, 192 * 256), (50, 2, 2, 128 * 256)]


def test_op4_prunes(spark):
    e = np.array([r.v for r in topk.scaled(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).orderBy("vec_id").collect()], dtype=np.int64)
    q, other = e[::50], np.ones((len(e[::50]), len(e)), dtype=bool)
    other[np.arange(len(q)), np.arange(len(q)) * 50] = False
    score = np.where(other, q @ e.T, np.iinfo(np.int64).min)
    limits = np.sort(score, axis=1)[:, -5]
    rows, cols, found, opened = topk.survivors(q, e, limits, other, np.linspace(0, 64, topk.LISTS + 1).astype(int))
    assert opened < 0.05 * score.size
    best = topk._top(rows, cols, found, 5)
    want = sorted((i, j) for i in range(len(q)) for j in np.lexsort((np.arange(len(e)), -score[i].astype(float)))[:5])
    assert sorted(zip(rows[best].tolist(), cols[best].tolist())) == [(i, int(j)) for i, j in want] and (found == score[rows, cols]).all()


def test_op4_groups_hold_candidates_once(spark, monkeypatch):
    """Queries are dealt to groups of candidates, not to each of their blocks; equal vectors are one; also repeated ids and very large components."""
    rng = np.random.default_rng(4)
    m = rng.integers(-40, 40, (1500, 6)) / 256
    m[300:900] = m[7]  # one vector very often
    m[:, 0] *= np.where(np.arange(1500) % 400 == 0, 1e7, 1)
    rows = [(int(i) // 2 * 2, x[: 3 + i % 4].tolist()) for i, x in enumerate(m)]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 32)
    monkeypatch.setattr(topk, "GROUPS", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "ROWS_AT_ONCE", 3)
    taken, score = [], topk._score
    monkeypatch.setattr(topk, "_score", lambda rows, *a: taken.append(rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("values")).alias("b")).collect()) or score(rows, *a))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, 50, 5).collect()))
    fine = [(i, np.pad(np.floor(256 * np.array(v)).astype(np.int64), (0, 6 - len(v)))) for i, v in rows]
    want = []
    for q in {i for i, _ in fine if i % 50 == 0}:
        best = {}
        for i, v in fine:
            if i != q:
                best[i] = max([best.get(i, -(1 << 62)), *(int(v @ x) for j, x in fine if j == q)])
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:5])]
    assert got == sorted(want)
    different = len({tuple(v) for _, v in rows})
    assert len(taken) == 2 and different < 1000
    for parts in taken:
        n = {r.kind: r.n for r in parts}
        assert n[0] == -(-different // 32) and n[1] <= 8 * 4  # each vector once; the 4 or so blocks of queries for at most 8 groups


def test_op5_pages():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=x>Menu one</a></ul></nav>
    <div class="cookie-notice">We use cookies, please accept them all.</div><form><label>Name</label><input></form>
    <div class="wrap"><div class="post-body"><h2>Head&amp;line</h2><p>First   paragraph, with <b>bold</b> &lt;text&gt; and more words in it.<p>Second one, with<br>a break.
    <script>var s = "<p>no</p>";</script><ul><li>Point one, listed.<li>Point two, listed.</ul></div>
    <div id="comments"><p>I am a reader, and I disagree strongly with this text.</p></div></div>
    <aside><p>Related things, here.</p></aside><footer>Copyright.</footer>"""
    assert html.main_text(page).split("\n") == ["Head&line", "First paragraph, with bold <text> and more words in it.", "Second one, with a break.", "Point one, listed.", "Point two, listed."]
    for text in (None, "", "<p", "<!-- only", "<nav>x</nav>"):
        assert html.main_text(text) == ""
    assert html.main_text("plain text") == "plain text"


def test_op5_article_in_several_containers():
    long = "A sentence of the article goes on, and on. " * 8
    first, second = [f"{i} {long}".strip() for i in range(6)], [f"{i} {long}".strip() for i in range(6, 9)]
    points = [f"Point {i}" for i in range(4)]
    text = ["The title", *first, "A heading", *points, *second]
    p = lambda rows: "".join(f"<p>{x}</p>" for x in rows)
    rest = f"<h2>A heading</h2><ul>{''.join(f'<li>{x}</li>' for x in points)}</ul>{p(second)}"
    nav, foot = "<nav><a href=x>Menu</a></nav><div class=sidebar><p>Aside</p></div>", "<footer>Foot</footer>"
    for kind in ("section", "div"):
        for around in ("article", "main", "div"):
            page = f"<body>{nav}<{around}><h1>The title</h1><{kind}>{p(first)}</{kind}><{kind}>{rest}</{kind}></{around}>{foot}"
            assert html.main_text(page).split("\n") == text
    page = f"<body>{nav}<article><h1>The title</h1><div>{p(first)}{rest}</div></article>{foot}"
    assert html.main_text(page).split("\n") == text


def test_op5_odd_markup():
    long = "A sentence of the article goes on, and on. " * 8
    para = f"<p>{long}</p>"
    # an article's own section is kept whatever its class; the same word on a list of links isn't
    page = f"<article>{para}<section class='related-work'><h2>Related work</h2>{para}{para}</section><div class='related'><a href=a>One</a> <a href=b>Two</a></div><div class=comments>{para}</div></article>"
    assert html.main_text(page).split("\n") == [long.strip(), "Related work", long.strip(), long.strip()]
    assert html.main_text('<body><p class="x>Hello there, reader of all this.</p>') == "Hello there, reader of all this."
    assert html.main_text("<p class='x>Hello, it goes on.") == "Hello, it goes on."
    # an article whose paragraphs share their path with a long notice before it
    page = f"<body><div><p>{long[:200]}</p></div><main><h1>Title</h1>{para * 4}</main>"
    assert html.main_text(page).split("\n") == ["Title", *[long.strip()] * 4]


def test_op5_deep_pages_take_linear_time():
    import time

    def seconds(n):
        page = "<div>" * n + "<p>Some text, at the bottom of it all.</p>" + "</div>" * n + "<b>" * n + "</i>" * n
        began = time.perf_counter()
        assert html.main_text(page) == "Some text, at the bottom of it all."
        return time.perf_counter() - began

    seconds(100)
    assert seconds(32_000) < 16 * max(seconds(4000), 0.01)


def test_op5_equals_the_articles_of_all_pages(spark):
    # an independent reading: the standard library's parser, blocks inside article
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self, page):
            super().__init__(convert_charrefs=True)
            self.depth, self.blocks = 0, [""]
            self.feed(page)
            self.close()

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag == "br":
                self.handle_data(" ")
            elif tag in html.BLOCK:
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag in html.BLOCK:
                self.blocks.append("")

        def handle_data(self, data):
            if self.depth > 0:
                self.blocks[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "html").limit(600).collect()
    differ = [r.page_id for r in pages if html.main_text(r.html) != "\n".join(filter(None, (" ".join(b.split()) for b in Article(r.html or "").blocks)))]
    assert not differ, differ[:5]


def test_op5_rows(spark):
    rows = [(1, "u", "<p>One, two, three and more.</p>"), (1, "u", "<p>One, two, three and more.</p>"), (None, None, None), (2, "v", "<article><p>" + "word, " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    assert sorted(r.n_chars for r in html.extract_text(df).collect()) == [0, 25, 25, 1_199_999]


def test_op5_table(spark):
    rows = html.extract_text(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    assert len(rows) == 250 and all(r.n_chars == len(r.text) and r.text and "©" not in r.text for r in rows)
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op6_gradients():
    none = np.arange(4, dtype=np.uint64)
    m = toxicity.Model(none, none, np.zeros(4, np.float32), np.zeros(4, np.float32))
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    x, win = np.random.default_rng(0).standard_normal((6, 2 * toxicity.VECTOR)), np.random.default_rng(1).integers(0, 6, (3, toxicity.WINDOW))
    _, cache = m.forward(x.astype(np.float32), win, True)
    g, dx = m.backward(x.astype(np.float32), win, cache, np.ones(3, np.float32))
    for name in ("recf", "inb", "w1", "out"):
        flat, at = m.p[name].reshape(-1), 3
        old, e = flat[at], 1e-2
        flat[at] = old + e
        up = m.forward(x, win).sum()
        flat[at] = old - e
        down = m.forward(x, win).sum()
        flat[at] = old
        assert abs((up - down) / (2 * e) - g[name].reshape(-1)[at]) < 2e-3 + 0.02 * abs(g[name].reshape(-1)[at]), name


def test_op6_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scores = queries.op6_recurrent_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "toxic").toPandas().sort_values("score")
    rank = np.arange(len(scores))
    y = scores.toxic.to_numpy() == 1
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.9, auc


def test_op6_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd_docs(spark), labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in toxicity.toxicity(odd_docs(spark), labels.where("toxic = 0")).collect()] == [0.0] * 14
    assert toxicity.toxicity(empty_docs(spark), labels).count() == 0


TRICKY = [None, "", " ", "a  b", "a   b", " a", "a ", "x \ny", "x\n y", "x\n\n\ny", "a\t\n\tb c", "<|endoftext|> hi", "it's  ok", "été 12 3,4", "a　b, c.\nD e.", "a.\nb, it's.", "word " * 300]


def test_encoder_equals_the_library():
    c = tokens.coder(tokens.vocabulary_path())
    ids, off = c.encode(pa.array(TRICKY))
    for k, t in enumerate(TRICKY):
        assert ids[off[k] : off[k + 1]].tolist() == c.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], t


def test_op7_store_has_stripes_indexes_and_bloom_filters(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    tokens.write_store(docs, path, tokens.vocabulary_path(), 2, 64 << 10)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stripes = 0
    for f in sorted(tmp_path.glob("store/*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        stripes += reader.getStripes().size()
        assert reader.getRowIndexStride() == 1000
        footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
        kinds = {footer.getStreams(k).getKind().toString() for k in range(footer.getStreamsCount())}
        assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)
        assert any(footer.getColumns(k).getKind().toString() == "DIRECT_V2" for k in range(footer.getColumnsCount()))
    assert stripes >= 2
    one = tokens.read_store(spark, path).where("doc_id = 777")
    assert len(one.collect()) == 1 and "EqualTo(doc_id,777)" in one._jdf.queryExecution().toString()


def _ids(docs):
    t = tokens.coder(tokens.vocabulary_path()).tokenizer
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in docs]


def test_op7_round_trip(spark, docs):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_orc_tokens(spark, DATA).collect()}
    at, want = 0, {}
    for i, ids in sorted(_ids(docs)):
        want[i] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert got == want
    store = tokens.token_store(odd_docs(spark), tokens.vocabulary_path(), 4)
    rows = store.where("doc_id = 9").collect()
    assert len(rows) == 1 and rows[0].ids[-1] == 0 and store.count() == 14
    assert tokens.digest(tokens.token_store(empty_docs(spark), tokens.vocabulary_path())).count() == 0


def test_op8_equals_brute_force(spark, docs):
    got, want = brute.spans_words(queries.op8_suffix_array(spark, DATA).collect()), brute.repeated_words(docs)
    for a, b in zip(got, want):
        assert {k: v for k, v in a.items() if v} == {k: v for k, v in b.items() if v}


def test_minimisers_are_window_minima():
    x = np.random.default_rng(2).integers(0, 9, 200).astype(np.uint64)
    want = sorted({max(k for k in range(i, i + 7) if x[k] == min(x[i : i + 7])) for i in range(194)})
    pos, least, most = suffix.marked(x, 7)
    assert pos.tolist() == want
    assert [p - a for p, lo, hi in zip(pos, least, most) for a in range(hi, lo - 1, -1)] == list(range(194))


def test_op8_survives_colliding_anchors(spark, docs, monkeypatch):
    # sixteen different anchors only: positions pile up, but runs are told apart by their words
    plain = suffix.long_gram_hashes
    monkeypatch.setattr(suffix, "long_gram_hashes", lambda w, k: plain(w, k) & np.uint64(15))
    some = docs[:300]
    df = spark.createDataFrame(some, "doc_id long, text string")
    positions = suffix.suffix_positions(df.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("t"), "text"))
    assert positions.select("anchor").distinct().count() > 0
    got, want = brute.spans_words(suffix.repeated_spans(df).collect()), brute.repeated_words(some)
    for a, b in zip(got, want):
        assert {k: v for k, v in a.items() if v} == {k: v for k, v in b.items() if v}


def test_op8_common_words_and_long_words():
    assert suffix.common_words([b"a b c ", b"a b d ", b"a bb d ", b"a bb d e "]).tolist() == [2, 1, 3]
    texts = ["aa  b\n" + "x" * 100 + " c", "dd"]
    words, at = suffix.plain_words(common.Words(*common.text_buffers(pa.array(texts)), hashed=False))
    pieces = [words[x:y] for x, y in zip(at, at[1:])]
    assert pieces[0] == b"aa " and pieces[1] == b"b " and len(pieces[2]) == 50 and pieces[3:] == [b"c ", b"dd "]


def test_op8_edges_and_cut(spark):
    rows = {(r.doc_id, r.start_word, r.end_word, r.removed) for r in suffix.repeated_spans(odd_docs(spark)).collect()}
    assert (8, 0, 120, True) in rows and (5, 0, 120, False) in rows and (11, 70, 125, True) in rows
    kept = {r.doc_id: r.text for r in suffix.remove_repeats(odd_docs(spark).where("doc_id <> 5 or source <> 'c'")).collect()}
    assert 8 not in kept and kept[5] == odd_texts()[5] and kept[11].split() == words(70, 3) and kept[0] is None
    assert suffix.repeated_spans(empty_docs(spark)).count() == 0


def test_op9(spark, docs):
    ids = dict(_ids(docs))
    rows = queries.op9_bm25_packing(spark, DATA).collect()
    at, fill = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(v) for i, v in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and sum(1024 - f for f in fill.values()) < 0.02 * 1024 * len(fill)
    assert sum(r.length for r in packing.pack_documents(odd_docs(spark), tokens.vocabulary_path()).collect()) == sum(len(v) for _, v in _ids([(r.doc_id, r.text) for r in odd_docs(spark).collect()]))
    assert packing.pack_documents(empty_docs(spark), tokens.vocabulary_path()).count() == 0


def test_op9_neighbours_share_terms():
    a, b = np.arange(100, 400), np.arange(1000, 1300)
    counts = np.full(2000, 4)
    rows = list(packing.pack_shard([a, b, a + 1, b + 1], counts, 1000, 600))
    assert [{k for k, _, _ in r} for r in rows] == [{0, 2}, {1, 3}]


def test_op9_scores_all_terms_and_asks_for_each_seed():
    counts = np.full(3000, 6)
    counts[:8] = 4  # the rarest terms of the seed lead to one tail, all of them to another
    seed, few, many, other = np.arange(100), np.r_[0:8, 2000:2092], np.r_[8:100, 2100:2108], np.arange(2200, 2300)
    shard = packing.Shard([seed, few, many, other], counts, 1000)
    assert shard.neighbours(0, np.array([False, True, True, True])).tolist() == [2, 1]
    # a seed without neighbours is followed by one whose neighbour comes last
    alone, a, b = np.arange(100), np.arange(200, 300), np.arange(400, 500)
    rows = list(packing.pack_shard([alone, a, b, a], counts, 1000, 300))
    assert [[k for k, _, _ in r] for r in rows] == [[0, 1, 3], [2]]


def test_op9_neighbours_equal_plain_bm25():
    r = np.random.default_rng(5)
    tails = [r.integers(0, 60, int(n)) for n in r.integers(5, 40, 50)]
    counts, documents, mean = np.zeros(60, dtype=np.int64), 500, np.mean([len(t) for t in tails])
    for t in tails:
        counts[np.unique(t)] += 1
    shard = packing.Shard(tails, counts, documents)
    for seed in (0, 7, 33):
        scores = {}
        for k, t in enumerate(tails):
            if k != seed:
                tf = {x: int((t == x).sum()) for x in set(tails[seed].tolist()) if (t == x).any()}
                scores[k] = sum(np.log1p((documents - counts[x] + 0.5) / (counts[x] + 0.5)) * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(t) / mean)) for x, f in tf.items())
        unused = np.ones(50, dtype=bool)
        unused[seed] = False
        got = shard.neighbours(seed, unused).tolist()
        assert sorted(got) == sorted(k for k, v in scores.items() if v > 0) and np.allclose([scores[k] for k in got], sorted((v for v in scores.values() if v > 0), reverse=True))


def test_op9_asks_again_for_more(monkeypatch):
    r = np.random.default_rng(8)
    tails = [r.integers(0, 40, int(n)) for n in r.integers(1, 12, 120)]
    whole = list(packing.pack_shard(tails, np.full(40, 30), 500, 200))
    for most in (1, 2, 7):
        monkeypatch.setattr(packing, "MOST", most)
        assert list(packing.pack_shard(tails, np.full(40, 30), 500, 200)) == whole


def test_op9_ties_go_by_position():
    same = np.arange(50)
    shard = packing.Shard([same, same, same, same], np.full(100, 4), 10)
    assert shard.neighbours(1, np.array([True, False, True, True])).tolist() == [0, 2, 3]


def test_op10_fit_equals_brute_force():
    r = random.Random(6)
    for _ in range(200):
        size = np.array(sorted(r.sample(range(1, 60), r.randrange(1, 7))))
        count = np.array([r.randrange(1, 4) for _ in size])
        reach = {0}
        for s, n in zip(size.tolist(), count.tolist()):
            reach = {x + k * s for x in reach for k in range(n + 1)}
        budget = r.randrange(0, int((size * count).sum()) + 3)
        took = mixing.fit(size, count, budget)
        assert (took >= 0).all() and (took <= count).all() and int((took * size).sum()) == max(x for x in reach if x <= budget)
    # one long document among short ones, above the program's range
    size, count = np.array([100, 600_000]), np.array([200, 1])
    assert int((mixing.fit(size, count, 610_000) * size).sum()) == 610_000
    many = np.array([7, 1000, 50_000, 250_000, 900_000])
    assert int((mixing.fit(many, np.array([9, 9, 9, 9, 9]), 3_333_333) * many).sum()) == 66 * 50_000 + 9 * 1007  # nothing comes nearer


def test_op10_null_and_empty_rows(spark):
    rows = [(None, None, None), (None, None, None), (1, "", "a"), (2, "one two", "a"), (2, "one two", "a"), (3, "x " * 50, None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 6 and sum(r.size for r in got if r.source == "a") == 4 and {r.source_size for r in got if r.source is None} == {50}
    assert all(0 <= r.copies <= 3 for r in got)


def test_op10_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = [(None, f"w{i} x y", "a") for i in range(300)] + [(7, f"v{i} x y", "a") for i in range(300)] + [(i, f"u{i} x y", "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    taken = {s: sum(r.copies * r.size for r in got if r.source == s) for s in "ab"}
    assert len(got) == 1200 and taken == {"a": 1200, "b": 2400}
    # 400 of 600 rows of "a": not all of those without an id, nor all of doc_id 7
    for doc in (None, 7):
        assert 150 < sum(r.copies for r in got if r.source == "a" and r.doc_id == doc) < 250
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))


def test_op10(spark):
    rows = queries.op10_budget_mix(spark, DATA).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()}
    taken, goal = {}, {}
    for r in rows:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        goal[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert all(abs(taken[s] - goal[s]) <= max(2, 0.002 * goal[s]) for s in goal)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op10_budget_mix(spark, DATA).collect()))


def test_op10_targets_and_fit(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, None: 500}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (1.0, 2.0, 3.0)).collect()}
    weight, left, want = dict(zip(sorted(s for s in sizes if s), (1.0, 2.0, 3.0))) | {None: 1.0}, dict(sizes), {}
    budget = float(sum(sizes.values()))
    while left:
        level = budget / sum(weight[s] for s in left)
        full = [s for s in left if 3 * left[s] <= level * weight[s]]
        if not full:
            want |= {s: level * weight[s] for s in left}
            break
        for s in full:
            want[s] = 3.0 * left.pop(s)
            budget -= want[s]
    assert got == pytest.approx(want)
    assert mixing.fit(np.array([3, 7]), np.array([5, 5]), 29).tolist() in ([5, 2], ) and mixing.fit(np.array([4]), np.array([3]), 7).tolist() == [1]
    plan = mixing.mix_sources(odd_docs(spark)).collect()
    assert len(plan) == 14 and mixing.mix_sources(empty_docs(spark)).count() == 0


def strange_docs(spark):
    """odd_docs, with rows of one doc_id and different texts, repeated rows, and columns of the stages' own names."""
    more = [(5, "another text of five " * 40, "en", "a", 1), (5, "another text of five " * 40, "en", "a", 1), (10, " ".join(words(70, 3) + words(120, 1)[:55]), "en", "b", 1)]
    docs = odd_docs(spark).unionByName(odd_docs(spark).where("doc_id is null")).select("doc_id", "text", "lang", "source", "n_chars")
    return docs.unionByName(spark.createDataFrame(more, DOCS)).selectExpr("*", *[f"'{n}' as `{n}`" for n in ("row", "key", "cuts", "copies", "doc", "t", "words_left", "cut_text", "__copies", "root", "0", "a.b")])


def test_stages_on_strange_rows(spark):
    from ridgeline.llm import pipeline

    sf = "/root/testdata/sf0.001"
    docs = strange_docs(spark)
    given = docs.collect()
    civil = pipeline.drop_toxic(spark, docs, sf)
    assert civil.columns == docs.columns and civil.count() <= len(given)
    apart = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    wordless = sum(1 for r in given if not (r.text or "").split())
    groups = brute.near_duplicates([(k, r.text) for k, r in enumerate(given)])
    assert len(apart) == wordless + len({c for k, (n, c) in groups.items() if n})
    assert len([t for i, t in apart if i == 5]) == 2 and (None, "no id " * 60) in apart
    cut = pipeline.cut_repeats(spark, docs, sf).collect()
    assert [r for r in cut if r.doc_id == 5 and r.text == odd_texts()[5]] and not [r for r in cut if r.doc_id == 8] and all(r["a.b"] == "a.b" for r in cut)
    assert [r.text.split() for r in cut if r.doc_id == 11 or r.doc_id == 10 and r.text and len(r.text) > 50] in ([words(70, 3)], [words(70, 3) + words(120, 1)[:55]])
    mixed = pipeline.mix(spark, docs, sf).collect()
    plan = mixing.mix_sources(docs.select("doc_id", "text", "source").withColumn("line", F.monotonically_increasing_id()), row="line").collect()
    assert len(plan) == len(given) and len(mixed) == sum(r.copies for r in plan)
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert size(mixed) == sum(r.copies * r.size for r in plan) and {r.text for r in mixed if r.doc_id is None}
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert pipeline.pack(spark, docs, sf).agg(F.sum("length")).first()[0] == sum(len(v) for _, v in _ids([(0, r.text) for r in given]))


def test_rows_without_id_are_judged(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in ((1, "good one"), (2, "bad two"), (None, "good three x"), (None, "bad four"), (2, "good five"))], DOCS)
    assert sorted(r.text for r in mixing.mixed_documents(docs).collect()) == sorted(r.text for r in docs.collect())
    model = toxicity.train([], [])
    monkeypatch.setattr(toxicity, "document_scores", lambda m, texts: np.array([t.startswith("bad") for t in texts.to_pylist()], dtype=float))
    assert len(toxicity.keep_civil(docs, model).columns) == 5


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, columns = docs, docs.columns
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count()
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(c == i for i, (_, c) in brute.near_duplicates(rows).items())
        if name == "suffix_dedup":
            shared, _ = brute.repeated_words([(r.doc_id, r.text) for r in docs.collect()])
            assert sum(map(len, shared.values())) < 0.02 * sum(len((r.text or "").split()) for r in docs.collect())
    assert stages["packing"](spark, docs, sf).agg(F.sum("length")).first()[0] == sum(len(v) for _, v in _ids([(0, r.text) for r in docs.collect()]))
    assert stages["near_dedup"](spark, start.limit(0), sf).count() == 0
