import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from citeloom.llm.wrappers import OPTIONAL, REPEATED, SLOT, _hash, _hosted, common_names, expression, extract, infer_wrappers, layouts, merge, parse, slots, wrapper_of

SCHEMA = "page_id long, url string, html string"


def shape(*pages):
    out = None
    for p in pages:
        w = wrapper_of(parse(p))
        out = w if out is None else merge(out, w)
    return expression(out)


def test_alignment():
    assert shape("<div>a</div>") == "<div>{#}"
    assert shape("<ul><li>a<li>b<li>c</ul>") == "<ul>{<li>{#}+}"
    assert shape("<h1>t</h1><p>a</p>", "<h1>t</h1><p>b<p>c") == "<h1>{#} <p>{#}+"
    assert shape("<h1>t</h1><p>a</p>", "<h1>t</h1><div>x</div><p>b</p>") == "<h1>{#} <div>{#}? <p>{#}"
    assert shape("<h1>t</h1><p>a</p>", "<p>b</p><div>x</div>") == "<h1>{#}? <p>{#} <div>{#}?"
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl>{(<dt>{#}? <dd>{#}?)+}"
    assert shape("<h2>a</h2><p>b</p>", "<h2>a</h2><p>b</p><h2>a</h2><p>b</p><p>c</p>") == "(<h2>{#}? <p>{#}?)+"
    assert shape("<h2>a</h2><p>b</p><ul>x</ul>", "<p>b</p><h2>a</h2><ul>x</ul>") == "(<h2>{#}? <p>{#}?)+ <ul>{#}"  # they cross
    assert shape("<h2>a</h2><div>i</div><p>b</p>", "<h2>a</h2><p>b</p><h2>c</h2>") == "(<h2>{#}? <div>{#}? <p>{#}?)+"
    assert shape("<p>a</p>", "") == shape("", "<p>a</p>") == "<p>{#}?"
    assert shape('<div class="b a1" id=x>t</div>') == "<div[c=a0 c=b i=x]>{#}"


def accepts(items, kids):
    """Whether the expression accepts a sequence of kids, by trying every way."""
    seen = set()

    def go(i, k):
        if (i, k) in seen:
            return False
        seen.add((i, k))
        if i == len(items):
            return k == len(kids)
        item = items[i]
        if item[1] & OPTIONAL and go(i + 1, k):
            return True
        if item[0] == "(":
            members = {m[0]: m for m in item[3]}
            j = k
            while j < len(kids) and head(kids[j]) in members and one(members[head(kids[j])], kids[j]):
                j += 1
                if go(i + 1, j):
                    return True
            return go(i + 1, k)
        j = k
        while j < len(kids) and head(kids[j]) == item[0] and one(item, kids[j]):
            j += 1
            if go(i + 1, j):
                return True
            if not item[1] & REPEATED:
                break
        return False

    def head(kid):
        return SLOT if isinstance(kid, tuple) else kid[0]

    def one(item, kid):
        return item[0] == SLOT or accepts(item[3], kid[1])

    return go(0, 0)


def test_wrappers_accept_their_pages_in_any_order_of_alignment():
    rnd = random.Random(6)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1) if depth < 2 and t in ('div', 'section') else rnd.randrange(9)}</{t}>" for t in (rnd.choice(("div", "section", "p", "h2", "ul")) for _ in range(rnd.randrange(6))))

    for _ in range(150):
        trees = [parse(page()) for _ in range(5)]
        parts = [wrapper_of(t) for t in trees]
        one = parts[0]
        for p in parts[1:]:
            one = merge(one, p)
        two = merge(merge(parts[4], parts[3]), merge(merge(parts[2], parts[0]), parts[1]))
        for w in (one, two):
            assert all(accepts(w[3], t[1]) for t in trees)
            paths = [s[0] for s in slots(w)]
            assert len(paths) == len(set(paths)) and sum(s[4] for s in slots(w)) == sum(len(x) for t in trees for x in re.findall(r"\((?:'|\")(.*?)(?:'|\"), 0\)", str(t)))


def test_long_pages_align_in_linear_time():
    flat = "".join(f"<{t}>x</{t}>" for _ in range(20_000) for t in ("p", "h2", "ul", "div", "pre"))
    began = time.time()
    w = merge(wrapper_of(parse(flat)), wrapper_of(parse(flat[12:])))
    assert time.time() - began < 30 and len(json.dumps(w)) < 3000


def test_texts_of_a_tree():
    assert parse("x <b>y</b>&amp;\n z<br>w<p>a<p>b") == ["", [("x y& z w", 0), ["p", [("a", 0)]], ["p", [("b", 0)]]]]
    assert parse("<p>1 < 2<script>var p='</p>'</script> &lt;p&gt; <!-- <p> -->c</p") == ["", [["p", [("1 < 2 <p> c", 0)]]]]
    assert parse("<table><tr><td>a<td>b<tr><td>c</table>d") == ["", [["table", [["tr", [["td", [("a", 0)]], ["td", [("b", 0)]]]], ["tr", [["td", [("c", 0)]]]]]], ("d", 0)]]
    deep = parse("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y</p>")
    assert deep[1][-1] == ["p", [("y", 0)]]


PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{x}}</style></head><body><header><p>Site {t}</p></header>
<nav><ul><li><a href="/">home</a></li><li><a>{t}</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>{t}</h1></header>{body}<div class="ad">Buy {t}</div><div id="comments"><p>first! {t}</p></div></article>
<aside>More</aside><form><p>mail</p></form><footer>&copy; x</footer>"""


def test_main_text(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta".split()) + str(rnd.randint(0, 99))
    rows, want = [], {}
    for i in range(60):
        paragraphs = [" ".join(word() for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 5))]
        title = word()
        body = "".join(rnd.choice(("<p>{}</p>", "<p>{}", "<p>\n{}\n</p>\n", "<p><b>{}</b><br>")).format(p.replace(" ", " \n ", 1)) for p in paragraphs)
        rows.append((i, f"https://h{i % 3}.example/a/{i}", PAGE.format(t=title, body=body)))
        want[i] = "\n".join([title, *paragraphs])
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: (r.text, r.n_chars) for r in extract(frame.repartition(7)).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert got == {r.page_id: (r.text, r.n_chars) for r in extract(frame.coalesce(1)).collect()}


def test_pages_without_an_article(spark):
    body = "<div id=top><a>home</a> <a>news</a></div><div id=text><p>{0} one long paragraph of the text &eacute;</p><p>{0} two and more of it</p></div><div class=sidebar><p>{0} side</p></div>"
    rows = [(i, "http://x.example/", f"<html><body>{body.format(i)}") for i in range(5)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"{i} one long paragraph of the text é\n{i} two and more of it" for i in range(5)}


def test_template_text_goes_unless_all_pages_are_copies(spark):
    page = "<div class=text><p>{}</p></div><div class=app><p>Read on in the app</p></div>"
    rows = [(i, "http://a.example/", page.format(f"text {i} " * 9)) for i in range(9)] + [(20 + i, "http://b.example/", page.format("copy of a text")) for i in range(9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in extract(frame).collect()}
    assert all(got[i] == ("text %d " % i * 9).strip() for i in range(9))
    assert all(got[20 + i] == "copy of a text\nRead on in the app" for i in range(9))
    alone = {r.page_id: r.text for r in extract(frame, aligned=False).collect()}
    assert all(alone[i] == ("text %d " % i * 9).strip() + "\nRead on in the app" for i in range(9))


def test_nothing_inside_an_article_goes(spark):
    """However often a heading or line is there, and whatever the words in its class are about."""
    page = "<body><div><p>Read on in the app</p></div><article><h2>Ingredients</h2><p>text {0}</p><div class='social-history'><p>a {0}</p></div><p class=tags>b {0}</p><div class='share-price'><p>same</p></div></article>"
    for n in (1, 7, 8, 40):
        rows = [(i, "http://a.example/", page.format(i)) for i in range(n)]
        got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {i: f"Ingredients\ntext {i}\na {i}\nb {i}\nsame" for i in range(n)}


def test_planted_templates(spark):
    """Hosts of planted templates: constant, link and varying parts in containers without telling names, some parts optional."""
    rnd = random.Random(12)
    rows, want = [], {}
    for host in range(6):
        tags = rnd.sample(["div", "section", "center"], 3)
        constant = [f"constant words {host} {k} of the site" for k in range(3)]
        for i in range(30):
            said = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(4, 30))) for _ in range(rnd.randint(1, 6))]
            body = "".join(f"<p>{t}</p>" if rnd.random() < 0.8 else f"<h3>{t}</h3>" for t in said)
            links = "".join(f"<li><a href=x>link {rnd.randrange(99)}</a>" for _ in range(rnd.randint(1, 9)))
            option = f"<blockquote>{constant[1]}</blockquote>" if host % 2 else ""
            page = f"<html><body><{tags[0]} class=a><p>{constant[0]}</p></{tags[0]}>{'<ul class=l>' + links + '</ul>' if i % 4 else ''}<{tags[1]} class=b>{body}</{tags[1]}>{option}<{tags[2]} class=c>{constant[2]}</{tags[2]}>"
            rows.append((100 * host + i, f"http://h{host}.example/{i}", page))
            want[100 * host + i] = "\n".join(said)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r.page_id: r.text for r in extract(frame.repartition(7)).collect()} == want
    assert {r.page_id: r.text for r in extract(frame.coalesce(1)).collect()} == want
    alone = {r.page_id: r.text for r in extract(frame, aligned=False).collect()}
    assert not any(alone[k] == v for k, v in want.items())
    hosted = _hosted(frame)
    w = {r.host: expression(json.loads(r.wrapper)) for r in infer_wrappers(hosted, common_names(hosted)).collect()}
    assert len(w) == 6 and all("<ul[c=l]>{<li>{#}+}?" in x for x in w.values())


def test_layouts_and_slugs_on_one_host(spark):
    slug = lambda i: "".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7, 11))
    kinds = [
        '<body class="post-{s}"><article id="{s}"><p>{t}</p></article><div><p>side {t}</p></div>',
        '<body class="page-{s}"><main><div id="{s}"><p>{t}</p></div></main>',
        '<body id="{s}"><div class="top"><a>home</a> <a>news</a></div><div class="intro {s}"><p>intro {t}</p></div><div class="body {s}"><p>{t} {t}</p><ul><li><a>{t}</a></ul></div>',
        "<body><article class=lead><p>lead {t}</p></article><article class=rest><p>{t}</p></article>",
    ]
    want = ["{t}", "{t}", "intro {t}\n{t} {t}\n{t}", "lead {t}\n{t}"]
    for url in ("http://x.example/{}", None, "relative/{}"):
        rows = [(i, url and url.format(i), "<html>" + kinds[i % 4].format(s=slug(i), t=f"text of page {i}")) for i in range(80)]
        got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
        assert got == {i: want[i % 4].format(t=f"text of page {i}") for i in range(80)}


def test_what_is_known_of_a_host_is_bounded(spark):
    n = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    html = F.concat(F.lit('<body class="p-'), n, F.lit('"><div id="s-'), n, F.lit('"><p>text of it '), n, F.lit("</p></div>"))
    size = lambda k: layouts(_hosted(spark.range(k).select(F.col("id").alias("page_id"), F.lit("http://x.example/").alias("url"), html.alias("html")))).toPandas().fillna("").map(len).to_numpy().sum()
    assert size(3000) == size(300) < 200


def test_template_is_found_under_slugs(spark):
    rows = [(i, "http://x.example/", f'<body class="{chr(97 + i)}x"><div id="{chr(97 + i)}y"><p>text {i} ' + "of it " * 9 + "</p></div><div class=app><p>Read on in the app</p></div>") for i in range(12)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (f"text {i} " + "of it " * 9).strip() for i in range(12)}


def test_copies_keep_their_own_paths(spark):
    page = "<article><p>{}</p>{}</article>"
    rows = [(i, "http://x.example/", page.format(f"text {i} and more", "")) for i in range(9)]
    rows += [(100 + i, "http://x.example/", page.format("copied text", "<blockquote>said once</blockquote>")) for i in range(20)]
    rows += [(200 + i, "http://x.example/", page.format(f"text {i} of a section", "<h3>Section</h3>")) for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(got[100 + i] == "copied text\nsaid once" for i in range(20))
    assert all(got[200 + i] == f"text {i} of a section\nSection" for i in range(8))


def test_words_in_names_of_outer_elements(spark):
    outer = ['<body class="has-sidebar">{}', '<html class="no-comments"><body id=search>{}', '<body><main id="search-guide">{}</main>', '<body><article class="legal-news">{}</article>', '<body><div class="content no-comments">{}</div>', '<body><article class="related">{}</article>']
    inner = "<p>text {0} of page {0}</p><div class=site-footer><p>foot {0}</p></div><div id=comments><p>first {0}</p></div><div class=cookie-notice>we {0}</div>"
    rows = [(10 * k + i, f"http://h{k}.example/", o.format(inner.format(i))) for k, o in enumerate(outer) for i in range(3)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {p: f"text {p % 10} of page {p % 10}" for p, _, _ in rows}


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r for r in extract(pages).collect()}
    assert len(rows) == pages.count()
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        plain = "".join(re.sub(r"<[^>]+>", "", article).replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").replace("&#x27;", "'").split())
        assert "".join(rows[p.page_id].text.split()) == plain and rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_edges(spark):
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [(1, "http://a.b/", None), (2, None, ""), (3, "relative", "<p>x"), (3, "relative", "<p>x"), (4, "http://u@A.b:80/z?q", long), (None, "//c.d", "<article>y")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract(frame).collect()), key=str)
    assert [(p, t[:9], n) for p, t, n in got] == [(0, "y", 1), (1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1), (4, "word word", 499_999)]
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []


def _texts(spark, htmls, host="news.example"):
    rows = [(i, f"https://{host}/{i}", h) for i, h in enumerate(htmls)]
    return [r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def _story(i, extra=""):
    return f"<div class='story'><p>Story {i} begins with a long sentence about river {i * 7}.</p><p>It goes on with more words of its own, {i}.</p></div>{extra}"


def test_a_teaser_does_not_empty_the_page(spark):
    teaser = "<article class='card'><a href='/x'>Other story</a> teaser</article>"
    for n in (1, 12):
        for i, text in enumerate(_texts(spark, [f"<html><body>{_story(k, teaser)}</body></html>" for k in range(n)])):
            assert f"Story {i} begins with a long sentence about river {i * 7}." in text and f"It goes on with more words of its own, {i}." in text


def test_hosts_of_few_and_many_pages_are_read_alike(spark):
    page = lambda k: f"<html><body><div class='top'><p>Example Daily Site</p></div>{_story(k)}<div class='end'><p>All rights reserved by the Example Daily company.</p></div></body></html>"
    want = "Story 0 begins with a long sentence about river 0.\nIt goes on with more words of its own, 0."
    for n in (2, 3, 7, 8, 12):
        assert _texts(spark, [page(k) for k in range(n)])[0] == want


def test_marks_count_at_any_depth(spark):
    for depth in (50, 99, 100, 150):
        html = "<article>" + "<div>" * depth + "<nav>MENU <div class='x'>deep</div></nav><p>Kept text.</p><div class='cookie-banner'><div>notice</div></div><p>And this.</p>" + "</div>" * depth + "<p>End.</p></article>"
        assert "MENU" not in (text := _texts(spark, [html])[0]) and "notice" not in text and "deep" not in text
        assert " ".join(text.split()) == "Kept text. And this. End."


def test_formulas_and_bylines_stay(spark):
    html = "<article><address>Written in Lima</address><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='TeX'>x=1</annotation></math> be positive.</p></article><address>Imprint</address>"
    assert _texts(spark, [html])[0] == "Written in Lima\nLet x=1 be positive."


def test_shares_of_a_host_are_counted_on_all_its_pages(spark):
    """A share of the main texts with the smallest hashes says nothing of all, whichever pages lack the line."""
    slot = "<div class=app><p>Read on in the app</p></div>"
    texts = sorted((f"text {i} " + "of it " * 9 + "end" for i in range(300)), key=_hash)
    page = lambda t, has: f"<div class=text><p>{t}</p></div>{slot if has else ''}"
    without = {"most": set(texts[:20]), "some": set(texts[-45:]), "edge": set(texts[:30]), "below": set(texts[-31:])}
    rows = [(1000 * k + i, f"http://{h}.example/{i}", page(t, t not in out)) for k, (h, out) in enumerate(without.items()) for i, t in enumerate(texts)]
    rows += [(5000 + i, "http://most.example/", page(texts[0], False)) for i in range(200)]  # copies count once
    rows += [(6000 + i, "http://some.example/", page(texts[0], True)) for i in range(500)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    for k, (h, out) in enumerate(without.items()):
        template = h in ("most", "edge")
        assert all(got[1000 * k + i] == (t if template or t in out else f"{t}\nRead on in the app") for i, t in enumerate(texts)), h
    assert got[5000] == texts[0] and got[6000] == f"{texts[0]}\nRead on in the app"
