import random
import re
from html import unescape

import duckdb

from textloom.llm.html_wrapper import CHROME_WORDS, KEYS_AT_PLACE, _common, _table, aligned, dumps, expression, is_article, is_chrome, loads, main_text, merge, op1_wrapper_inference, parse, role_key, wrapper_of, wrappers
from textloom.llm.html_wrapper import _known

SF = "/root/testdata/sf0.01"


def infer(pages):
    wrapper = wrapper_of(parse(pages[0]))
    for page in pages[1:]:
        wrapper = merge(wrapper, wrapper_of(parse(page)))
    return wrapper


def brute(html):
    """The article of the tables' own pages, by its tag."""
    m = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)
    parts = re.split(r"</?(?:p|h1|article)>", m[1])
    texts = (" ".join(unescape(re.sub(r"<[^<>]*(?:>|$)", " ", x)).split()) for x in parts)
    return "\n\n".join(t for t in texts if t)


def test_all_pages(spark):
    got = {r["page_id"]: r for r in op1_wrapper_inference(spark, SF).collect()}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, url, html in pages:
        want = brute(html)
        assert (got[page_id]["url"], got[page_id]["text"], got[page_id]["n_chars"]) == (url, want, len(want))


def test_wrapper_is_union_free():
    w = infer(["<div><h2>a</h2><p>x</p></div>", "<div><h2>b</h2><p>x</p><p>y</p><hr></div>", "<div><h2>c</h2><ul><li>1<li>2</ul><p>z</p></div>"])
    assert expression(w) == "<div><h2>#</>(<ul>(<li>#</>)+</>)?(<p>#</>)+</>"
    assert dumps(loads(dumps(w))) == dumps(w)
    pairs = infer(["<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>"])
    assert expression(pairs) == "<dl>(<dt>#</><dd>#</>)+</>"


def test_no_article_tag():
    pages = [
        f"<div class=top>Site name</div><div class='c{n}'><div id=links><a href=a>Link {n} aaaaaaaa</a> <a href=b>bbbbbbbbbbbbb</a></div>"
        f"<div><h2>Title {n}</h2><p>{'words of story %d ' % n * 20}</p><p>Second &amp; last, {n}.</p></div></div><div>All rights reserved by us</div>"
        for n in range(8)
    ]
    w = infer(pages)
    for n, page in enumerate(pages):
        want = f"Title {n}\n\n{' '.join(['words of story %d' % n] * 20)}\n\nSecond & last, {n}."
        assert main_text(page, *_known(dumps(w))) == want


def test_chrome_inside_and_around():
    page = (
        "<html><body><header><h1>Site</h1></header><aside>side</aside><form>q<input></form><main><div class='cookie-notice'>cookies</div>"
        "<article class='post'><header><h1>The  title</h1></header><p>One <b>two</b>\n three&nbsp;four.</p><div class=sidebar>no</div>"
        "<nav>menu</nav><!-- <p>gone</p> --><script>var a='<p>no</p>'</script><ul><li>item 1<li>item 2</ul><p class='ad'>buy</p>"
        "<div style='display:none'>hid</div><section id='comments'><p>first!</p></section><footer>tags</footer></article></main><footer>&copy; us</footer>"
    )
    assert main_text(page) == "The title\n\nOne two three four.\n\nitem 1\n\nitem 2"


def test_broken_markup():
    assert main_text("<article><p title='a>b'>x &lt; y &#233;<p>cut <b") == "x < y é\n\ncut"
    assert main_text("<article><p title='lone>text one</p><p>two</p>") == "text one\n\ntwo"
    assert main_text("plain words") == "plain words"
    assert main_text("") == "" == main_text(None)
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert main_text(f"<article>{deep}<p>after</p></article>") == "deep\n\nafter"
    unclosed = "".join(f"<div>t{k} " for k in range(5000))
    assert main_text(f"<article>{unclosed}</article>") == "\n\n".join(f"t{k}" for k in range(5000))
    w = infer([f"<article>{deep}</article>", f"<article>{deep}<p>x</p></article>"])
    assert dumps(loads(dumps(w))) == dumps(w)
    assert main_text("<article>" + "<p>y</p><h3>z</h3><hr>" * 20000 + "</article>").count("y") == 20000


def test_cases(spark, sf_tables):
    schema = "page_id long, url string, html string, host string, wrapper string, text int"
    rows = [
        (1, "https://A.example/x", "<nav>m</nav><article>one</article>", "clash", "clash", 0),
        (1, "https://A.example/x", "<nav>m</nav><article>one</article>", None, None, 0),
        (2, None, None, None, None, None),
        (None, "https://a.example:80/y", "", None, None, None),
        (3, "odd", "<p>alone</p>", None, None, None),
    ]
    got = op1_wrapper_inference(spark, sf_tables(pages=(rows, schema))).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", "one", 3), ("1", "one", 3), ("2", "", 0), ("3", "alone", 5), ("None", "", 0)]
    empty = spark.createDataFrame([], schema)
    assert wrappers(empty).count() == 0


def test_alignment_is_longest_at_every_size():
    rng = random.Random(1)
    for n, m, k in ((5, 7, 3), (90, 80, 4), (150, 400, 9), (300, 299, 2)):
        a, b = [rng.randrange(k) for _ in range(n)], [rng.randrange(k) for _ in range(m)]
        got = aligned(a, b)
        assert len(got) == len(_table(a, b)) == _common(a, b)[-1]
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    a = [rng.randrange(50) for _ in range(10_000)]
    assert aligned(a, a[:5000] + [99] + a[5000:])[-1] == (9999, 10_000)
    assert aligned([1], [2] * 9000 + [1]) == [(0, 9000)] and aligned([], [1]) == []


def test_ten_thousand_siblings_and_long_periods():
    names = ["p", "h2", "h3", "h4", "blockquote"]
    page = "".join(f"<{names[k % 5]}>{k}</{names[k % 5]}>" for k in range(10_000))
    assert expression(wrapper_of(parse(page))) == "(<p>#</><h2>#</><h3>#</><h4>#</><blockquote>#</>)+"
    rng = random.Random(2)
    mixed = [rng.choice(names) for _ in range(10_000)]
    page = "<article>" + "".join(f"<{x}>{k}</{x}>" for k, x in enumerate(mixed)) + "</article>"
    w = infer([page, "<article><p>a</p><h2>b</h2></article>"])
    assert main_text(page, *_known(dumps(w))) == "\n\n".join(map(str, range(10_000)))


def test_every_article_and_telling_words():
    assert main_text("<main><article class=a>part 1</article><div class=ad>buy</div><article class=b>part 2 is longer</article></main>") == "part 1\n\npart 2 is longer"
    assert main_text("<article><p>Text.</p><div class='notice-of-award'>Awarded.</div><section class='related-work'>Others did.</section><div class='comment-list'>first!</div><div class='site-notice'>n</div></article>") == "Text.\n\nAwarded.\n\nOthers did."
    assert main_text("<article>the article itself</article><div><article class='teaser'>Read this</article><article><a href=x>A link to more</a></article></div>") == "the article itself"
    assert main_text("<article><p>a</p><div class='related-reading'><a href=x>More of it</a> <a href=y>And more</a></div></article>") == "a"


def test_page_inside_a_form():
    page = "<body><form id=aspnet><div class=menu><a href=x>Home</a></div><div><h2>Title</h2><p>" + "words of the story " * 20 + "</p></div></form></body>"
    assert main_text(page) == "Title\n\n" + " ".join(["words of the story"] * 20)
    assert main_text("<div><p>" + "story " * 30 + "</p><form><label>Your name</label></form></div>") == " ".join(["story"] * 30)


def test_wrappers_are_merged_in_steps(spark, monkeypatch):
    from textloom.llm import html_wrapper

    monkeypatch.setattr(html_wrapper, "FAN", 2)
    rows = [(k, "http://h/x", f"<article><p>{k}</p>{'<ul><li>a</ul>' * (k % 7)}</article>") for k in range(24)]
    known = wrappers(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8))
    assert known.count() == 1
    w = _known(known.first()["wrapper"])
    assert all(main_text(html, *w).startswith(str(k)) for k, _, html in rows)


def page_of_generated_names(rng, k, article):
    """A page whose classes are all made up: letters only, or letters and digits that take turns."""
    name = lambda: "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) if rng.random() < 0.7 else f"css-{rng.choice('abc')}{rng.randrange(99)}{rng.choice('xyz')}{rng.randrange(99)}q"
    parts = [f"Story {k} part {j}: " + " ".join(f"w{rng.randrange(999)}" for _ in range(12)) for j in range(rng.randrange(2, 6))]
    body = "".join(f"<div class='{name()}'><p class='{name()}'>{x}</p></div>" for x in parts)
    aside = "".join(f"<div class='{name()}'><a href=x>Other {rng.randrange(9999)}</a></div>" for _ in range(3))
    return f"<body><div class='{name()} menu'><a href=x>Home</a> and more</div><{article} class='{name()}'>{body}</{article}><div class='{name()}'><div class='{name()} sidebar'>{aside}</div></div></body>", "\n\n".join(parts)


def test_wrapper_of_generated_names_stays_small():
    rng = random.Random(3)
    w, sizes = None, {}
    pages = [page_of_generated_names(rng, k, "article") for k in range(10_000)]
    for k, (html, _) in enumerate(pages, 1):
        own = wrapper_of(parse(html))
        w = merge(w, own) if w is not None else own
        if k in (500, 2000, 10_000):
            sizes[k] = len(dumps(w))
    assert sizes[10_000] < 1.5 * sizes[500] and sizes[10_000] < 20_000, sizes
    known = _known(dumps(w))
    assert all(main_text(html, *known) == want for html, want in pages[::97])


def test_generated_names_without_an_article_tag():
    rng = random.Random(4)
    pages = [page_of_generated_names(rng, k, "div") for k in range(3 * KEYS_AT_PLACE)]
    w = infer([html for html, _ in pages])
    assert dumps(loads(dumps(w))) == dumps(w)
    known = _known(dumps(w))
    assert all(main_text(html, *known) == want for html, want in pages)


def test_loose_places_keep_roles():
    for key in ["div", "div.menu", "div.a-menu-of-b", "div.x hidden", "section.Main", "div.teaser", "header.top", "nav.q", "form.login", "article.card", "x-abc.promo", "div.menu main", *(f"p.{w}" for w in sorted(CHROME_WORDS))]:
        short = role_key(key)
        assert role_key(short) == short
        assert [is_chrome(short, a) for a in (True, False)] == [is_chrome(key, a) for a in (True, False)] and is_article(short) == is_article(key), key
    # more keys than a place takes in order: one unit a tag and role, whatever the order of merging
    pages = [f"<main><{t} class=c{chr(97 + k % 26)}{chr(97 + k // 26)}>text {k}</{t}><div class=ads{chr(97 + k % 26)}>x</div></main>" for k, t in enumerate(["p", "div", "h2"] * 60)]
    one, other = infer(pages), infer(pages[::-1])
    assert expression(one) == expression(other) == "<main>((<div>#</>)?(<h2>#</>)?(<p>#</>)?)*</>"
