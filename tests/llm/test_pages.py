"""Main text: consensus paths, boilerplate, markup oddities."""

from timesift.llm import pages

NAV = "<nav><ul><li><a href='/a'>Home menu</a></li></ul></nav>"
FOOT = "<footer>&copy; a long footer line that says more than the article on some pages of this host</footer>"


def page(main, kind="article", before=NAV):
    return f"<html><head><title>T</title><style>p{{x}}</style><script>var t='<p>no</p>';</script></head><body>{before}<{kind}>{main}</{kind.split()[0]}>{FOOT}</body></html>"


def table(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("host", F.lit("x")).withColumn("path", F.lit("x")).withColumn("text", F.lit("x"))


def run(spark, rows):
    return {r.page_id: r for r in pages.extract_main_text(table(spark, rows)).collect()}


def test_blocks_entities_and_white_space(spark):
    html = page("<h1>A &amp; B</h1><p><b>Bold one.<br><p>Two\n\t lines&nbsp;&eacute;&#233;  <a href=x>link</a> end.</p><ul><li>one<li>two</ul><!-- gone --> tail &lt;x&gt;")
    got = run(spark, [(1, "http://h.org/a", html)])[1]
    assert got.text == "A & B\n\nBold one.\n\nTwo lines éé link end.\n\none\n\ntwo\n\ntail <x>"
    assert got.n_chars == len(got.text)


def test_boilerplate_inside_and_outside_goes(spark):
    inner = ("<header>Site head</header><p>First.</p><div class='ad-box'>Buy</div><form>Name <input></form><aside>Side</aside><div id='cookieNotice'>We use</div>"
             "<div class='comments'><p>Reader said</p><div>more</div></div><div hidden>no</div><p class='share-bar'>tweet</p><div class='shadow'>Kept.</div>"
             "<button>Go</button><noscript>js</noscript><p>Last.</p><div role='complementary'>x</div>")
    assert run(spark, [(1, "http://h.org/", page(inner))])[1].text == "First.\n\nKept.\n\nLast."


def test_host_consensus_beats_a_page_of_its_own(spark):
    body = "<p>" + "words of the story " * 12 + "</p>"
    rows = [(i, f"http://Site.ORG/{i}", page(body, f"div class='post post-{i}'", NAV + f"<div class='teaser'><p>Read more {i}</p></div>")) for i in range(12)]
    # On this page the teaser is longer than the story: alone, it would win.
    rows.append((50, "http://site.org/x", page("<p>Short story.</p>", "div class='post post-77'", NAV + "<div class='teaser'><p>" + "tease " * 90 + "</p></div>")))
    got = run(spark, rows)
    assert got[50].text == "Short story." and got[50].path == "html/body/div.post.post-0"
    assert run(spark, rows[-1:])[50].text.startswith("tease")


def test_edges(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://a.b", "just text &amp; more"), (4, "http://a.b", "<p>unclosed <b>x"), (5, "http://a.b", "<div><script>never ends"),
            (6, "http://long.org/", page("<p>" + "é word " * 60_000 + "</p>")), (7, "http://a.b", "</div></p></article>lone <3 ok"), (8, None, page("<p>x</p>")),
            (8, None, page("<p>x</p>")), (9, "http://q.org", page("<p title='a>b'>quoted</p>"))]
    df = pages.extract_main_text(table(spark, rows)).collect()
    got = {r.page_id: r.text for r in df}
    assert len(df) == len(rows)
    assert (got[1], got[2], got[3], got[5], got[8], got[9]) == ("", "", "just text & more", "", "x", "quoted")
    assert got[4] == "unclosed x" and got[7] == "lone <3 ok" and len(got[6].split()) == 120_000
    assert pages.extract_main_text(table(spark, rows).limit(0)).count() == 0


def test_votes_of_a_page_sum_to_one_million_at_most_rounding(spark):
    scores = pages.container_scores(pages.blocks_of(page("<div class='c1'><p>abc</p></div><p>def</p>")))
    assert set(scores) == {"html/body/article/div.c0", "html/body/article", "html/body", "html"}


def story(word, n=30):
    return "<p>" + f"{word} words of the story " * n + "end.</p>"


def test_an_article_over_several_containers_is_whole(spark):
    split = "<div class=body><div class=lead>" + story("lead", 20) + "</div><div class=text>" + story("text") + "</div></div>"
    nested = "<article><h1>Head</h1>" + story("direct", 5) + "<div class=inner>" + story("inner", 90) + "</div></article>"
    three = "<div class=body>" + story("own", 10) + "<div class=deep><div class=deeper><div class=deepest>" + story("deep", 60) + "</div></div></div></div>"
    some = "<div class=body>{}<div class=text>" + story("text") + "</div></div>"
    rows = [(i, f"http://{h}.org/{i}", f"<html><body>{NAV}{b}</body></html>") for h, b in (("a", split), ("b", nested), ("c", three)) for i in range(3)]
    rows += [(i, f"http://d.org/{i}", f"<html><body>{NAV}{some.format('<div class=lead>' + story('lead', 9) + '</div>' if i % 3 == 0 else '')}</body></html>") for i in range(9)]
    for r in pages.extract_main_text(table(spark, rows)).collect():
        host = r.url.split("/")[2][0]
        want = {"a": ["lead", "text"], "b": ["Head", "direct", "inner"], "c": ["own", "deep"], "d": ["lead", "text"] if r.page_id % 3 == 0 else ["text"]}[host]
        assert [t.split()[0] for t in r.text.split("\n\n")] == want, r


def test_end_tags_that_html_lets_a_page_omit(spark):
    head = "<html><head><meta charset=utf-8><title>T</title><body>" + story("Story") + "</body></html>"
    bare = "<html><head><title>T</title>" + story("Story") + "</html>"
    ad = "<html><body><div class=post><p class=ad>Buy<p>Story of a paragraph.<p>More of the story here.<ul><li class=promo>Buy<li>One of the items</ul></div></body></html>"
    lists = "<html><body><div class=post><ul class=menu><li><div>x</ul><dl><dt class=ad>Buy<dd>Meaning of the word.</dl>" + story("Story") + "</div></body></html>"
    cells = "<html><body><table><tr><td class=ad>Buy<td>" + story("Story") + "<tr><td>Last of the cells here.</table></body></html>"
    got = [pages.main_text(pages.blocks_of(h), None) for h in (head, bare, ad, lists, cells)]
    assert got[0].startswith("Story") and got[1].startswith("Story")
    assert got[2] == "Story of a paragraph.\n\nMore of the story here.\n\nOne of the items"
    assert got[3].startswith("Meaning of the word.\n\nStory")
    assert got[4].startswith("Story") and got[4].endswith("Last of the cells here.")


def test_wrappers_named_after_boilerplate_keep_the_article(spark):
    comments = "<div class=comments><article class=comment><p>A reader said this at length.</p></article></div>"
    for name in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "post has-comments"):
        for kind in ("article", "main", "div"):
            html = f"<html><body>{NAV}<div class='{name}'><{kind}>{story('Story')}{comments}</{kind}></div><div class=sidebar>About this site and its owners.</div></body></html>"
            got = pages.main_text(pages.blocks_of(html), None)
            assert got.startswith("Story") and "\n\n" not in got, (name, kind, got)
    html = f"<html><body><div class=post>{story('Story')}</div><div class=related><article><p>A card of another page, short.</p></article></div></body></html>"
    assert "card" not in pages.main_text(pages.blocks_of(html), None)


def test_classes_may_hold_a_slash(spark):
    rows = [(i, f"http://h.org/{i}", f"<html><body>{NAV}<div class='md:w-2/3 w-1/2'>{story('Story')}</div></body></html>") for i in range(3)]
    for r in pages.extract_main_text(table(spark, rows)).collect():
        assert r.text.startswith("Story") and r.path == "html/body/div.md:w-0%2F0.w-0%2F0"


def test_attributes_are_whole_names(spark):
    for odd in ("<p data-id='nav'>{}</p>", "<div title='the hidden valley'>{}</div>", "<div data-overflow='hidden'>{}</div>", "<div title='see class=ad here'>{}</div>",
                "<p data-class=ad data-role=navigation>{}</p>", "<p title=\"it's class='ad'\">{}</p>", "<div x-hidden>{}</div>", "<div class='post' class='ad'>{}</div>"):
        html = f"<html><body><article>{story('First')}{odd.format('Kept words of the article stand here in full.')}</article></body></html>"
        assert "Kept words" in pages.main_text(pages.blocks_of(html), None), odd
    for gone in ("<p HIDDEN>{}</p>", "<p id=nav>{}</p>", "<div a='b'class='ad'>{}</div>", "<p role = 'navigation'>{}</p>", "<p style='display: none'>{}</p>"):
        html = f"<html><body><article>{story('First')}{gone.format('Words that are left out of the article.')}</article></body></html>"
        assert "left out" not in pages.main_text(pages.blocks_of(html), None), gone


def test_a_page_of_its_own_making_keeps_its_lead(spark):
    plain = f"<div class=wrap><div class=text>{story('text')}</div></div>"
    both = f"<div class=wrap><div class=lead>{story('lead', 12)}<p>Short line.</p></div><div class=text>{story('text')}</div><div class=tip>Tip of the day</div></div>"
    rows = [(i, f"http://a.org/{i}", f"<html><body>{NAV}{plain if i else both}</body></html>") for i in range(10)]
    got = run(spark, rows)
    assert [t.split()[0] for t in got[0].text.split("\n\n")] == ["lead", "Short", "text"]
    assert all([t.split()[0] for t in got[i].text.split("\n\n")] == ["text"] for i in range(1, 10))


def test_time_grows_with_length_only(spark):
    import time

    big = ["<a \"x\" '" * 120_000, "<div>a" * 150_000, "<div class=ad>a" * 60_000, "<" * 1_000_000, "<a href='" * 100_000 + ">", "<ul>" + "<div></li>" * 90_000,
           "<article>" * 100_000 + "end", "<!-- " * 200_000, "<p class=" * 100_000, "<li>x" * 150_000, "&amp;" * 200_000]
    for source in big:
        started = time.perf_counter()
        page = pages.blocks_of(source)
        pages.main_text(page, pages.best_path(page), set())
        assert time.perf_counter() - started < 20, source[:20]


def test_quotes_that_never_end_lose_no_later_text(spark):
    html = f"<html><body><article>{story('First')}<a href='x>{story('Second')}</a><p>{story('Third')}</article></body></html>"
    assert [t.split()[0] for t in pages.main_text(pages.blocks_of(html), None).split("\n\n")] == ["First", "Second", "Third"]
    assert pages.main_text(pages.blocks_of("<p>a < b <3 and c <"), None) == "a < b <3 and c <"
