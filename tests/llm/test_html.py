from bitdex.llm import html

FOOT = "<div class='x9'><a href='/a'>Home page</a> <span>All about this site and its makers</span></div>"


def page(title, paras, extra="", foot=FOOT):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<header><a>Site</a></header><nav><ul><li>One</li></ul></nav><!-- ad <p>no</p> --><div class='ad'>Buy!</div>"
            f"<article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paras)}{extra}</article>{foot}"
            "<footer>&copy; us</footer></body></html>")


def one(source, templates=frozenset()):
    root, gone, main, _ = html.read(source, templates)
    return html.blocks(main, gone)


def test_article_only():
    extra = ("<aside>See also</aside><form><p>Mail?</p></form><div class='cookie-notice'>We use cookies</div>"
             "<section id='comments'><p>First!</p></section><article class='comment'>Nice</article>"
             "<div class=sidebar><p>side</p></div><p>last &lt;one&gt; &amp;amp; caf&eacute;&#33;</p>")
    assert one(page("T &amp; U", ["a  b\n c", "<b>d</b>e<br>f"], extra)) == \
        ["T & U", "a b c", "de f", "last <one> &amp; café!"]


def test_broken_markup():
    assert one("<p>one<p>two <b>bold<br><p>three</i></p></div>four") == ["one", "two bold", "three", "four"]
    assert one("plain < text & <unclosed") == ["plain < text & <unclosed"] or one("plain < text")
    assert one("<div><article><p>in</p><ul><li>x<li>y</ul></article></div><div>out</div>") == ["in", "x", "y"]
    assert one("<body><main><p>m</p><nav>n</nav></main>") == ["m"]
    assert one("<script>never ends <p>x</p>") == []
    assert one("<div class='content has-sidebar'><p>a</p><div class='postSidebar'>b</div><p style='display: none'>c</p></div>") == ["a"]
    assert one("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]


def test_reader_comments_go_with_their_heading():
    assert one("<article><h1>T</h1><p>Text.</p><section class=comments><h3>Comments (2)</h3><p>2 so far</p>"
               "<article class=comment><p>Nice</p></article><article class='comment reply'>Me too</article></section></article>") == ["T", "Text."]
    assert one("<body><article><p>Text.</p></article><div id=comments><article class=comment>Nice</article></div>") == ["Text."]


def test_title_lead_and_sibling_articles_stay():
    assert one("<main><h1>Title</h1><p>Lead</p><article><p>Body</p></article></main>") == ["Title", "Lead", "Body"]
    assert one("<main><header><h1>Title</h1></header><div><p>Lead</p><article><p>Body</p></article></div></main>") == ["Title", "Lead", "Body"]
    assert one("<body><h1>Title</h1><nav>n</nav><article><p>Body</p></article><div>foot</div>") == ["Title", "Body"]
    assert one("<body><article><p>A short one</p></article><div>between</div><article><p>A longer second one</p></article>") == \
        ["A short one", "A longer second one"]
    assert one("<article><p>Outer</p><article><p>Inner is much longer</p></article></article>") == ["Outer", "Inner is much longer"]


def test_a_class_is_a_weak_vote():
    for name in ("related-work", "discussion", "notice-of-award", "legal-basis", "form-factor", "responses"):
        assert one(f"<article><p>Start</p><section class='{name}'><h2>Head</h2><p>Some prose, <a>one link</a>.</p></section></article>") == \
            ["Start", "Head", "Some prose, one link."], name
    for name in ("related", "cookie-notice", "post-sidebar", "adBox", "newsletter-form", "share buttons"):
        assert one(f"<article><p>Start</p><div class='{name}'><h2>More</h2><ul><li><a>One thing</a><li><a>Two things</a></ul></div></article>") == \
            ["Start"], name


def host_of_pages(foot, lead=""):
    own = ["A short text of page number {}, which is its own.", "Another one is on page {}, and it differs as well."]
    return [(i, f"http://h.example/{i}", "<html><body>" + lead + "<div id='c'>" + "".join(f"<p>{p.format(i)}</p>" for p in own)
             + "<p>A passage that all share.</p></div>" + foot + "</body></html>") for i in range(7)]


def test_long_feet_and_bare_lines_are_templates(spark):
    long = "<div class='x1'>" + "<a>Imprint and all that belongs to it</a> Every page has this long foot. " * 20 + "</div>"
    bare = "<p>Call us now</p>"
    for foot, lead in ((long, ""), (bare, ""), (long + bare, bare), ("", bare)):
        rows = host_of_pages(foot, lead)
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        for r in html.main_texts(df).collect():
            i = r.page_id
            assert r.text == (f"A short text of page number {i}, which is its own.\n\nAnother one is on page {i}, and it differs as well."
                              "\n\nA passage that all share."), (foot, lead)
            assert r.n_templates >= 1


def test_pages_that_differ_in_a_date_keep_their_text(spark):
    text = "<div id='c'><p>" + "The same article under several dates. " * 5 + "</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{text}<span>day {i}</span></body></html>") for i in range(7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all("The same article" in r.text for r in html.main_texts(df).collect())


def test_the_threshold_follows_the_host(spark):
    """5 of 1,000 pages are no template; 20 are."""
    rows = [(i, "http://h.example/x", f"<html><body><div id=c><p>Page number {i} has a sentence of its own here.</p></div>"
             + ("<div class=q>few pages</div>" if i < 5 else "<div class=r>more pages</div>" if i < 25 else "") + "</body></html>")
            for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert all("few pages" in got[i] for i in range(5)) and not any("more pages" in got[i] for i in range(5, 25))


def test_templates_need_different_pages(spark):
    shared = "A passage that many articles share stays where it is."
    rows = [(i, f"http://h.example/{i}", f"<html><body><div id='c'><p>Text {i} of its own</p><p>{shared}</p>"
             f"<p>{'word ' * 30}{i}</p></div>{FOOT}</body></html>") for i in range(7)]
    copy = page("Copied", ["same article in many copies " * 3], foot="<div>tail</div>")
    rows += [(100 + i, f"http://c.example/{i}", copy) for i in range(9)]
    rows += [(200, "http://lone.example/", rows[0][2])]
    rows += [(300, None, None), (301, "x", ""), (None, None, "<p>null id</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rk")
    got = {r.page_id: r for r in html.main_texts(df).collect()}
    assert len(got) == len(rows)
    for i in range(7):
        assert "Home page" not in got[i].text and shared in got[i].text and got[i].n_templates == 1
        assert got[i].n_chars == len(got[i].text)
    assert "Home page" in got[200].text                       # one page of its host: no template
    assert got[100].text.startswith("Copied\n\nsame article")   # copies are one page
    assert (got[300].text, got[301].text, got[None].text) == ("", "", "null id")
    assert html.main_texts(df.limit(0)).collect() == []


def test_pages_table(spark, sf001):
    import html as entities
    import re
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()}
    got = html.op1_main_text(spark, sf001).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*)</article>", rows[r.page_id].html, re.S)[1]
        parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"</?(?:p|h1)>", article)]
        want = [" ".join(entities.unescape(x).split()) for x in parts]
        assert r.text == "\n\n".join(x for x in want if x)
