"""What template removal keeps and cuts on pages that the given tables don't have."""

from textquarry.llm import html

STORY = "A small stone fell into deep water and nobody saw where it went after that day of rain, number"


def texts(spark, pages):
    rows = [(i, "http://a.example/x", p) for i, p in enumerate(pages)]
    out = html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [r.text for r in out.orderBy("page_id").collect()]


def plain(page):
    return html.main_text(html.parse(page))


def test_text_outside_an_article_goes_by_counts(spark):
    pages = [f"<body><div>Join the club</div><div class='body'>{STORY} {i}</div><article><p>Teaser {i}</p></article><div>All rights</div></body>" for i in range(12)]
    assert texts(spark, pages) == [f"{STORY} {i}\n\nTeaser {i}" for i in range(12)]


def test_inline_elements_are_part_of_their_block(spark):
    pages = [f"<article><p>{STORY} {i}: CO<sub>2</sub></p></article>" for i in range(12)]
    pages += [f"<div><p>{STORY} {i} is <em>not</em> here <a href='/'>link</a></p></div>" for i in range(20, 32)]
    assert texts(spark, pages) == [f"{STORY} {i}: CO2" for i in range(12)] + [f"{STORY} {i} is not here link" for i in range(20, 32)]


def test_only_what_most_pages_have_is_template(spark):
    quoted = "<p>Nine pages of a hundred quote this</p>"
    pages = [f"<div>{quoted if i < 9 else ''}<p>{STORY} {i}</p></div>" for i in range(100)]
    got = texts(spark, pages)
    assert all(t.startswith("Nine pages") for t in got[:9]) and got[50] == f"{STORY} 50"
    same = "<div><p>One body in many copies</p></div>"  # copies of a page count once
    assert texts(spark, [same] * 30 + [f"<div><p>{STORY} {i}</p></div>" for i in range(9)])[:30] == ["One body in many copies"] * 30


def test_layout_words_do_not_take_the_main_text():
    assert plain(f"<body><article class='post comments-open'><p>{STORY}</p></article></body>") == STORY
    assert plain(f"<body><div class='content has-sidebar'><p>{STORY}</p></div><div class='sidebar'>links</div></body>") == STORY
    assert plain(f"<body><div class='widget'><article><p>{STORY}</p></article></div><div class='ad-slot'>buy</div></body>") == STORY
    posts = "".join(f"<article class='post comments-open'><p>{STORY} {i}</p></article>" for i in range(4))
    assert plain(f"<body>{posts}</body>").count(STORY) == 4
    assert plain(f"<body><article><p>Short</p></article><div class='ad'>{STORY}</div><div class='related-posts'><article>card</article></div></body>") == "Short"
    assert plain(f"<body><div class='layout has-sidebar'><p>{STORY}</p></div></body>") == STORY
    assert plain(f"<body><div id='content' class='no-comments'><p>{STORY}</p></div></body>") == STORY
    assert plain(f"<body><div class='post search-result'><p>{STORY}</p></div></body>") == STORY
    assert plain(f"<body><form id='aspnetForm'><article><p>{STORY}</p><form>Name</form></article></form><form>Log in</form></body>") == STORY


def test_prose_that_recurs_in_articles_goes(spark):
    add = "<p>Subscribe to our newsletter</p>"
    pages = [f"<article><h1>{STORY} {i}</h1><p>{STORY} told {i}</p>{add}</article>" for i in range(12)]
    assert texts(spark, pages) == [f"{STORY} {i}\n\n{STORY} told {i}" for i in range(12)]
    bare = [f"<body><p>{STORY} {i}</p><div class='x'>{add}</div></body>" for i in range(12)]
    assert texts(spark, bare) == [f"{STORY} {i}" for i in range(12)]


def test_copies_of_an_article_stay_whole(spark):
    body = f"<h1>{STORY}</h1><p>{STORY} told</p>"
    copies = [f"<nav>{i}</nav><article>{body}</article><div>page {i}</div>" for i in range(20)]  # the same article on other pages
    near = [f"<article>{body}<p>Edition {i}</p></article>" for i in range(20)]  # mostly the same: no additions to an article
    others = [f"<article><p>{STORY} {i}</p></article>" for i in range(6)]
    got = texts(spark, copies + near + others)
    assert got[3] == f"{STORY}\n\n{STORY} told\n\npage 3" and got[25] == f"{STORY}\n\n{STORY} told\n\nEdition 5" and got[41] == f"{STORY} 1"


def test_reader_comments_go():
    listed = "<ul><li>first!</li><li>nice one</li></ul>"
    for head in ("<h2>Comments</h2>", "<h3>3 Comments</h3>", "<h2>Reader <i>comments</i> (12)</h2>", "<h4>Leave a reply</h4>"):
        assert plain(f"<article><h1>Comments on rain</h1><p>{STORY}</p>{head}{listed}<p>me too</p></article>") == f"Comments on rain\n\n{STORY}"
    assert plain(f"<article><p>{STORY}</p><h3>Comments</h3>{listed}<h2>More</h2><p>Text</p></article>") == f"{STORY}\n\nMore\n\nText"
    assert plain(f"<article><h2>Comments by the author</h2><p>{STORY}</p></article>") == f"Comments by the author\n\n{STORY}"


def test_odd_tables(spark):
    rows = [(1, None, "<p>a  b</p>", "t", 3), (1, None, "<p>a  b</p>", "t", 3), (None, "http://x.example/", "", "u", 1), (3, "no url", None, None, 2)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text string, rid int")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(spark, odd).collect()) == [("1", "a b", 3), ("1", "a b", 3), ("3", "", 0), ("None", "", 0)]


def test_headings_and_prose_of_an_article_stay_whatever_they_are_called():
    for head in ('<h2 id="search">Search</h2>', '<h2 id="social">Social</h2>', '<h3 class="notices" id="notices">Notices</h3>'):
        assert plain(f"<article><p>{STORY}</p>{head}<p>{STORY} told</p></article>").count("\n\n") == 2
    for name in ("share", "alert", "search", "related"):
        assert plain(f"<article><p>{STORY}</p><p class='{name}'>A {name} of it</p></article>").endswith(f"A {name} of it")
    assert plain(f"<article><p>{STORY}</p><p class='ad'>Buy</p><div class='share'>Share</div></article>") == STORY
    assert plain(f"<article><p>{STORY} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><menu><li>one</li></menu><p><label>Fig.</label> 1</p></article>") == f"{STORY} x=2\n\none\n\nFig. 1"
    assert plain(f"<body><menu><li>Home</li></menu><label>Find</label><article><p>{STORY}</p></article></body>") == STORY


def test_sections_that_only_share_a_title_with_comments_stay():
    guide = f"<h2>Comments</h2><p>Write comments that explain why, {STORY}.</p><ul><li>short</li></ul>"
    assert plain(f"<article><p>{STORY}</p>{guide}</article>").endswith("short")
    assert "Responses" in plain(f"<article><p>{STORY}</p><h2>Responses</h2><p>A server answers with one of:</p><ul><li>200</li><li>404</li></ul></article>")
    years = "".join(f"<li><time>{y}</time> {STORY}</li>" for y in (1990, 2000, 2010))
    assert "2010" in plain(f"<article><p>{STORY}</p><ul>{years}</ul></article>")


def test_reader_comments_without_a_heading_go():
    one = "<li><cite>{}</cite> <time>3 May 2020</time><p>So true</p></li>"
    assert plain(f"<article><p>{STORY}</p></article><ol class='commentlist'>{one.format('Ann')}</ol>") == STORY
    assert plain(f"<article><p>{STORY}</p><ol>{one.format('Ann')}{one.format('Bob')}</ol></article>") == STORY
    entry = "<div class='item'><span class='author'>Ann</span> <span class='date'>yesterday</span><p>Not so, I think, at all</p></div>"
    assert plain(f"<article><p>{STORY}</p><div class='user-opinions'>{entry}{entry}{entry}</div></article>") == STORY
    said = "<div>Ann B. says: <p>I was there</p></div><div>Bob wrote on 2020-01-02: <p>so was I</p></div>"
    assert plain(f"<article><p>{STORY}</p><section>{said}</section></article>") == STORY


def test_advert_slots_links_and_copyright_outside_an_article_go():
    page = f"<body><a href='/'>Home</a><div data-ad-slot='3'>Buy</div><p><a href='/x'>Next</a></p><article><p>{STORY} <a href='/'>link</a></p></article><p>Copyright 2020 Someone</p><p>A note that stays</p></body>"
    assert plain(page) == f"{STORY} link\n\nA note that stays"


def test_shapes_that_recur_outside_articles_are_template(spark):
    # no text, name or tag tells the box and the links of these pages from content: only their shape recurs
    box = "<div class='x'><b>Today</b> item {} of the day for number {}</div>"
    links = "<section><span><a href='/{0}'>word{0}</a></span><span><a href='/{1}'>word{1}</a></span> and more</section>"
    pages = [f"<body>{box.format(i * 7, i)}<article><h1>{STORY} {i}</h1><p>{STORY} {i}</p></article>{links.format(i, i * 3)}</body>" for i in range(12)]
    assert texts(spark, pages) == [f"{STORY} {i}\n\n{STORY} {i}" for i in range(12)]
    few = texts(spark, pages[:4])
    assert all("Today" in t for t in few)
    # paragraphs of a page without an article share their shape, and stay
    bare = [f"<body><div class='body'><p>{STORY} {i}</p><p>{STORY} {i} more</p></div></body>" for i in range(12)]
    assert texts(spark, bare)[3].count(STORY) == 2
