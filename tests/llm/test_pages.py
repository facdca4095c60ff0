"""Extraction against the known template of the tables and against pages written here."""

import html
import re
import time

import __spark_entry__ as entry
from echolake.llm import pages

FOLDER = "/root/testdata/sf0.01"


def plain(source):
    """The article of the template: blocks between its heading and paragraph tags."""
    inner = re.search(r"<article>(.*?)</article>", source or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", inner.group(1) if inner else "")
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p) if "<br>" in p else re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_query(spark):
    source = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = entry.queries()["op6_pages"](spark, FOLDER).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == {k: (u, plain(h)) for k, (u, h) in source.items()}
    assert all(r.n_chars == len(r.text) for r in got)


TEMPLATE = """<html><head><title>no</title><style>p{}</style></head><body><header><p>Site name and a slogan</p></header>
<ul class="menu"><li><a href=/>Home</a></li></ul><div id=sidebar><p>{aside}</p></div>
<div class="post post-{n}"><header><h1>Title &amp; {n}</h1><p>by someone</p></header><p>First&nbsp;paragraph   of {n}<br>goes on.
<p>Second <b>bold</b>ly {body}</p><div class="ad-slot">Buy this thing now</div><form><p>Your mail</p></form><ul><li>one<li>two</ul></div>
<div class="comments"><div class="post-body"><p>{comment}</p></div></div><footer>&copy; all</footer><script>var a="<p>no</p>"</script></body></html>"""


def test_host_consensus_and_rows(spark):
    rows = []
    for n in range(12):
        long = "reader words " * (80 if n == 0 else 2)
        rows.append((n, "http://Site.example:80/a" if n % 2 else "https://u@site.example/b", TEMPLATE.replace("{n}", str(n)).replace("{body}", "text " * (1 if n == 0 else 40)).replace("{aside}", "x").replace("{comment}", long), "old"))
    rows += [(100, None, None, "x"), (100, "", "", "y"), (101, "nonsense", "just words < 3 & more", "z"), (102, "http://o.example/", "<p>open <b>tag <div>inside <i>it", None),
             (None, "http://p.example/", "<div>" * 3000 + "deep text" + "</p>" * 3000, None), (103, "http://q.example/", "<!-- never closed <p>x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in pages.extract(df).collect()}
    for n in range(12):
        body = ("text " * (1 if n == 0 else 40)).strip()
        assert got[(n, rows[n][1])] == f"Title & {n}\n\nFirst paragraph of {n} goes on.\n\nSecond boldly {body}\n\none\n\ntwo"
    assert got[(100, None)] == got[(100, "")] == "" and got[(103, "http://q.example/")] == ""
    assert got[(101, "nonsense")] == "just words < 3 & more"
    assert got[(102, "http://o.example/")] == "open tag\n\ninside it"
    assert got[(None, "http://p.example/")] == "deep text"
    assert pages.extract(df).columns == ["page_id", "url", "html", "text", "n_chars"]
    assert pages.extract(df.limit(0)).count() == 0


def test_long_pages_stay_fast():
    start = time.time()
    for source in ("<p>word " * 60_000, "<a href='" * 3_000, "<" * 200_000, "<div class=x>" * 20_000 + "</div>" * 20_000):
        pages.main_text(source, None)
    assert time.time() - start < 60


def test_names_on_what_holds_the_page():
    text = "A sentence of the article that goes on for a while. " * 5
    for name in ("no-sidebar", "has-sidebar", "content-with-sidebar", "comments-open", "sticky-menu", "post-related-off", "has-header", "widget", "sidebar-right", "share"):
        for tag in ("article", "div"):
            page = f"<body><div class='{name}'><{tag}><h1>Title</h1><p>{text}</p></{tag}></div><div class='comments'><p>{text * 3}</p></div><div id=ad-slot>Buy</div></body>"
            assert pages.main_text(page, None) == f"Title\n\n{text.strip()}", (name, tag)
    small = f"<body><div class=post><p>{text}</p><div class='related-posts'><p>Other posts</p></div><div class='notice'><p>Note</p></div></div></body>"
    assert pages.main_text(small, None) == text.strip()


def test_whole_articles_in_parts(spark):
    long = "A sentence of one part of the article, number {}, going on. " * 6
    part = ["<p>" + long.replace("{}", str(k)) + "</p>" for k in range(4)]
    bodies = {
        "two": f"<article><h1>Title</h1><section>{part[0]}</section><section>{part[1]}</section></article>",
        "four": "<article><h1>Title</h1><p>Short lead.</p>" + "".join(f"<section>{p}</section>" for p in part) + "</article>",
        "intro": f"<div class=post><h1>Title</h1><div class=intro><p>Short lead.</p></div><div class=body>{''.join(part)}</div></div>",
        "halves": f"<div class=post><div class=a><h2>Title</h2>{part[0]}</div><div class=b>{part[1]}</div></div>",
        "one": f"<article><h1>Title</h1><p>Short lead.</p><section>{''.join(part)}</section></article>",
    }
    source = "<html><body><nav><a href=/>Home</a></nav>{}<div class=links><a href=/x>Some more of this site</a></div></body></html>"
    rows = [(n, f"http://{kind}.example/{n}", source.format(body)) for kind, body in bodies.items() for n in range(3)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        body = bodies[r.url.split("/")[2].split(".")[0]]
        want = [t.strip() for t in re.split(r"<[^>]*>", body) if t.strip()]
        assert r.text.split("\n\n") == want, r.url


def test_titles_and_leads_outside_the_container():
    text = "A sentence of the article that goes on for a while. " * 8
    story = f"<div class='story'><p>{text}</p><p>{text}</p></div>"
    want = f"{text.strip()}\n\n{text.strip()}"
    nav = "<header><h1>Site</h1></header><nav><a href=/>Home</a></nav>"
    for between, lead in (("", ""), ("<div class=lead>Short lead.</div>", "Short lead.\n\n"), ("<p>Short lead.</p><p><a href=/t>All of this</a></p>", "Short lead.\n\n")):
        assert pages.main_text(f"<html><body>{nav}<h1>The title</h1>{between}{story}<footer>&copy;</footer></body></html>", None) == f"The title\n\n{lead}{want}"
    assert pages.main_text(f"<body>{nav}<p>Before the story</p>{story}</body>", None) == want
    headed = f"<div class='story'><h2>Its own title</h2><p>{text}</p></div>"
    assert pages.main_text(f"<body><div><h1>Site</h1></div>{headed}</body>", None) == f"Its own title\n\n{text.strip()}"


def test_comment_blocks_and_figures():
    text = "A sentence of the article that goes on for a while. " * 8
    for mark in ("class='user-comments'", "class='comment-thread'", "id='respond'", "class='reader-comments'", "id=comments-list", "class='comment-author'"):
        assert pages.main_text(f"<body><article><h1>T</h1><p>{text}</p><div {mark}><p>I think so too</p></div></article></body>", None) == f"T\n\n{text.strip()}", mark
    page = f"<body><article><h1>T</h1><p>{text}</p><figure class='%s'><img src=x><figcaption>What it shows</figcaption></figure></article></body>"
    assert pages.main_text(page % "widget", None) == f"T\n\n{text.strip()}\n\nWhat it shows"
    assert pages.main_text(page % "ad", None) == f"T\n\n{text.strip()}"


def test_clashing_names_and_many_hosts(spark):
    rows = [(n, f"http://h{n % 7}.example/{n}", f"<body><article><h1>T{n}</h1><p>Text of page {n}</p></article></body>", "a", 1, "b", "c", "d") for n in range(70)]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string, __host string, __part int, __path string, __both string, host string")
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (default, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = pages.extract(df)
        found = got.collect()
        assert got.columns == [*df.columns, "text", "n_chars"] and len(found) == 73
        assert all(r.text == f"T{r.page_id}\n\nText of page {r.page_id}" and r["__host"] == "a" and r["__part"] == 1 and r.host == "d" for r in found)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
