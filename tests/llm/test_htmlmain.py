import random

from lodestrata.llm import htmlmain

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="ad">buy</div><div class="post-{n}"><h1>Title &amp; more</h1><p><b>First</b> para<br>graph {n}<p>Second&nbsp;one, wo<i>rd</i>s {n} {body}<ul><li>item</ul><form><input>q</form><aside>side</aside></div>
<section class="comments"><p>reader comment, quite long, {body} {body}</section><footer>&copy; x</footer>"""
SCHEMA = "page_id long, url string, html string, host string, path string"


def text(n, body):
    return f"Title & more First para graph {n} Second one, words {n} {body} item"


def test_extracts_by_consensus(spark):
    rows = [(n, f"https://u@Host.example:80/{n}?x", PAGE.format(n=n, body="long body of the page"), "h", "p") for n in range(5)]
    odd = '<body><div class="post-9"><p>tiny</div><div class="related-x"><p>much more text than the article itself has, but it is related</div><div class="big"><p>much longer text than the tiny post has, which would win on this page alone</div>'
    got = {r.page_id: r for r in htmlmain.extract(spark.createDataFrame([*rows, (9, "http://host.example/9", odd, "h", "p")], SCHEMA)).collect()}
    assert all(got[n].text == text(n, "long body of the page") for n in range(5))
    assert got[9].text == "tiny" and got[9].by_consensus and got[9].host_path == "div.post-#"


def test_shuffled_paths_and_odd_pages(spark):
    rows = [(1, None, None, "h", "p"), (2, "x", "", "h", "p"), (None, "ftp://h/", "plain &lt;text&#x21; only", "h", "p"), (4, "http://h2/", "<div><p>a<div><p>b</div></div><p>c<!-- no --><![CDATA[x", "h", "p"), (4, "http://h2/", "<nav>only menu</nav>", "h", "p"), (5, "http://h3/", "<p>x " + "y" * 300_000, "h", "p")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = htmlmain.extract(df, broadcast_hosts=0)
    found = {(r.page_id, r.url, r.text[:20], r.n_chars) for r in got.collect()}
    assert {(1, None, "", 0), (2, "x", "", 0), (None, "ftp://h/", "plain <text! only", 17), (4, "http://h2/", "", 0), (5, "http://h3/", "x " + "y" * 18, 300_002)} <= found and got.count() == 6
    assert htmlmain.extract(df.limit(0)).count() == 0


def test_unclosed_and_nested_boilerplate():
    page = "<article><header>no</header><p>one <a href=x>link</a><p>two<div class='share-buttons'><div>no<p>no</div></div><table><tr><td>c1<td>c2</table><p hidden>no</p><p style='display: none'>no</p><template>no</template>three"
    assert htmlmain.main_text(page, None)[0] == "one link two c1 c2 three"


LONG = "body text of the article " * 20
BODY = f"<div class=body><p>{LONG}</div>"
TABLE = f"<table><tr><td>{LONG}<td>{LONG}</table>"


def joined(*parts):
    return " ".join(" ".join(parts).split())


def test_lead_outside_the_body_and_text_around_a_large_table_stay():
    for tag in ("article", "main", "div class=post"):
        end = tag.split()[0]
        assert htmlmain.main_text(f"<nav>no</nav><{tag}><h1>Title</h1><p>lead{BODY}<p>end</{end}>", None)[0] == joined("Title lead", LONG, "end")
        assert htmlmain.main_text(f"<{tag}><p>before{TABLE}<p>after</{end}><footer>no</footer>", None)[0] == joined("before", LONG, LONG, "after")
    assert htmlmain.main_text(f"<div><a href=x>links only</a></div><article><p>lead{BODY}</article><p>outside", None)[0] == joined("lead", LONG)


def test_host_vote_keeps_the_whole_article(spark):
    rows = [(n, f"http://a/{n}", f"<article><h1>T{n}</h1><p>lead{BODY}</article>", "h", "p") for n in range(3)] + [(9, "http://a/9", "<article><p>much text outside the body here<div class=body><p>tiny</div></article>", "h", "p")]
    rows += [(10 + n, f"http://b/{n}", f"<div class=wrap>{BODY}</div>", "h", "p") for n in range(3)] + [(19, "http://b/9", f"<div class=wrap><h1>T</h1>{BODY}<div><a href=x>links only</a></div></div>", "h", "p")]
    got = {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: joined(f"T{n} lead", LONG) for n in range(3)} | {9: "much text outside the body here tiny"} | {10 + n: joined(LONG) for n in range(3)} | {19: joined("T", LONG)}


def test_a_name_alone_takes_no_article_away():
    for attrs in ("class='content has-sidebar'", "id=post-login-required", "class=sidebar", "class='no-comments page'"):
        assert htmlmain.main_text(f"<div {attrs}><p>The whole article text.</p></div>", None)[0] == "The whole article text."
    assert htmlmain.main_text("<div class=header><h1>Site</h1></div><article><header><h1>Head</h1><p>by me</header><p>Text</p><div class=header>no</div></article>", None)[0] == "Head by me Text"
    assert htmlmain.main_text("<div class=widget-main><article><p>Text</article></div><div class=comments><h3>Comments</h3><p>a much longer comment of a reader</div>", None)[0] == "Text"


def test_a_class_with_a_slash_keeps_the_vote(spark):
    rows = [(n, f"http://a/{n}", f"<div class=w-1/2><p>{LONG}</div><div><a href=/>links only</a></div>", "h", "p") for n in range(3)]
    got = htmlmain.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.by_consensus and r.text == joined(LONG) and r.host_path == "div.w-#/#" for r in got)


def test_generated_pages_equal_their_article(spark):
    """Pages put together from known blocks: the expected text never sees the html."""
    rng, rows, want = random.Random(8), [], {}
    words = lambda n: " ".join(rng.choice(["alpha", "b&eacute;ta", "gamma,", "delta &amp; co", "eps"]) for _ in range(n))
    plain = lambda t: t.replace("&eacute;", "é").replace("&amp;", "&")
    wraps = ["<article>%s</article>", "<main><div class=entry-%d>%s</div></main>", "<div class='post p%d'>%s</div>"]
    for n in range(60):
        host, parts = n % 3, [words(rng.randrange(20, 90)) for _ in range(rng.randrange(1, 6))]
        title = words(4)
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{t}" + rng.choice(["</p>", "", "<br>"]) for t in parts)
        body = wraps[host] % (inner if host == 0 else (n, inner))
        noise = [f"<nav><ul><li><a href=/>{words(2)}</a></ul></nav>", f"<div class='ad box'>{words(30)}</div>", f"<aside>{words(40)}</aside>", f"<div id=cookie-notice>{words(9)}<button>ok</button></div>"]
        rng.shuffle(noise)
        tail = f"<section class=comments><p>{words(100)}</section><footer>&copy; {words(5)}</footer>"
        rows.append((n, f"https://site{host}.example/{n}", f"<html><head><title>x</title><script>if(a<b)c()</script></head><body>{noise[0]}{noise[1]}{body}{noise[2]}{tail}", "h", "p"))
        want[n] = joined(plain(title), *map(plain, parts))
    got = {r.page_id: (r.text, r.n_chars) for r in htmlmain.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: (t, len(t)) for n, t in want.items()}


STORY = "<p>One long sentence of the article stands here.</p><p>Another one follows it, longer than the first one is.</p>"
TOLD = "One long sentence of the article stands here. Another one follows it, longer than the first one is."


def test_gates_and_names_around_the_article():
    text = lambda html: htmlmain.main_text(html, None)[0]
    assert text(f'<form id="aspnetForm"><input><p>Search</p><article>{STORY}</article><p>Send</p></form>') == TOLD
    assert text(f"<nav><a href='/'>Home</a><article>{STORY}</article><footer>All rights</footer>") == TOLD
    assert text(f"<aside><main>{STORY}</main><p>Ad</p></aside>") == TOLD
    assert text(f'<div class="article-notice">{STORY}</div><div class="x">Other small text.</div>').startswith(TOLD)
    assert text(f'<div class="story-share">{STORY}</div><p>Copyright</p>').startswith(TOLD)
    assert text(f'<article>{STORY}<ol class="commentlist"><li>A reader says a lot, and more than the article itself does, and still more of it, and on and on and on, without an end in sight.</li></ol></article>') == TOLD
    assert text(f"<div>{STORY}</div><aside><article>A teaser of another page that is left out</article></aside><form><template><article>No</article></template></form><div hidden><article>Neither</article></div>") == TOLD
    assert text(f"<article>{STORY}</article><form><p>Comment</p></form>") == TOLD
