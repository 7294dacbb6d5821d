import re

from parapet.llm import wrappers

SCHEMA = "page_id bigint, url string, html string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var x="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=sidebar><p>Popular</p></div><!-- <p>comment</p> -->
<article class="post-{n}"><header><h1>Title {n} &amp; more</h1></header><p>First&nbsp;paragraph  {n}
 with <b>bold</b>text<p>Second &lt;b&gt; paragraph {n}<br>next line<ul><li>one {n}<li>two</ul>
<div class="advert">Buy now</div><form><p>Sign up</p></form><aside>Related</aside><script>1</script>
<table><tr><td>cell {n}<td>other</table></article>
<section id="comments"><article class="comment"><p>Reader says {n}</p></article></section><footer>&copy; us</footer></body></html>"""


def test_leaves_out_what_is_no_article():
    text = wrappers.main_text(PAGE.format(n=1), None)
    assert text.split("\n") == [
        "Title 1 & more", "First paragraph 1 with boldtext", "Second <b> paragraph 1 next line", "one 1", "two", "cell 1", "other",
    ]


def test_odd_markup():
    cases = {
        "": "", "plain text": "plain text", "a < b and c > d": "a < b and c > d",
        "<p>unclosed <i>x": "unclosed x", "<p title=\"a>b\">x</p>": "x", "<p title='open>y</p>": "y",
        "<script>never closed <p>z": "", "<!-- never closed <p>z": "", "x &am y &amp z &#233; &#x41;": "x &am y & z é A",
        "<P>A</P><DIV>B</DIV>": "A\nB", "<p>a<br/>b</p>": "a b", "<div>t<p>u</div>v": "t\nu\nv",
        "<p>see <button>press</button> here</p>": "see here", "<div hidden>no</div><p>yes</p>": "yes",
    }
    for page, wanted in cases.items():
        assert wrappers.main_text(page, None) == wanted, page


def page(n, body):
    return f"<body><div class='top'><p>Welcome back</p></div><div class='entry'>{body}</div><div class='end'><p>All the same end</p></div>"


def test_infers_slots_repeats_and_options():
    pages = [page(n, f"<h2>Head {n}</h2>" + "".join(f"<p>par {n} {i} long enough</p>" for i in range(n)) + ("<pre>code</pre>" if n == 2 else ""))
             for n in (1, 2, 5)]
    own = None
    for text in pages:
        new = wrappers.page_wrapper(wrappers.blocks_of(text))
        own = new if own is None else wrappers.align(own, new)
    kinds = [(node[0], wrappers._bare(node)) for node in own]
    assert kinds == [
        ("t", "body/div.top/p"), ("t", "body/div.entry/h2"), ("*", "body/div.entry/p"), ("?", "body/div.entry/pre"), ("t", "body/div.end/p"),
    ]
    assert own[0][2] == "Welcome back" and own[1][2] is None
    assert wrappers.container(own) == "body/div.entry/"


def test_wrapper_finds_the_container_of_a_host(spark):
    rows = [(n, f"http://Blog.example.com:80/{n}", page(n, f"<p>{'word ' * 5}{n}</p><p>more {n}</p>")) for n in range(40)]
    rows += [(100, None, None), (101, "", "<p>alone</p>"), (102, "no url", ""), (0, rows[0][1], rows[0][2])]
    rows += [(200, "https://one.example.org/x", PAGE.format(n=7))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as host", "'y' as text", "1 as path").repartition(9)
    found = wrappers.extract(df).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert by[3]["text"] == f"{'word ' * 5}3\nmore 3" and by[3]["n_chars"] == len(by[3]["text"])
    assert (by[100]["text"], by[101]["text"], by[102]["text"]) == ("", "alone", "")
    assert by[200]["text"].startswith("Title 7 & more\nFirst")
    (path,) = [r["path"] for r in wrappers.wrappers(df).collect() if r["host"] == "blog.example.com"]
    assert path == "body/div.entry/"


def test_rounds_give_one_wrapper(spark):
    rows = [(n, "http://h.example/", page(n, f"<p>text {n}</p>")) for n in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(60)
    found = wrappers.wrappers(df, fan=4).collect()
    assert len(found) == 1 and found[0]["path"] == "body/div.entry/"


def test_long_pages_and_empty_table(spark):
    text = "<p>" + "word " * 200_000
    assert len(wrappers.main_text(text, None)) == 999_999
    assert wrappers.main_text("<" * 100_000, None) == "<" * 100_000
    assert wrappers.main_text("<a '" * 20_000, None).startswith("<a '")
    assert wrappers.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_pages(spark, data):
    """In the given pages the article holds all of the text and nothing else."""
    import html

    df = spark.read.parquet(f"{data}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    for r in df.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = [re.sub(r"</?b>", "", part).replace("<br>", " ") for part in re.split(r"</?(?:p|h1)>", inside)]
        parts = [" ".join(html.unescape(part).split()) for part in parts]
        assert found[r["page_id"]] == "\n".join(part for part in parts if part)


def test_names_of_what_holds_the_article():
    body = "<p>The article itself.</p><p>Its second paragraph.</p>"
    rest = "<div class='cookie-notice'>We use cookies</div><section id='comments'><article><p>Reader</p></article></section>"
    for held in (
        f"<article class='post comments-open'>{body}</article>",
        f"<div id='content' class='has-comments'><article>{body}</article></div>",
        f"<div id='content' class='has-comments'>{body}</div>",
        f"<div class='legal-news'>{body}</div>",
        f"<div class='content with-sidebar'>{body}</div>",
        f"<div class='content widget'>{body}</div>",
        f"<div class='share'><main>{body}</main></div>",
    ):
        assert wrappers.main_text(f"<body>{rest}{held}</body>", None) == "The article itself.\nIts second paragraph.", held
    assert wrappers.main_text(f"<body><p>Short</p><div class='ad-slot'>Ad</div>{rest}</body>", None) == "Short"
    assert wrappers.main_text(f"<body>{rest}</body>", None) == ""


def test_long_template_text_is_constant(spark):
    blurb = "All the same words about this site. " * 14
    rows = [
        (i, "https://a.example/x", f"<body><div class='about'><p>{blurb}</p></div><div class='entry'><p>{f'Text {i} of its own. ' * 7}</p></div>")
        for i in range(12)
    ]
    found = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: (f"Text {i} of its own. " * 7).strip() for i, *_ in rows}


def test_attributes_are_read_as_such():
    body = "<p>The article itself.</p>"
    for held in (
        f'<article data-title="The hidden life of trees">{body}</article>',
        f'<form id="aspnetForm"><article>{body}</article></form>',
        f'<form id="aspnetForm" class=x>{body}</form>',
        f"<main><div class='elementor-widget-container'>{body}</div></main>",
        f"<main><div class='elementor-widget-container'>{body[:-4]}</p></div><div class='elementor-widget-container'></div></main>",
        f"<article><div class='overflow-hidden rounded'>{body}</div></article>",
        f"<article><div class='share-price'>{body}</div></article>",
        f"<article><section id='side-effects'>{body}</section></article>",
        f"<article><section id='legal'>{body}</section></article>",
        f"<article><div id=search title='aria-hidden=true'>{body}</div></article>",
        f"<script src=https://cdn.example/>code()</script>{body}",
        f"<article>{body}<div class='related-posts'>More</div><div class=ad-container>Ad</div><p style='color:red; display: none'>no</p><p aria-hidden=true>no</p></article>",
        f"<article>{body}<div id='comments'><p>Reader</p></div><form><p>Sign up</p></form></article>",
    ):
        assert wrappers.main_text(f"<body><nav>Home</nav>{held}</body>", None) == "The article itself.", held


def template(n, order=False):
    """A page without article: site header, a notice without a telling name, the text with its own header, an end."""
    parts = [f"<p>{f'Sentence {n} {i} of this very text. ' * 3}</p>" for i in range(1 + n % 3)]
    parts += [f"<p class='x{i}'>{f'Aside {n} {i}.'}</p>" for i in range(n % 4)]
    if order:
        parts.sort(key=lambda p: hash((n, p)))
    return (
        "<body><header><p>The site</p></header><div class='post'><header><h1>"
        f"Title {n}</h1></header><div class='strip'><p>Read us in print, too.</p></div>{''.join(parts)}<p>Thank you for reading.</p></div>"
        "<div class='end'><p>All rights</p></div></body>"
    )


def test_the_wrapper_decides_without_an_article(spark):
    """Constant slots inside the container go, the varying header stays: the page alone cannot tell."""
    pages = {n: template(n) for n in range(30)}
    df = spark.createDataFrame([(n, "https://t.example/", t) for n, t in pages.items()], SCHEMA).repartition(5)
    found = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    for n, page in pages.items():
        wanted = [f"Title {n}"] + [(f"Sentence {n} {i} of this very text. " * 3).strip() for i in range(1 + n % 3)]
        wanted += [f"Aside {n} {i}." for i in range(n % 4)]
        assert found[n].split("\n") == wanted
        assert wrappers.main_text(page, None).split("\n") != wanted
    alone = spark.createDataFrame([(1, "https://u.example/", template(1))], SCHEMA)
    assert "Read us in print" in wrappers.extract(alone).first()["text"]


def test_equal_pages_keep_their_text(spark):
    """Pages of one host that are copies: nothing varies, so nothing is the template's alone."""
    page = "<body><header><p>The site</p></header><div class='post'><p>The same words on each page.</p></div></body>"
    rows = [(n, "https://c.example/", page) for n in range(9)]
    found = wrappers.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["text"] for r in found} == {"The same words on each page."}


def test_a_wrapper_stays_bounded():
    """A thousand pages of one host with blocks in free order: the wrapper does not grow with them."""
    import random

    pick = random.Random(6)
    own, sizes = None, []
    for n in range(1000):
        parts = [f"<p class='k{i}'>text {n} {i}</p>" for i in pick.sample(range(40), pick.randrange(5, 25))]
        page = f"<body><div class='top'><p>Constant</p></div><div class='post'>{''.join(parts)}</div></body>"
        new = wrappers.page_wrapper(wrappers.blocks_of(page))
        own = new if own is None else wrappers.align(own, new)
        sizes.append(len(own))
    assert max(sizes) <= 512 and sizes[-1] <= 512
    assert wrappers.container(own) == "body/div.post/"
    assert wrappers.constants(own) == ["body/div.top/p Constant"]


def test_what_a_full_wrapper_leaves_out_still_counts(spark):
    """More shapes than a wrapper holds: the text, and a constant that comes when it is full, stand in what left it."""
    letters = "abcdefghijklmnop"
    names = ["k" + "".join(letters[i >> s & 15] for s in (8, 4, 0)) for i in range(900)]
    rows = []
    for n in range(150):
        parts = [f"<p class='{names[i]}'>text {n} {i} of its own</p>" for i in range(n % 30 * 30, n % 30 * 30 + 30)]
        notice = "<p class='note'>Read us in print</p>" if n >= 50 else ""
        side = f"<div class='more'><p>{f'{n} other words ' * 20}</p></div>"
        rows.append((n, "https://m.example/", f"<body>{side}<div class='post'>{''.join(parts)}{notice}</div></body>"))
    df = spark.createDataFrame(rows + [(1000, "https://n.example/", page(1, "<p>alone</p>"))], SCHEMA)
    whole = None
    for *_, text in rows:
        new = wrappers.page_wrapper(wrappers.blocks_of(text))
        whole = new if whole is None else wrappers.align(whole, new)
    assert wrappers.container(whole) != "body/div.post/"  # the bounded wrapper alone cannot tell
    for parts in (1, 40):
        found = {r["host"]: r for r in wrappers.wrappers(df.repartition(parts), fan=4).collect()}
        assert found["m.example"]["path"] == "body/div.post/", parts
        assert found["m.example"]["fixed"] == ["body/div.post/p.note Read us in print"], parts
        assert len(found) == 2


def test_settled_agrees_with_the_wrapper(spark):
    """Counted by rows, or told by one whole wrapper: the same container and constants."""
    sets = {
        "a": [template(n) for n in range(30)],
        "b": [page(n, f"<h2>Head {n}</h2>" + "<p>x</p>" * n) for n in range(9)],
        "c": ["<body><p>the same</p></body>"] * 5,
        "d": ["", "plain"],
        "e": [""],
    }
    rows, wanted = [], {}
    for name, pages in sets.items():
        own = None
        for text in pages:
            new = wrappers.page_wrapper(wrappers.blocks_of(text))
            own = new if own is None else wrappers.align(own, new)
        wanted[name] = (wrappers.container(own), sorted(wrappers.constants(own)))
        rows.append((name, None, wrappers.json.dumps(own)))
    df = spark.createDataFrame(rows, "host string, shape string, wrapper string")
    found = {r["host"]: (r["path"], sorted(r["fixed"])) for r in wrappers.settled(df).collect()}
    wanted.pop("e")  # an empty wrapper has no slot
    assert found == wanted
