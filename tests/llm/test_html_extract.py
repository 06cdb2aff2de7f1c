import time

from mrloom.llm import html_extract as M

LONG = "This is a long sentence, with commas, and it goes on. " * 6
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><article><h1>Head &amp; line</h1><p>{LONG}<p><b>Sub<br><p>{LONG}</article><footer>&copy; us</footer></body></html>", f"Head & line {LONG}Sub {LONG}".strip()),
    (f"<body><div class='cookie-notice'><p>We use cookies, yes.</p></div><div id=content><h2>Title</h2><p>{LONG}</p><div class='sidebar'><p>{LONG}</p></div></div><div class=comments><p>{LONG}</p></div></body>", f"Title {LONG}".strip()),
    (f"<main><header><h1>Top</h1></header><p>a<b>b</b>c {LONG}</p><aside>see also</aside><form><input><button>Go</button></form><script>var x='</p>';</script></main>", f"Top abc {LONG}".strip()),
    (f"<header>Site name</header><main><p>{LONG}<!-- <p>no</p> --></p></main><div class=\"ad\">{LONG}</div>", LONG.strip()),
    ("", ""),
    (None, ""),
    ("<p></p>", ""),
    ("only text", "only text"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("<article><p>x &lt;tag&gt; &#233; &nbsp; y</p></article>", "x <tag> é y"),
    ("<ul><li>one, and more, of this<li>two, and more, of this</ul>", "one, and more, of this two, and more, of this"),
]


BLOCK = "x" * 117 + ", y."
QUOTE = "A much longer sentence of a quote, of sixty characters or so. " * 24
TEXT = f"Head {BLOCK} Part {' '.join([BLOCK] * 39)} {QUOTE}".strip()
BODY = f"<h1>Head</h1><p>{BLOCK}</p><h2>Part</h2>" + f"<p>{BLOCK}</p>" * 39 + f"<blockquote><p>{QUOTE}</p></blockquote>"
MENU = "<ul>" + "<li><a href=x>Menu item</a></li>" * 9 + "</ul>"


def test_one_long_block_does_not_remove_the_rest():
    for page in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<body>{MENU}<div>{BODY}</div></body>", f"<body>{MENU}{BODY}</body>", f"<body>{BODY}</body>"):
        assert M.extract(page) == TEXT, page[:60]
    assert M.extract(f"<article><p>Short.</p><div>{QUOTE * 40}</div></article>") == f"Short. {QUOTE * 40}".strip()
    assert M.extract(f"<body><h1>Head</h1><div><p>{QUOTE}</p></div></body>") == f"Head {QUOTE}".strip()
    assert M.extract(f"<body>{MENU}one <b>bold</b> and <a>link</a>, <i>more</i><h2>Sub</h2><p>{QUOTE}</p></body>") == f"one bold and link, more Sub {QUOTE}".strip()


def test_names_do_not_empty_a_page():
    for page in (
        f"<body class='single no-sidebar'><div class='entry'><h2>Title</h2><p>{LONG}</p></div></body>",
        f"<html class='hidden'><body><div id='content' class='with-sidebar'><h2>Title</h2><p>{LONG}</p></div></body></html>",
        f"<body><form action='x'><h2>Title</h2><p>{LONG}</p><input></form></body>",
        f"<body><nav>{LONG * 3}</nav><div class='with-sidebar'><h2>Title</h2><p>{LONG}</p><div class='sidebar'><p>{LONG[:150]}</p></div></div></body>",
        f"<body class='no-sidebar'><h2>Title</h2><p>{LONG}</p><form><label>Mail</label><p>Your mail, please.</p></form></body>",
    ):
        assert M.extract(page) == f"Title {LONG}".strip(), page[:60]


def test_marks_and_quotes_do_not_leak():
    assert M.extract("<article><p>" + "\u0130" * 10 + "</p><script>var a = '<p>no</p>';</SCRIPT><p>First words stay.</p></article>") == "\u0130" * 10 + " First words stay."
    for page in ("<p data-x=it's>Hello", '<p title=5">Hello', "<p>Hello</p><div class=\"x", "<p>Hello</p><div class='x<y", "<p>Hello</p><a", "<p title = \"a > b\">Hello</p>", "<p 'x'>Hello</p>", "<p aria-hidden=false data-role=menu title='class=ad'>Hello</p>"):
        assert M.extract(page) == "Hello", page
    assert M.extract("<p>a < b and <b>c</b> =\"d\"</p>") == 'a < b and c ="d"'


def test_shared_names_are_judged_by_their_ratio():
    prose, links = f"<p>{LONG}</p>", "<ul>" + "<li><a href=x>Another page</a></li>" * 5 + "</ul>"
    for name in ("id='related'", "class='share-of-voice header'", "class='post tags'"):
        assert M.extract(f"<article><p>{LONG}</p><section {name}>{prose}</section></article>") == f"{LONG}{LONG}".strip(), name
        assert M.extract(f"<article><p>{LONG}</p><section {name}>{links}</section></article>") == LONG.strip(), name
        assert M.extract(f"<body><div><p>{LONG}</p><section {name}>{prose}</section></div></body>") == f"{LONG}{LONG}".strip(), name
        assert M.extract(f"<body><div><p>{LONG}</p><section {name}>{links}</section></div></body>") == LONG.strip(), name
        assert M.extract(f"<body><section {name}><p>Only this.</p></section></body>") == "Only this."
    assert M.extract(f"<article><p>{LONG}</p><div class='comments'>{prose}</div></article>") == LONG.strip()
    lines = " ".join(f"Short line {k}" for k in range(500))
    assert M.extract("<article>" + "".join(f"<p>Short line {k}</p>" for k in range(500)) + f"<blockquote>{LONG * 30}</blockquote></article>") == f"{lines} {LONG * 30}".strip()


def test_pages():
    for page, text in PAGES:
        assert M.extract(page) == text, page


def test_table(spark):
    rows = [(i, "u", p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], "x"), (0, "u", PAGES[0][0], "x")]
    got = M.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] is not None} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert M.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_of_which_a_part_is_furniture_are_judged_by_their_ratio():
    prose, links = f"<p>{LONG}</p>", "<ul>" + "<li><a href=x>Another page</a></li>" * 5 + "</ul>"
    for name in ("id='hidden-gems'", "class='ad-hoc-networks'", "id='menu-planning'", "id='promotion-of-science'", "id='comments-on-the-proof'", "class='code-comment'", "id='cookie-recipe'", "id='navigation-at-sea'", "class='no-ad'", "class='reviews'"):
        for page in (f"<article>{prose}<section {name}>{prose}</section></article>", f"<body><div>{prose}<section {name}>{prose}</section></div></body>"):
            assert M.extract(page) == f"{LONG}{LONG}".strip(), name
    for name in ("id='menu-planning'", "class='navigation-at-sea'"):
        assert M.extract(f"<article>{prose}<section {name}>{links}</section></article>") == LONG.strip(), name
    for name in ("comments", "comment-list", "sidebar-left", "ad-slot", "cookie-notice", "site-footer", "newsletter-signup", "user-reviews", "reply", "commentlist", "main-nav"):
        assert M.extract(f"<article>{prose}<div class='post {name}'>{prose}</div></article>") == LONG.strip(), name
    for tag in ("fieldset", "map", "object", "canvas", "menu", "noscript"):
        assert M.extract(f"<article>{prose}<{tag}>{prose}</{tag}></article>") == f"{LONG}{LONG}".strip(), tag
        assert M.extract(f"<article>{prose}<{tag}>{links}</{tag}></article>") == LONG.strip(), tag
    assert M.extract(f"<article>{prose}<noscript>Please enable scripts to see this.</noscript><form><fieldset>{prose}</fieldset></form></article>") == LONG.strip()


def test_comments_and_adverts_longer_than_the_article():
    prose = f"<p>{LONG}</p>"
    comments = "".join(f"<div class=reply><p>{LONG}</p></div>" for _ in range(4))
    assert M.extract(f"<main>{prose}{comments}<ol class='commentlist'><li>{LONG}</ol><div id='user-reviews'>{prose}</div></main>") == LONG.strip()
    assert M.extract(f"<body><div class='post'>{prose}</div><div class='comments'>{prose * 5}</div></body>") == LONG.strip()
    assert M.extract(f"<body><a href=x>Skip</a><div class='modal'>{prose * 5}</div></body>").endswith((LONG * 5).strip())
    assert M.extract(f"<body><article>{prose * 3}</article><div class='promoted'>{LONG * 40}</div></body>") == (LONG * 3).strip()


def plain_tree(page):
    """Tags with their parents by a walk up the open elements."""
    found, here = [("", -1)], 0
    for m in M.TAG.finditer(page):
        tag = (m[2] or "").lower()
        if not tag or tag in M.RAW:
            continue
        if m[1]:
            x = here
            while x and found[x][0] != tag and not (tag in M.INLINE and found[x][0] not in M.INLINE):
                x = found[x][1]
            if x and found[x][0] == tag:
                here = found[x][1]
            continue
        for ends, limits in ((M.CLOSES.get(tag, ()), M.BARS), (("p",) if tag in M.ENDS_P else (), M.BARS | {"td", "th", "li"})):
            x = here
            while ends and x and found[x][0] not in ends and found[x][0] not in limits:
                x = found[x][1]
            if x and found[x][0] in ends:
                here = found[x][1]
        if tag not in M.VOID:
            found.append((tag, here))
            here = len(found) - 1
    return found


def test_elements_equal_a_walk_up_and_no_page_fails():
    import random

    rng = random.Random(1)
    tags = ["div", "p", "b", "a", "li", "ul", "h1", "h2", "article", "main", "section", "tr", "td", "table", "blockquote", "nav", "form", "header", "br", "i", "dl", "dt", "dd", "body", "aside", "option", "select", "noscript"]
    named = ["", "", " class='related'", " id=share", " class=ad", " class='ad-hoc'"]
    for _ in range(3000):
        page = "".join(f"<{rng.choice(tags)}{rng.choice(named)}>" if (r := rng.random()) < 0.5 else f"</{rng.choice(tags)}>" if r < 0.8 else rng.choice(["word ", "A sentence, with commas, and more. " * 3]) for _ in range(rng.randint(1, 30)))
        read = M.Page(page)
        assert list(zip(read.tags[1:], read.parents[1:], strict=True)) == plain_tree(page)[1:]
        M.extract(page)


def test_nested_text_takes_time_in_proportion():
    for page in ("<div>x" * 100_000, "<b>x" * 100_000, "<h1>x" * 100_000, "<i>" * 50_000 + "</b>" * 50_000, "<ul>" + "<b>" * 50_000 + "<li>x" * 50_000, "<div class=related>x" * 50_000, "<a>x" * 50_000, "<b>" * 50_000 + "<p>x" * 20_000):
        began = time.process_time()
        M.extract(page)
        assert time.process_time() - began < 10, page[:20]


def test_hostile_pages_end_soon():
    began = time.time()
    for page in ("<div>" * 20000 + "x", "<p" * 50000, '<a href="' * 3000, "<!--" * 5000, "</b>" * 50000, "<article>" + "<p>word, word.</p>" * 20000):
        M.extract(page)
    assert time.time() - began < 60
