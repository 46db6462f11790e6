import pytest

from tessera.llm import html_extract as X

LONG = "The first paragraph of the article, with a few commas, is long enough to count as text."
PAGES = {
    "plain article": (f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav>"
                      f"<article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"Title\n{LONG}\nShort."),
    "unclosed tags": (f"<body><div class=ad>buy</div><article><h1>T</h1><p><b>{LONG}<br><p>two\n  words</p></article><footer>f", f"T\n{LONG}\ntwo words"),
    "entities": (f"<article><p>{LONG} &lt;p&gt; &amp;amp; caf&eacute; &#8212;&nbsp;x &amp y</p></article>", f"{LONG} <p> &amp; café — x & y"),
    "no semantic tags": (f"<body><div id=menu><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div id=wrap><div class=story><p>{LONG}</p>"
                         f"<p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div></div></body>", f"{LONG}\n{LONG}"),
    "link lists lose": (f"<body><div><p><a href=1>{LONG}</a></p><p><a href=2>{LONG}</a></p><p><a href=3>{LONG}</a></p></div><div><p>{LONG}</p><p>{LONG}</p></div></body>",
                        f"{LONG}\n{LONG}"),
    "forms, notices, hidden": (f"<main><div class='cookie-notice'>We use cookies</div><form><p>{LONG}</p></form><p hidden>no</p><p style='display: none'>no</p>"
                               f"<p>{LONG}</p><div role=alert>no</div><aside>no</aside></main>", LONG),
    "comments of readers": (f"<article><p>{LONG}</p><section class=comments><article class=comment><p>{LONG}</p></article></section></article>", LONG),
    "article header stays": (f"<header>Site</header><article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG}"),
    "siblings": (f"<body><div><h2>Heading</h2><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p></div></body>", f"Heading\n{LONG}\n{LONG}\n{LONG}\n{LONG}"),
    "inline tags": ("<article><p>one <i>two</i><span>three</span> <a href=x>four</a></p></article>", "one twothree four"),
    "list and table": (f"<article><p>{LONG}</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", f"{LONG}\na\nb\nc\nd"),
    "empty": ("", ""), "null": (None, ""), "only markup": ("<html><body><nav>menu</nav></body></html>", ""), "text alone": ("just text", "just text"),
    "cut off": (f"<article><p>{LONG}</p><p class='x", LONG),
}

ARTICLE = f"<p>{LONG}</p><p>{LONG}</p>"
SIDE = f"<div class=sidebar><p>{LONG}</p></div>"
WRAPPED = {  # every one holds the same two paragraphs as its article
    "has-sidebar": f"<body><div class='page has-sidebar'><article>{ARTICLE}</article>{SIDE}</div></body>",
    "id": f"<body><div>We print news, every day.</div><div id='content-social'><article>{ARTICLE}</article></div></body>",
    "widgets": f"<body><div class='elementor-widget'><p>{LONG}</p></div><div class='elementor-widget'><p>{LONG}</p></div></body>",
    "nested": f"<body><div class=overflow-hidden><div class='wrap cookies-accepted'><main>{ARTICLE}</main></div>{SIDE}</div></body>",
    "article's own class": f"<body><article class='post comments-open'>{ARTICLE}</article></body>",
    "header word": f"<body><div class=has-header><div>{ARTICLE}</div></div></body>",
    "form": f"<body><form action=x><input name=q><div>{ARTICLE}</div></form></body>",
    "menu": f"<body><menu><li>Home<li>News</menu><article>{ARTICLE}</article></body>",
    "select": f"<body><select><option>A</select><article>{ARTICLE}</article></body>",
    "noscript": f"<body><noscript><p>x</noscript><article>{ARTICLE}</article></body>",
    "button": f"<body><button><div>x</button><template><p>x</template><article>{ARTICLE}</article></body>",
    "comments are longer": f"<body><div class=story>{ARTICLE}</div><div id=comments>" + f"<div class=comment><p>{LONG}</p></div>" * 30 + "</div></body>",
    "consent is longer": f"<body><div class=story>{ARTICLE}</div><div class='cookie-consent'>" + f"<p>{LONG}</p>" * 30 + "</div></body>",
    "teasers": f"<body><article>{ARTICLE}<div class=related><article><p>Read this, too.</p></article></div></article></body>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrappers_of_the_article_stay(name):
    assert X.main_text(WRAPPED[name]) == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert X.main_text(html) == want


def test_deep_and_long():
    assert X.main_text("<div>" * 20_000 + LONG) == LONG
    many = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    assert X.main_text(many) == "\n".join([LONG] * 5000)


def test_operator(spark):
    rows = [(i, None if i == 3 else "u", h, "clash") for i, (h, _) in enumerate(PAGES.values())] + [(None, "u", PAGES["inline tags"][0], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in X.with_length(X.extract(df)).collect()}
    for r, (_, want) in zip(rows, PAGES.values(), strict=False):
        assert got[r[0]] == (r[1], want, len(want))
    assert got[None][1] == "one twothree four"
    assert X.extract(df.limit(0)).count() == 0


BROKEN = {  # (page, what is kept of it): each takes time in proportion to its length
    "text at every level": ("<div>some text, " * 8_000, None),
    "unfinished tags": (f"<article><p>{LONG}</p>" + "<a " * 100_000, LONG),
    "unfinished declarations": (f"<p>{LONG}</p>" + "<!x <?y " * 50_000, LONG),
    "unclosed comment": (f"<p>{LONG}</p><!-- x <p>The first paragraph, inside", LONG),
    "many unclosed comments": (f"<p>{LONG}</p>" + "<!-- <p>x</p> " * 20_000, LONG),
    "comment in a script": (f"<script>x = '<!--'</script><p>{LONG}</p>", LONG),
    "inline tags that stay open": ("<span><p>some text, " * 10_000, None),
    "stray end tags": (f"<p>{LONG}</p>" + "<span>" * 10_000 + "</section></p>" * 10_000, LONG),
    "headers": ("<div class=header>x" * 5_000, None),
    "lists": ("<ul>" + "<li><span>t" * 10_000, None),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    import time
    html, want = BROKEN[name]
    began = time.time()
    got = X.main_text(html)
    assert time.time() - began < 5
    assert want is None or got == want


def test_articles_side_by_side():
    two = f"<body><article><p>{LONG}</p></article><article><p>{LONG} More.</p></article><article><p>Tiny.</p></article></body>"
    assert X.main_text(two) == f"{LONG}\n{LONG} More."


def brute_best(root):
    """The best container, scored node by node from the definition: every paragraph's own text
    is gathered again, and every ancestor found by walking up."""
    def inside(n):
        for k in n.kids:
            if isinstance(k, str):
                yield n, k
            elif not k.drop:
                yield from inside(k)

    def block_of(n):
        while n.tag not in X.BLOCK:
            n = n.parent
        return n

    def linked(n):
        while n is not None and n.tag != "a":
            n = n.parent
        return n is not None

    pieces = list(inside(root))
    size = lambda t: len(" ".join(t.split()))
    paragraphs = []
    for n, _ in pieces:
        b = block_of(n)
        if b not in paragraphs and b.tag in X.PARAGRAPHS and b.parent is not None:
            paragraphs.append(b)
    score = {}
    for p in paragraphs:
        own = " ".join("".join(t for n, t in pieces if block_of(n) is p).split())
        if not own:
            continue
        points = min(1, len(own) / 25) + own.count(",") + min(len(own) / 100, 3)
        a = p.parent
        for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            if a is None:
                break
            score[a] = score.get(a, X.START_SCORE.get(a.tag, 0) + (25 if a.words & X.GOOD_WORDS else 0)) + points * share
            a = a.parent

    def below(n, top):
        while n is not None and n is not top:
            n = n.parent
        return n is top
    out = {}
    for a, s in score.items():
        own = [(n, t) for n, t in pieces if below(n, a)]
        chars = sum(size(t) for _, t in own)
        out[a] = s * (1 - (sum(size(t) for n, t in own if linked(n)) / chars if chars else 0))
    return out


def random_page(rng):
    def part(depth):
        kind = rng.choice(["p", "p", "div", "div", "section", "ul", "td", "a", "b", "text", "text", "nav", "blockquote"])
        if kind == "text" or depth > 6:
            return " ".join(rng.choice(["word", "comma,", "x", "sentence."]) for _ in range(rng.randint(1, 40)))
        cls = rng.choice(["", "", " class=content", " class='post body'", " class=box"])
        return f"<{kind}{cls}>" + " ".join(part(depth + 1) for _ in range(rng.randint(1, 4))) + (f"</{kind}>" if rng.random() < 0.9 else "")
    return "<body>" + "".join(part(0) for _ in range(rng.randint(1, 5))) + "</body>"


def test_scores_against_brute_force():
    import random
    rng = random.Random(8)
    for _ in range(200):
        tree = X._Tree()
        tree.feed(random_page(rng))
        tree.close()
        X._settle(tree.root)
        want = brute_best(tree.root)
        best = X._best(X._measure(tree.root))
        if best is None:
            assert not want
            continue
        assert all(n.score == pytest.approx(s) for n, s in want.items())
        assert want[best] == pytest.approx(max(want.values()))
