import random

from skylattice.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>x";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><div class="cookie-notice"><p>We use cookies. Accept them.</p></div>
<article><h1>Of cats &amp; dogs</h1><p>Cats are   quiet&nbsp;animals.<br>They sleep <b>a lot</b> of the day.</p><!-- <p>no</p> -->
<p>Dogs are loud, and they like to run around in the garden.</p><div class="ad">Buy food now!</div>
<form><label>Name</label><input><button>Send</button></form><p>The end of it all &lt;here&gt;.</p></article>
<aside class="sidebar"><h3>Related</h3><p>Other animals are nice too.</p></aside>
<section id="comments" class="comments"><h3>Comments</h3><div class="comment"><p>I like cats. They are the best.</p></div></section>
<footer>&copy; example.com &middot; All rights reserved.</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE, html.model()).split("\n") == [
        "Of cats & dogs", "Cats are quiet animals. They sleep a lot of the day.", "Dogs are loud, and they like to run around in the garden.", "The end of it all <here>.",
    ]


def test_held_out_accuracy():
    r, crf, right, total = random.Random(99), html.model(), 0, 0
    for _ in range(60):
        found = html.blocks(html.labelled_page(r))
        labels = [int(b.text.startswith(html.MAIN)) for b in found]
        for b in found:
            b.text = b.text.removeprefix(html.MAIN) or "."
        right += sum(a == b for a, b in zip(labels, crf.viterbi(html.features(found))))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_against_all_labellings():
    import itertools

    crf = html.model()
    page = html.features(html.blocks(PAGE))[:9]
    emit, steps = crf.scores(page), crf.steps
    score = lambda y: sum(e[k] for e, k in zip(emit, y)) + sum(steps[a, b] for a, b in zip(y, y[1:]))
    assert tuple(crf.viterbi(page)) == max(itertools.product((0, 1), repeat=len(page)), key=score)


def test_broken_and_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<p>a<p>b</i></p></div>", "<script>", "<!-- ", "text only. " * 50000, "<div>" * 5000 + "x", "<a href='", "<b>" * 3000, '<p class="a' * 2000):
        html.main_text(page, html.model())
    assert [b.text for b in html.blocks("<p>a<p>b<li>c<li>d<br>e")] == ["a", "b", "c", "d e"]
    assert [(b.text, b.hidden) for b in html.blocks('<div hidden>x</div>t<p style="display:none">y</p><p>z</p>')] == [("x", True), ("t", False), ("y", True), ("z", False)]
    assert [b.linked for b in html.blocks("<p><a href=/x/>Link</a> text</p><p><a name='x'/>Text</p>")] == [4, 0]


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>Short</p>"), (3, "w", "")]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("?")).withColumn("n_chars", F.lit("?"))
    got = html.extract(pages).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(pages.limit(0)).collect() == []


def test_hidden_is_an_attribute_only():
    for shown in ('class="post overflow-hidden"', 'class="md:hidden"', 'title="The hidden cost"', 'data-hidden="1"', 'title="display:none"', "class=hidden-xs", 'hidden="false"'):
        assert [b.text for b in html.blocks(f"<div {shown}><p>z</p></div>")] == ["z"], shown
        assert html.main_text(f"<article><div {shown}><p>The end of it all is here, and it is long.</p></div></article>", html.model())
        assert not html.blocks(f"<div {shown}><p>z</p></div>")[0].hidden
    for gone in ("hidden", 'class="a" hidden', 'hidden=""', "HIDDEN=until-found", 'aria-hidden="true"', "style='color:red; display : none'"):
        assert html.blocks(f"<div {gone}><p>z</p></div>")[0].hidden, gone


def test_elements_left_open_end_with_their_parent():
    texts = lambda page: [b.text for b in html.blocks(page)]
    rest = "<article><p>One.</p><p>Two.</p></article>"
    search = "<div><input list=l><datalist id=l><option value=a>A<option value=b>B</datalist></div>"
    assert texts(search + rest) == texts(f"<div><select><option>A<option>B</select></div>{rest}") == ["One.", "Two."]
    for tag in ("object", "noscript"):
        assert texts(f"<div><{tag}></div>{rest}") == ["One.", "Two."] and texts(f"<div><{tag}><p>x</p></{tag}></div>{rest}") == ["x", "One.", "Two."], tag
    for tag in ("button", "svg", "canvas", "template", "select", "textarea", "iframe"):
        assert texts(f"<div><{tag}></div>{rest}") == ["One.", "Two."] and texts(f"<div><{tag}>{rest}")[-2:] == ["One.", "Two."], tag
        assert texts(f"<div><{tag}><p>x</p></{tag}></div>{rest}") == ["One.", "Two."], tag
    assert texts("<p>As <math><mi>x</mi></math> grows.</p>") == ["As x grows."]
    assert texts("<p>a</p><script>b<p>c</p>") == ["a"]


A, B, C = (
    "The old mill stood by the river for two hundred years before anyone thought of painting it.",
    "Nobody knows who built the wheel. It turned until the winter of the great flood, and then it stopped.",
    "What is left of it can be seen in the museum of the town, next to the boats.",
)
#: Layouts written by hand, not by the generator: pages and their main text.
LAYOUTS = {
    "blog with a sidebar layout": (
        f"""<html><body class="home sidebar-right header-fixed"><div id="page" class="has-sidebar"><header class="site-header"><a href="/">My blog</a><ul class="menu"><li><a href=/x/>One</a></li><li><a href=/y/>Two</a></li></ul></header>
        <div class="row"><div class="col-8"><div class="header-image-article"><h2>The mill</h2><p>{A}</p><p class="more-info">{B}</p><p>{C}</p></div></div>
        <div class="col-4 sidebar"><h4>About me</h4><p>I write about mills and rivers, and I live close to one.</p></div></div><div id="footer"><p>Made with love. All rights reserved.</p></div></div></body></html>""",
        ["The mill", A, B, C],
    ),
    "news with notices and noscript": (
        f"""<body><noscript>Please enable JavaScript.</noscript><div class="cookie-banner" role="dialog"><p>We use cookies to make this site better. Do you agree?</p><button>Yes</button></div>
        <nav class="topnav"><a href=/>News</a> | <a href=/s>Sport</a></nav><main><article class="story no-ads"><h1>Mill found</h1><p>{A}</p><aside class="related"><a href=/r>Read also: the other mill</a></aside>
        <p>{B}</p><noscript><p>The picture shows the mill from the south side.</p></noscript><p>Its speed is <math><mi>v</mi><mo>=</mo><mn>3</mn></math> metres a second.</p></article></main>
        <section class="reader-comments"><h3>2 comments</h3><div class="comment"><p>Lovely mill, I have been there with my mother.</p></div></section><footer>&copy; 2020</footer></body>""",
        ["Mill found", A, B, "The picture shows the mill from the south side.", "Its speed is v=3 metres a second."],
    ),
    "tables": (
        f"""<table><tr><td class="nav"><a href=1>Home</a><br><a href=2>Maps</a></td><td><h1>The mill</h1><p>{A}</p><blockquote>{B}</blockquote><ul><li>{C}</li></ul></td></tr></table><div class=copyright>Copyright of the town. All rights reserved.</div>""",
        ["The mill", A, B, C],
    ),
    "hidden answer": (
        f"""<div class="content"><p>{A}</p><p>{B}</p><p hidden>{C}</p></div><div class="newsletter" style="display:none"><p>Subscribe to our letter, it comes every week.</p></div>""",
        [A, B, C],
    ),
    "bare": (f"<h1>The mill</h1><p>{A}<p>{B}<p>{C}", ["The mill", A, B, C]),
    "wrapper with an advert's name": (
        f"""<div class="ad-free-content"><div class="promo-story"><p>{A}</p><p>{B}</p></div></div><div class="ad-slot ad"><p>Buy a mill today. It is cheap.</p></div><div class="article-footer"><p>Written by Ann Miller.</p></div>""",
        [A, B],
    ),
}


def test_layouts_written_apart_from_the_generator():
    got = {name: html.main_text(page, html.model()).split("\n") for name, (page, _) in LAYOUTS.items()}
    assert got == {name: texts for name, (_, texts) in LAYOUTS.items()}


def test_gradient_against_differences():
    """The gradient ascent's first step is along the likelihood's slope, here by differences over all labellings."""
    import itertools

    import numpy as np

    r = random.Random(3)
    pages = [[((r.choice("ab"),), (r.choice("cd"),)) for _ in range(n)] for n in (1, 2, 4)]
    labels = [[r.randrange(2) for _ in page] for page in pages]

    def likelihood(crf):
        total = 0.0
        for page, y in zip(pages, labels):
            emit = crf.scores(page)
            score = lambda z: sum(e[k] for e, k in zip(emit, z)) + sum(crf.steps[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            total += score(y) - np.log(sum(np.exp(score(z)) for z in itertools.product((0, 1), repeat=len(page))))
        return total - 0.15 * ((crf.weights**2).sum() + (crf.steps**2).sum())

    best = html.fit(pages, labels, rounds=4000, rate=0.2, penalty=0.3)
    top = likelihood(best)
    for array in (best.weights, best.steps):
        for i in np.ndindex(array.shape):
            for step in (0.05, -0.05):
                array[i] += step
                best.sums.clear()
                assert likelihood(best) < top + 1e-5
                array[i] -= step
