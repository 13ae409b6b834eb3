import functools
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from voxlake.llm import chat_format, site_style

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body class=home>
<header><p>Site name</p></header><nav><ul><li><a href="/">Menu</a></ul></nav><!-- <p>note</p> --><div class="ad">Buy</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>word<br>next &eacute;.<p>Second
  line</p><ul><li>one<li>two</ul><aside>side</aside><div class="comments"><p>nice!</p></div><form>sign up</form></article></main>
<footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert site_style.main_text(site_style.parse(PAGE), set()) == "Title & more First boldword next é. Second line one two"
    assert site_style.main_text(site_style.parse("<article><p>a<b>b</p><p>c &am"), set()) == "ab c &am"
    assert site_style.main_text(site_style.parse("plain < text > here"), set()) == "plain < text > here"
    assert site_style.main_text(site_style.parse("</div></p>"), set()) == ""


def test_images_and_formulas_do_not_swallow_the_page():
    for icon in (
        '<svg class="icon"/>', "<math/>", "<svg><title/><path d='M0'/></svg>", "<svg><title>Icon</title><path d='M0'>", "<svg><desc>no",
        "<svg><style>a > b {}</style><g/></svg>", "<object data='x'/>",
    ):
        page = f"<body><div>{icon}</div><article><p>Before</p>{icon}<p>the <b>story</b></p></article><p>out</p></body>"
        assert site_style.main_text(site_style.parse(page), set()) == "Before the story"
    page = "<article>so <math><mi>x</mi><annotation>TeX</annotation></math> is <object data='f'><p>a film</p></object>it</article>"
    assert site_style.main_text(site_style.parse(page), set()) == "so x is a film it"


def test_names_do_not_drop_the_article():
    story = "<article><p>story</p></article>"
    for page in (
        f"<body class='has-sidebar search'>{story}</body>", f"<div class='content no-sidebar'>{story}</div>", f"<div class='widget'>{story}</div>",
        "<article id='notice-12'>story</article><div class=sidebar>x</div>", "<div class='layout-with-banner search-enabled'><p>story</p></div>",
        "<div class='banner'><main>story</main></div><div class='related'><article>x</article></div>", "<div class='content widget'><p>story</p></div>",
        f"{story}<div class='comments'><article class='comment'>x</article></div>", "<article><div class='notice'>story</div></article>",
    ):
        assert site_style.main_text(site_style.parse(page), set()) == "story", page


def test_site_tree_drops_what_a_site_repeats(spark):
    rows = [
        (i, f"http://www.s.org/{i}", f"<body><div class=intro>Welcome to the site</div><div class=tale><p>story {i} {i * 7}</p></div></body>")
        for i in range(30)
    ]
    rows += [(100, "http://lone.org/", "<body><div class=intro>Welcome to the site</div></body>"), (101, None, None), (102, "", "")]
    frame = spark.createDataFrame([*rows, (None, "http://s.org/", "<p>no id"), rows[0]], "page_id long, url string, html string")
    got = site_style.extract(frame.selectExpr("*", "1 as path", "2 as host", "3 as low")).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == 35
    assert all(by_id[i] == f"story {i} {i * 7}" for i in range(30))
    assert by_id[100] == "Welcome to the site" and by_id[101] == by_id[102] == "" and by_id[None] == "no id"
    assert site_style.extract(frame.limit(0)).collect() == []


def test_boilerplate_inside_an_article_s_path_stays(spark):
    rows = [(i, "http://s.org/", f"<article><p>Same words everywhere</p><p>own {i}</p></article>") for i in range(20)]
    got = site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Same words everywhere own {i}" for i in range(20)}


def extracted(spark, pages, host="s.org"):
    rows = [(i, f"http://{host}/{i}", page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_the_tree_judges_pages_that_mark_their_article(spark):
    pages = [f"<body><main><p>story {i}</p></main><article><p>Read our magazine</p></article></body>" for i in range(20)]
    assert extracted(spark, pages) == {i: f"story {i}" for i in range(20)}


def test_pages_that_agree_keep_their_text(spark):
    same = "<body><nav>menu</nav><article><p>the story</p></article></body>"
    assert set(extracted(spark, [same] * 8).values()) == {"the story"}
    plain = "<body><div class=a><p>one</p></div><div class=b>two</div></body>"
    assert set(extracted(spark, [plain] * 8).values()) == {"one two"}


def test_what_articles_say_alike_stays(spark):
    page = "<article><p class=byline>by A. Writer</p><div class=lead>Lead</div><p>one {0}</p><p class='share'>two</p><p class='related search'>three</p></article>"
    got = extracted(spark, [page.format(i) for i in range(8)])
    assert got == {i: f"by A. Writer Lead one {i} two three" for i in range(8)}
    inside = "<main><p>text</p><div class='cookie-notice'>ok?</div><div class=ad>buy</div><div class=comments>me too</div><form>f</form></main>"
    assert extracted(spark, [inside])[0] == "text"


def test_the_tree_alone_finds_menus_and_adverts(spark):
    """No telling tags, classes or ids: the menu is on every page, an advert of five on each, ids of headings differ."""
    page = (
        "<body><div class=xa><a href=1>Home</a> <a href=2>Topics {2}</a></div><div class=xb><p>Buy {1} now</p></div>"
        "<div class=xc><h2 id='on-{0}'>On {0}</h2><p>The tale of {0}.</p><p>Its end {0}.</p></div><div class=xd>All rights reserved</div></body>"
    )
    names = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    got = extracted(spark, [page.format(n, f"thing {i % 5}", "a b c"[2 * (i % 3)]) for i, n in enumerate(names)])
    assert got == {i: f"On {n} The tale of {n}. Its end {n}." for i, n in enumerate(names)}


def test_importance_is_the_plain_one(spark):
    rng = random.Random(2)

    def some(depth):
        if depth > 4 or rng.random() < 0.3:
            return rng.choice(["same", "x", f"own {rng.randrange(99)}", ""])
        return "".join(f"<div class={rng.choice('abc')}>{some(depth + 1)}</div>{rng.choice(['', 'tail'])}" for _ in range(rng.randint(1, 3)))

    pages = [f"<body>{some(0)}</body>" for _ in range(15)]
    pages[3] = "<div>" * 100 + "deep" + "</div>" * 100
    here, styles, said, parent = defaultdict(set), defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), {}
    for i, page in enumerate(pages):
        for e, style, texts in site_style.nodes(site_style.parse(page)):
            here[e.path].add(i)
            styles[e.path][style] += 1
            parent[e.path] = e.above
            for t in texts:
                said[e.path][t][i] += 1

    def entropy(counts):
        total = sum(counts)
        return -sum(c / total * math.log(c / total) for c in counts)

    @functools.cache
    def composite(path):
        n = len(here[path])
        alone, scale = n < 2, math.log(max(n, 2))
        # A style is counted by page and style; the same style twice on a page counts twice.
        own = 1.0 if alone else min(1.0, entropy(styles[path].values()) / scale)
        below = [composite(p)[0] for p in parent if parent[p] == path]
        parts = list(below)
        if alone:
            parts.append(1.0)
        elif said[path]:
            weight = sum(sum(c.values()) for c in said[path].values())
            parts.append(max(0.0, min(1.0, 1 - sum(sum(c.values()) * entropy(c.values()) for c in said[path].values()) / weight / scale)))
        keep, mean = site_style.DECAY ** len(styles[path]), sum(parts) / len(parts) if parts else own
        value = (1 - keep) * own + keep * mean if below else mean
        return value, max([value, *(composite(p)[1] for p in parent if parent[p] == path)])

    rows = spark.createDataFrame([(i, None, page, "h") for i, page in enumerate(pages)], "page_id long, url string, html string, host string")
    got = {r.path: (r.importance, r.peak, r.pages) for r in site_style.importance(site_style.page_nodes(rows).filter("kind < 3")).collect()}
    assert got.keys() == here.keys()
    for path in here:
        assert got[path] == (*(pytest.approx(x) for x in composite(path)), len(here[path]))


TURNS = [
    (1, 0, "system", "be\\kind"), (1, 1, "user", "hi <|im_end|>\n"), (1, 2, "assistant", "yo <\\| \\"), (1, 3, "user", "more"),
    (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", None), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"),
    (4, 1, "ro\nle", "<|im_start|>assistant\nok<|im_end|>"), (4, None, None, "x"), (None, 0, "assistant", "lost"), (4, 2, "assistant", "é" * 90_000),
]


@pytest.fixture
def examples(spark):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    return chat_format.expand_turns(frame.selectExpr("*", "1 as part", "2 as seq", "3 as head", "4 as added"))


def test_examples_read_back(examples):
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in turns)
        loss = "".join(text or "" for _, _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_whole_examples_hold_all_context(examples):
    whole = chat_format.whole_examples(examples).collect()
    assert len(whole) == sum(t[2] == "assistant" for t in TURNS)
    first = sorted((r for r in whole if r.conv_id == 1), key=lambda r: len(r.text))
    assert [r.text.count(chat_format.START) for r in first] == [3, 5] and first[1].text.startswith(first[0].text)
    assert [chat_format.unescape(r.text[r.loss_start : r.loss_end]) for r in first] == ["yo <\\| \\", ""]
    total = {r.conv_id: r.formatted_chars for r in chat_format.read_back(examples).collect()}
    assert total[1] == sum(len(r.text) for r in first) and total[2] == 0


def test_parts_of_examples_are_the_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK_ROWS", 4)
    rng = random.Random(4)
    turns = [(c, t, rng.choice(["user", "assistant", "assistant", "tool"]), "x" * rng.randint(0, 30) + "é<|") for c in (1, 2, None) for t in range(60)]
    frame = spark.createDataFrame([*turns, (3, 0, "user", "no reply")], "conv_id long, turn long, role string, text string").repartition(3)
    examples = chat_format.expand_turns(frame)
    whole = {(r.conv_id, r.part, r.seq): (r.text, r.loss_start, r.loss_end) for r in chat_format.whole_examples(examples).collect()}
    parts: dict = {}
    for r in chat_format.example_parts(examples).orderBy("block_part", "block").collect():
        text, _, _ = parts.get((r.conv_id, r.part, r.seq), ("", None, None))
        before = None if r.loss_start is None else len(text)
        parts[r.conv_id, r.part, r.seq] = (text + r.text, before and before + r.loss_start or r.loss_start, before and before + r.loss_end or r.loss_end)
    assert parts == whole and len(whole) == sum(t[2] == "assistant" for t in turns)
    chars = {r.conv_id: r.formatted_chars for r in chat_format.read_back(examples).collect()}
    assert chars == {c: sum(len(t) for (k, _, _), (t, _, _) in whole.items() if k == c) for c in (1, 2, 3, None)}


def test_no_conversations(examples):
    assert chat_format.read_back(examples.limit(0)).collect() == []
