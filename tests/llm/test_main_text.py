from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reabasto.llm import main_text

LONG = "This is a paragraph of the article that says rather a lot about nothing in particular and goes on for some while."
MORE = "Another paragraph follows, as long as the first one, with a <a href='/x'>link</a> inside and some <b>bold words</b> too."
PAGES = [
    (f"<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></article><footer>&copy; 2020 All rights kept by the owner of this site</footer>",
     f"Title {LONG} Another paragraph follows, as long as the first one, with a link inside and some bold words too."),
    (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><!-- x --><div class='ad'>{LONG}</div><main><p><b>Short<br>words<p>{LONG}</main>",
     f"Short words {LONG}"),
    (f"<div class=sidebar><p>{LONG}</p></div><div id='cookie-notice'>{LONG}</div><p>{LONG}</p><p>{LONG}</p><section class='comments'><p>{LONG}</p><p>{LONG}</p></section>",
     f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><aside><p>{LONG}</p></aside><form><label>{LONG}</label><input></form><p>a &lt; b &amp;&nbsp;c&#39;s  \n d</p></article>",
     f"{LONG} a < b & c's d"),
    (f"<article><p>{LONG}</p><ul><li><a href=1>One</a></li><li><a href=2>Two more</a></li></ul><p style='display: none'>{LONG}</p><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<header><p>{LONG}</p></header><p>{LONG}</p><noscript>{LONG}</noscript><template><p>x</p></template><p>{LONG}</p><script>if (a < b) {{ {LONG} }}", f"{LONG} {LONG}"),
    (f"<body class='home with-sidebar'><div class='page has-sidebar'><article class=post><p>{LONG}</p></article></div><div class='sidebar-left'><p>{LONG}</p></div>", LONG),
    ("", ""), ("   ", ""), ("<p>", ""), ("<!-- never closed <p>x</p>", ""), ("<<<>>>&&", None), ("<a <b <p title='x>y'>", None), ("plain text only with no tag at all, but enough words to be kept as the text of it", "plain text only with no tag at all, but enough words to be kept as the text of it"),
]


HIDES_NOTHING_BEHIND = [
    "<video-player></video-player>", "<svg-icon name=x></svg-icon>", "<title-bar></title-bar>", "<svg class=i/>", "<svg class='i' />", "<button>", "<video src=x>", "<object data=x />", "<select><option>",
    "<button>Share <button>Print</button>", "<svg><title/><path d='M0'/></svg>", "<svg><svg><text>x</text></svg></svg>", "<iframe src='x' />", "<script>var a</script x>", "<template><div><p>x</div></template>",
    "<div><video src=x><p>Your browser is too old</div></video>", "<math><mi>x</mi></math>", "<button><div>Share</div></button>", "<noscript><a href=x>y<br></noscript>",
]


@pytest.mark.parametrize("between", HIDES_NOTHING_BEHIND)
def test_elements_that_hide_nothing_behind_them(between):
    for tail in ("", "<footer><button>Go</button><video></video><svg></svg><select></select></footer>"):
        made = main_text.main_text(f"<article><p>one {LONG}</p>{between}<p>two {LONG}</p></article>{tail}", main_text.train())
        assert made.startswith(f"one {LONG}") and made.endswith(f"two {LONG}") and "too old" not in made and "Print" not in made
    made = main_text.blocks(f"<article><p>a <svg><a>x</a><text>y</text></svg><button>z<p>z</p></button><noscript><img></noscript>b</p></article>")
    assert [b[0] for b in made] == ["a b"] and made[0][2] == 0.0


IMPLIED_ENDS = [
    f"<article><p class=ad>{MORE}<p>{LONG}<p>{LONG}</article>",
    f"<article><p style='display:none'>{MORE}<p>{LONG}<div>{LONG}</div></article>",
    f"<article><p class=ad>{MORE}<ul><li>{LONG}<li>{LONG}</ul></article>",
    f"<article><ul><li class=ad>{MORE}<ul><li>{MORE}</ul><li>{LONG}<li>{LONG}</ul></article>",
    f"<article><dl><dt>{LONG}<dd class=promo><div>{MORE}</div><dd>{LONG}</dl></article>",
    f"<article><table><tr class=ad><td>{MORE}<td>{MORE}<tr><td class=ad><p>{MORE}<td>{LONG}<tr><td>{LONG}</table></article>",
    f"<article><table><thead class=ad><tr><th>{MORE}<tbody><tr><td>{LONG}</table><p>{LONG}</article>",
    f"<article><p>{LONG}<p class=ad>{MORE}<hr>{LONG}</article>",
    # held: the inner p, li or td closes none outside of the table or list that holds it
    f"<article><div class=ad><table><tr><td>{MORE}<p>{MORE}<td>{MORE}</table>{MORE}</div><p>{LONG}<p>{LONG}</article>",
    f"<article><ul><li class=ad>{MORE}<ul><li>{MORE}<li>{MORE}</ul>{MORE}</ul><p>{LONG}<p>{LONG}</article>",
    f"<article><table><tr><td class=ad>{MORE}<table><tr><td>{MORE}<td>{MORE}</table>{MORE}<td>{LONG}</table>{LONG}</article>",
]


@pytest.mark.parametrize("html", IMPLIED_ENDS)
def test_end_tags_left_out(html):
    assert main_text.main_text(html, main_text.train()) == f"{LONG} {LONG}"


def test_many_unclosed_elements_quickly():
    for tag in ("<div>", "<button>", "<object>", "<title/>", "</script ", "<svg>", "<li>", "<p class=ad>"):
        assert "end" in main_text.main_text(f"<article>{tag * 100_000}<p>end {LONG}</p>" if tag[1] != "/" else f"<article><p>end {LONG}</p><script>{tag * 100_000}", main_text.train())


N = 40_000
MEGABYTES = {
    "divs, then li": "<div>" * (2 * N) + "<li>some text" * N, "divs, then p": "<div>" * (2 * N) + "<p>a</p>" * (2 * N), "a without an end": "<a " * (8 * N), "open quotes": '<a "' * (6 * N),
    "quoted ends": '<a ">"' * (4 * N) + '"', "lone quotes": "<a 'x>" * (2 * N) + '<b "y>' * (2 * N), "declarations": "<p>" + "<!x" * (8 * N), "li and p": "<li><p>" * (4 * N),
    "nested lists": "<dl><dd>x" * (3 * N), "nested tables": "<table><tr><td>" * N + "<td>x" * (2 * N), "end tags": "<div>" * N + "</p>" * (2 * N) + "</div>" * N, "raw": "<script " * (3 * N) + "<title/>" * N,
}


@pytest.mark.parametrize("kind", MEGABYTES)
def test_time_grows_with_the_length_of_a_page(kind):
    html = MEGABYTES[kind]
    assert len(html) > 600_000
    start = time.process_time()
    main_text.main_text(f"<article><p>{LONG}</p>{html}", main_text.train())
    assert time.process_time() - start < 5


def walked(tag, stack):
    """How many elements stay open, by walking up the open elements as HTML tells it."""
    keep, ends = len(stack), main_text.ENDS.get(tag, ())
    for i in range(len(stack) - 1, -1, -1):
        if stack[i] in ends:
            keep = i
        elif stack[i] == "table" or stack[i] in main_text.SKIPPED or (tag in ("li", "dt", "dd") and stack[i] not in main_text.LOOSE):
            break
    if tag in main_text.ENDS_P:
        for i in range(keep - 1, -1, -1):
            if stack[i] == "p":
                return i
            if stack[i] in main_text.HOLDS_P:
                break
    return keep


NAMES = "div p li ul dl dt dd table tr td th tbody thead caption colgroup option optgroup select article nav section address button object h1 form".split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(NAMES), max_size=25), st.integers(0, 10))
def test_implied_ends_are_those_of_a_walk(names, pops):
    opened = main_text._Open()
    for name in names:
        opened.push(name, (False, False))
    for _ in range(min(pops, len(names))):
        opened.pop()
    stack = [e[0] for e in opened.stack]
    for tag in NAMES:
        assert opened.staying(tag) == walked(tag, stack), tag
        assert opened.last(tag) == (len(stack) - 1 - stack[::-1].index(tag) if tag in stack else len(stack))


class Reference(HTMLParser):
    """Blocks of a page by the standard library's parser: text, and whether content or surroundings hold it."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.found = [], [], []
        self.feed(html)
        self.close()
        self.cut()

    def cut(self):
        whole = " ".join("".join(self.text).split())
        if whole:
            self.found.append((whole, int(any(k[0] for _, k in self.open)), int(any(k[1] for _, k in self.open))))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag not in main_text.INLINE:
            self.cut()
            self.open.append((tag, main_text._kind(tag, " ".join(f'{k}="{v}"' for k, v in attrs))))

    def handle_endtag(self, tag):
        if tag not in main_text.INLINE:
            self.cut()
            self.open.pop()

    def handle_data(self, data):
        self.text.append(data)


def pages(depth=3):
    words = st.sampled_from(["some words ", "a &lt; b &amp; c ", "x", " \n ", "&eacute;t&eacute; ", "fin.", "<b>bold</b> ", "<a href='x>y'>link</a> "])
    mark = st.sampled_from(["", " class=ad", ' class="post big"', " id='sidebar'", " hidden", ' title="a > b"', " style='display: none'"])
    if depth == 0:
        return words
    inner = st.lists(pages(depth - 1), max_size=4).map("".join)
    return st.builds(lambda tag, m, x: f"<{tag}{m}>{x}</{tag}>", st.sampled_from("div section article nav aside main footer blockquote".split()), mark, inner) | words


@settings(max_examples=200, deadline=None)
@given(st.lists(pages(), max_size=5).map("".join))
def test_blocks_are_those_of_a_reference_parser(html):
    assert [(b[0], b[3], b[4]) for b in main_text.blocks(html)] == Reference(html).found


@pytest.mark.parametrize("html, text", PAGES)
def test_pages(html, text):
    made = main_text.main_text(html, main_text.train())
    assert text is None or made == text


def test_whole_long_page_quickly():
    html = "<article>" + f"<p>{LONG}</p>" * 20_000 + "<div class='x' <p>'" * 2000 + "</article>"
    assert main_text.main_text(html, main_text.train()).startswith(" ".join([LONG] * 20_000))


def test_tree_learns_the_labelled_table():
    tree = main_text.train()
    assert sum(tree(r[:-1]) == r[-1] for r in main_text.LABELLED) >= 0.95 * len(main_text.LABELLED)


def test_tree_on_blocks_held_out():
    rows = list(main_text.LABELLED)
    right = total = 0
    for fold in range(5):
        tree = main_text.train([r for i, r in enumerate(rows) if i % 5 != fold])
        for r in rows[fold::5]:
            right, total = right + (tree(r[:-1]) == r[-1]), total + 1
    assert right >= 0.85 * total


def test_no_table():
    assert main_text.train(())((1, 0, 0, 0, 0, 0, 0, 0)) == 1


def test_extract(spark):
    rows = [(1, "u", PAGES[0][0], "a", "b"), (1, "u", PAGES[0][0], "a", "b"), (None, None, None, None, None)]
    made = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")).collect()
    assert [r.n_chars for r in made] == [len(PAGES[0][1])] * 2 + [0]
    assert made[2].text == "" and made[0].text == PAGES[0][1]
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
