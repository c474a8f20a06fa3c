"""Elements that the main text leaves out: where they end, and what they may hold."""

import pytest

from laurel.llm import html_density

LONG = [f"Paragraph {i} of the article, which says a good deal and holds no link at all." for i in range(5)]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<article><p>{0}<p class='notice'>gone<p>{1}</p><p>{2}</p></article>", 3),
        ("<article><p>{0}<p hidden>gone<p>{1}</p><p>{2}</p></article>", 3),
        ("<article><p>{0}<p hidden>gone<b>x</b><div>{1}</div><p>{2}</article>", 3),
        ("<article><ul><li>{0}<li class='social'>gone<li>{1}</li><li>{2}</ul></article>", 3),
        ("<article><ul><li>{0}<li hidden>gone<ul><li>gone</ul><li>{1}<li>{2}</ul></article>", 3),
        ("<article><dl><dt>{0}<dd hidden>gone<dt>{1}<dd>{2}</dl></article>", 3),
        ("<article><table><tr><td>{0}<td hidden>gone<td>{1}<tr hidden><td>gone<td>gone<tr><td>{2}</table></article>", 3),
        ("<article><table><thead hidden><tr><th>gone<tbody><tr><td>{0}<td>{1}</table><p>{2}</article>", 3),
        ("<article><p>{0}<span hidden>gone<p>{1}</p><p>{2}</p></article>", 3),
        ("<html><head><title>gone</title><meta charset=u><body><article><p>{0}<p>{1}</article>", 2),
        ("<html><head><title>gone</title><article><p>{0}<p>{1}</article>", 2),
        ("<article><p>{0}</p><div hidden><p>gone<p>gone</p><ul><li>gone<li>gone</ul></div><p>{1}</article>", 2),
        ("<article><p>{0}</p><nav><p>gone<p>gone<li>gone<li>gone</nav><p>{1}</article>", 2),
    ],
)
def test_left_out_elements_end_without_end_tags(html, blocks):
    assert html_density.main_text(html.format(*LONG)) == "\n\n".join(LONG[:blocks])


ARTICLE = "".join(f"<p>{p}</p>" for p in LONG)
SIDE = "<div class='sidebar'><p>Short text beside it.</p><a href='/x'>link</a></div>"


@pytest.mark.parametrize(
    "html",
    [
        f"<body><div class='container sidebar-right'><article>{ARTICLE}</article>{SIDE}</div></body>",
        f"<body><div class='container sidebar-right'><div>{ARTICLE}</div>{SIDE}</div></body>",
        f"<body><div class='content-with-sidebar'><main>{ARTICLE}</main>{SIDE}</div></body>",
        f"<body><div class='content-with-sidebar'><div class='widget'>{ARTICLE}</div>{SIDE}</div></body>",
        f"<body><article>{ARTICLE}</article><section class='related'><article><p>A short teaser.</p></article></section></body>",
        f"<body><article>{ARTICLE}</article><section id='comments'>{'<p>Words of a reader, at length.</p>' * 60}</section></body>",
        f"<body><div class='ad'>{'An advert longer than the article. ' * 40}</div><article>{ARTICLE}</article></body>",
        f"<body><div class='container sidebar-right'><div>{ARTICLE}</div></div><div class='related'><article>Teaser.</article></div></body>",
        f"<body><div class='social'><p>Follow us.</p></div><div>{ARTICLE}</div><div class='comments'><p>Nice.</p></div></body>",
    ],
)
def test_words_of_a_class_do_not_take_wrappers(html):
    assert html_density.main_text(html) == "\n\n".join(LONG)


def test_formulas_are_text():
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='tex'>gone</annotation></semantics></math>"
    html = f"<body><article>{ARTICLE}<p>Hence {math} holds <span class='ad'>gone </span>here.</p></article></body>"
    assert html_density.main_text(html) == "\n\n".join([*LONG, "Hence x=2 holds here."])
