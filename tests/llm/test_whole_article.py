"""Articles in several surges, and in containers with modifier classes."""

from plumbline.llm.htmltext import main_text

LONG = "word " * 40


def paragraphs(name):
    return "".join(f"<p>{name}{i} {LONG}</p>" for i in range(3))


def said(text):
    return [w for w in text.split() if w != "word"]


PARTS = f"<section>{paragraphs('a')}</section><section><ul>{''.join(f'<li>i{i}</li>' for i in range(6))}</ul></section><section>{paragraphs('b')}</section>"
ALL = ["a0", "a1", "a2", "i0", "i1", "i2", "i3", "i4", "i5", "b0", "b1", "b2"]


def test_all_surges_of_an_article():
    for holder in ("article", "main"):
        assert said(main_text(f"<body><div>other</div><{holder}>{PARTS}</{holder}><p>end</p></body>".encode())) == ALL
    assert said(main_text(f"<body><div>{PARTS}</div></body>".encode())) == ALL


def test_modifiers_do_not_drop_the_article():
    side = "<div class='sidebar'>side</div>"
    for name in ("content has-sidebar", "content-sidebar-wrap"):
        assert said(main_text(f"<body><div class='{name}'><article>{PARTS}</article>{side}</div></body>".encode())) == ALL
        assert said(main_text(f"<body><div class='{name}'>{paragraphs('a')}{side}</div></body>".encode())) == ALL[:3]
    for name in ("comments", "post-comments", "related-posts"):
        page = f"<body><main><article>{paragraphs('a')}</article><div class='{name}'><article>{paragraphs('c') * 3}</article></div></main></body>"
        assert said(main_text(page.encode())) == ALL[:3]
