import pytest

from riskloom.llm.extraction import Pages, extract_main_text, fitted, labelled_pages, marked_labels, train_extractor

ARTICLE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, please.</div>'
    "<article><h1>Title {0}</h1><p><b>First &amp; {0}<br><p>Second   line\n{0}.</p><p>Third, with <i>mar</i>kup and a longer text.</p></article>"
    "<footer>&copy; somebody &middot; Terms.</footer></body></html>"
)
SCHEMA = "page_id bigint, url string, html string, text string, n_chars string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "old", "old") for r in rows], SCHEMA).repartition(2)


def content(number):
    return f"Title {number}\nFirst & {number}\nSecond line {number}.\nThird, with markup and a longer text."


@pytest.fixture(scope="module")
def model(spark):
    return train_extractor(made(spark, [(i, "u", ARTICLE.format(i)) for i in range(40)]))


def test_articles_and_odd_rows(spark, model):
    rows = [(i, None, ARTICLE.format(i)) for i in range(50, 60)] + [(50, None, ARTICLE.format(50))]
    rows += [(1, "u", None), (2, "u", ""), (3, "u", "   "), (None, "u", ARTICLE.format(9)), (4, "u", ARTICLE.format(4)[:-40])]
    long = ARTICLE.format(5).replace("</article>", "<p>More text of the story, again.</p>" * 20_000 + "</article>")
    rows += [(5, "u", long), (6, "u", "<p" + "<" * 50_000), (7, "u", "<div>" * 5000 + "x"), (8, "u", '<p title="open'), (9, "u", "<script>x")]
    found = extract_main_text(made(spark, rows), model).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    by_id = {r["page_id"]: r["text"] for r in found}
    assert all(by_id[i] == content(i) for i in [*range(50, 60), 4]) and by_id[None] == content(9)
    assert by_id[1] == by_id[2] == by_id[3] == by_id[9] == "" and by_id[5].count("again.") == 20_000


def test_other_make_ups():
    field, cutter, right, total = fitted([ARTICLE.format(i) for i in range(40)]), Pages(), 0, 0
    from riskloom.llm.extraction import Features

    features = Features()
    for html in labelled_pages():
        blocks = cutter.blocks(html)
        states = field.viterbi([features.of(b, i, len(blocks)) for i, b in enumerate(blocks)])
        total += len(states)
        right += sum(s == ("#main" in b.marks) for s, b in zip(states, blocks))
    assert right / total > 0.95


def test_blocks():
    texts = [b.text for b in Pages().blocks("a<p>b <b>c</b>&#228;<p>d<br>e<ul><li>f<li>g</ul><select><option>h</select><textarea>i</textarea>j &lt;k&gt;")]
    assert texts == ["a", "b cä", "d e", "f", "g", "j <k>"]
    marks = Pages().blocks('<div class="comment x" id=side><p>t</p></div>')[0].marks
    assert marks == {"<div>", ".comment", "<p>"}
    assert marked_labels(Pages().blocks("<p>a</p>")) is None
    assert marked_labels(Pages().blocks("<main><p>a</p><aside>b</aside></main>c")) == [1, 0, 0]


@pytest.mark.parametrize(
    "html, texts",
    [
        ('<article><svg class="i"/><p>one</p><p>two</p></article>', ["one", "two"]),
        ("<article><svg-icon></svg-icon><p>story</p></article>", ["story"]),
        ("<article><script_x></script_x><title-bar>a</title-bar><p>story</p></article>", ["a", "story"]),
        ('<p>a</p><object data="x"><p>rest</p>', ["a", "rest"]),
        ('<p>a</p><object data="x"><p>other</p></object><p>rest</p>', ["a", "rest"]),
        ("<p>a <select><option>x<option>y</select> b</p><select><option>z</option></select>", ["a b"]),
        ("<div><select><option>x</div><p>story</p>", ["x", "story"]),
        ("<p>a</p><noscript><p>b</p></noscript><template><div>c</div></template><iframe>d</iframe><p>e</p>", ["a", "e"]),
        ("<p>a</p><noscript><p>b</p>", ["a", "b"]),
        ("<p>a</p><iframe src=x /><p>b</p><template><p>c", ["a", "b", "c"]),
        ("<p>a<svg><title/><style/><text>x</text></svg>b</p>", ["a b"]),
        ("<p>a <svg><foreignObject><div>x</div></foreignObject></svg> b</p>", ["a b"]),
        ("<div><svg><path></div><p>one</p><svg></svg><p>two</p>", ["one", "two"]),
        ("<svg><path><p>one</p></svg><p>two</p>", ["one", "two"]),
        ("<html><head><title>t</title><meta name=x><p>one</p><p>two</p>", ["one", "two"]),
        ("<head><title>t</title><noscript><img></noscript>one<b>two</b><p>three</p>", ["onetwo", "three"]),
        ("<head><title>t</title><style>s</style><script>p</script></head><body><p>one</p></body>", ["one"]),
        ("<head><title>t</title><body><p>one</p></body>", ["one"]),
        ("<p>a</p><SCRIPT>x</p></SCRIPT ><p>b</p><textarea>c", ["a", "b"]),
    ],
)
def test_hidden_and_open_elements(html, texts):
    assert [b.text for b in Pages().blocks(html)] == texts


def test_empty(spark, model):
    assert extract_main_text(made(spark, []), model).count() == 0
    alone = train_extractor(made(spark, [(1, "u", None)]))
    text = extract_main_text(made(spark, [(1, "u", labelled_pages()[1])]), alone).first()["text"]
    assert text.startswith("Small deposits\n") and "Subscribe" not in text
