"""Main texts where a page holds many paragraphs, and where markup only looks like a menu."""


def test_constant_text_among_many_paragraphs(spark):
    from plexgraph.llm.wrapper import main_text

    own = lambda i: [f"paragraph {k} of page {i} says {i * 31 + k}" for k in range(40)]
    rows = [(i, f"http://many.com/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in own(i)[:20]) + "<p>Follow us</p>" + "".join(f"<p>{x}</p>" for x in own(i)[20:]) + "</article>") for i in range(30)]
    # Exactly half of the pages is enough, less is not.
    rows += [(100 + i, f"http://half.com/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in own(i)) + ("<p>Half</p>" if i % 2 else "") + ("<p>Few</p>" if i < 9 else "") + "</article>") for i in range(20)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(30):
        assert got[i] == "\n\n".join(own(i))
    for i in range(20):
        assert got[100 + i] == "\n\n".join(own(i) + ["Few"] * (i < 9))


def test_containers_of_the_article_are_kept():
    from plexgraph.llm.wrapper import extract, parse

    text = lambda page: extract(parse(page), None)
    article = "<article><h1>T</h1><p>whole text</p></article>"
    for holder in (
        '<body style="overflow-x:hidden">', '<div style="overflow: hidden">', '<div style="visibility:hidden; visibility:visible">', '<div class="layout has-sidebar">', '<div class="no-sidebar">', '<div class="with-header">',
        '<div id="share-enabled">', '<body style="visibility:hidden">', '<div class="sidebar">', '<form>', '<div class=widget><div role=form>', '<div style="display:none">',
    ):
        assert text(f"{holder}{article}") == "T\n\nwhole text", holder
        assert text(f"{holder}<main><p>whole text</main>") == "whole text", holder
    for holder in ('<div class="layout has-sidebar">', '<div style="overflow:hidden">'):
        assert text(f"{holder}<p>whole text") == "whole text"
    for gone in ('<p style="display : NONE !important">x', "<p style='color:red;visibility: hidden'>x", "<div class='a Sidebar'>x</div>", "<div id=comments><article>x</article></div>", "<template><article>x</article></template>"):
        assert text(f"{article}{gone}") == "T\n\nwhole text", gone
        assert text(f"<main>{article}{gone}</main>") == "T\n\nwhole text", gone
    assert text("<div class=related><article>a</article></div><div class=sidebar><article>b</article></div><p>text") == "text"
    assert text("<template><article>x</article></template><p>text") == "text"
