"""The HTML reader on nested, broken and hostile markup, and the dispatcher's errors."""

import html as entities
import re

from docloom.operators import html as H


def kinds(markup):
    return [(b["kind"], b["depth"], b["text"]) for b in H.read(markup)]


def test_nested_lists_and_unclosed_tags():
    assert kinds("<ul><li>a<ul><li>b<li>c<ol><li>d</ol></ul>e<li>f</ul><p>g<p>h<h2>i</h2>j") == [("li", 1, "ae"), ("li", 2, "b"), ("li", 2, "c"), ("li", 3, "d"), ("li", 1, "f"), ("p", 0, "g"), ("p", 0, "h"), ("h2", 0, "i")]
    assert kinds("<p><b>one<br>two<p>three</b></p>") == [("p", 0, "one two"), ("p", 0, "three")]
    assert kinds("<P CLASS=x>A &amp; B &lt;c&gt;</P><script>var p='<p>no</p>'</script><nav><li>no</li></nav><!-- <p>no</p> --><p>  yes\n\t x </p>") == [("p", 0, "A & B <c>"), ("p", 0, "yes x")]
    assert kinds("<li><p>in</p>out</li></ul></p>") == [("li", 0, "out"), ("p", 0, "in")]
    assert kinds("<p>open") == [("p", 0, "open")] and kinds("<p></p><p> </p>") == [] and kinds("</p></p>") == []


def test_tables():
    (b,) = H.read("<table><tr><th>K<th>V<tr><td>a<td>1<br>2</tr><tr></tr><tr><td><p>x</p></td><td></td></table>")
    assert (b["kind"], b["cells"], b["text"]) == ("table", [["K", "V"], ["a", "1 2"], ["x", ""]], "K | V\na | 1 2\nx | ")
    outer = H.read("<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>after</td></tr></table><p>end</p>")
    assert [(b["kind"], b["depth"], b["cells"]) for b in outer] == [("table", 0, [["out", "after"]]), ("table", 1, [["in"]]), ("p", 0, None)]
    assert [b["cells"] for b in H.read("<table><td>loose")] == [[["loose"]]]


def test_dispatch(spark):
    deep = "<div>" * 600 + "<p>found</p>"
    rows = [(1, "<p>a</p><ul><li>b</ul>"), (2, None), (3, " \n "), (4, "plain\n\n text  here"), (5, "<div>nothing marked</div>"), (6, deep), (7, "<i>" * 600), (8, "1 < 2"), (8, "<p>same id</p>")]
    got = {}
    for r in H.parse(spark.createDataFrame(rows, "page_id int, html string")).collect():
        got.setdefault(r.page_id, []).append((r.parser, r.error, r.ord, r.kind, r.text))
    assert {i: sorted(v, key=repr) for i, v in got.items()} == {
        1: [("reader", None, 0, "p", "a"), ("reader", None, 1, "li", "b")], 2: [(None, "empty", None, None, None)], 3: [(None, "empty", None, None, None)],
        4: [("lines", None, 0, "p", "plain"), ("lines", None, 1, "p", "text here")], 5: [("reader", "no content", None, None, None)], 6: [("patterns", "reader failed: too deep", 0, "p", "found")],
        7: [("patterns", "no content", None, None, None)], 8: [("lines", None, 0, "p", "1 < 2"), ("reader", None, 0, "p", "same id")],
    }


def test_given_pages_equal_their_markup(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html")
    got = {}
    for r in H.parse(pages).where("kind is not null").collect():
        got.setdefault(r.page_id, []).append((r.ord, r.kind, r.text))
    clean = lambda t: " ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", t))).split())
    for page, markup in pages.collect():
        bare = re.sub(r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", "", markup)
        # A block runs to its own end, the next block of a paragraph's kind, or the end of what holds it.
        want = [(k.lower(), clean(t)) for k, t in re.findall(r"(?is)<(h1|p|li)\b[^>]*>(.*?)(?=</\1\s*>|<p\b|<h1\b|<ul\b|</article|<footer\b|<div\b|</body|\Z)", bare)]
        assert [(k, t) for _, k, t in sorted(got.get(page, []))] == [(k, t) for k, t in want if t]
