from citewright.sources.contents import Rule, contents_entries

ISSUE = """<!DOCTYPE html><html><head><title>x</title><script>var a = "<li><a href='no'>no</a>";</script></head><body>
<nav><ul><li><a href="/home">Home</a></li></ul></nav><div id="content"><h2>Issue 1 &amp; 2</h2><ul>
<li><a href=" /a.html ">On <em>genre</em></a><br/>Jane Smith</li><li><a href="b.html">"Reading" the essay</a><br> John Adams and <b>Aisha Bell</b>
<li>no link here<li><a>no target</a><li><a href="c.html">Review:
 two lines</a> by Carlos<br>2nd line</ul><h2>Notes</h2><p><a href="d.html">In a paragraph</a><p>next</div><footer><li><a href="/f">foot</a></footer></body>"""
LAYOUT = """<div class="toc main"><h3>Part</h3><dl><dt><a href="1">One</a><dd>x<dt><a href="2">Two</a> Ann</dl></div><dl><dt><a href="3">Outside</a></dl>"""


def rows(spark, html, rule):
    pages = spark.createDataFrame([(1, html, "z")], "page_id int, html string, title2 string")
    return [tuple(r)[2:] for r in contents_entries(pages, rule).orderBy("place").collect()]


def test_entries_of_planted_layouts(spark):
    assert rows(spark, ISSUE, Rule()) == [
        (1, "Issue 1 & 2", "On genre", "/a.html", "Jane Smith"), (2, "Issue 1 & 2", '"Reading" the essay', "b.html", "John Adams and Aisha Bell"),
        (3, "Issue 1 & 2", "Review: two lines", "c.html", "by Carlos"),
    ]
    assert rows(spark, ISSUE, Rule(entry="p")) == [(1, "Notes", "In a paragraph", "d.html", None)]
    assert [r[2] for r in rows(spark, ISSUE, Rule(skip=()))] == ["Home", "On genre", '"Reading" the essay', "Review: two lines", "foot"]
    assert rows(spark, LAYOUT, Rule(entry="dt", within="toc")) == [(1, "Part", "One", "1", None), (2, "Part", "Two", "2", "Ann")]


def test_broken_and_empty_pages(spark):
    pages = spark.createDataFrame([(k, h) for k, h in enumerate([None, "", "</li></ul><li><a href=x>t", "<li><a href='y'>u</a><li", "<<<>>", "<li>" * 3000 + "<a href=z>deep", "text only", "<li><a href=\"q\">&#0;&bogus; v</a>"])], "page_id int, html string")
    got = sorted((r["page_id"], r["link"]) for r in contents_entries(pages, Rule()).collect())
    assert got == [(2, "x"), (3, "y"), (5, "z"), (7, "q")]
