"""Whole elements of nested pages, against a tree built tag by tag."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from postmill.operators import elements as E
from postmill.operators import html


class Tree(HTMLParser):
    """Texts of the elements of each class, whole: every open element gets what is said inside it."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.stack, self.found = wanted, [], []

    def handle_starttag(self, name, attrs):
        for _ in range(2):
            if self.stack and self.stack[-1][0] in E.ENDS.get(name, ()):
                self.stack.pop()
        css = dict(attrs).get("class") or ""
        texts = []
        for k, s in self.wanted.items():
            if s[1:] in css if s.startswith("*") else s in css.split():
                self.found.append((k, texts))
        if name not in E.VOID and name not in ("script", "style"):
            self.stack.append((name, texts))

    def handle_endtag(self, name):
        names = [n for n, _ in self.stack]
        if name in names:
            del self.stack[len(names) - 1 - names[::-1].index(name) :]

    def handle_data(self, data):
        if self.lasttag in ("script", "style") and self.cdata_elem:
            return
        for _, texts in self.stack:
            if data.strip():
                texts.append(data.strip())


def test_elements_equal_a_tree(spark):
    rnd = random.Random(3)
    wanted = {"a": "a", "b": "b-c", "s": "*skill"}

    def page():
        out = []
        for _ in range(rnd.randint(0, 60)):
            name = rnd.choice(["div", "div", "div", "span", "p", "li", "ul", "dt", "dd", "b", "td", "tr", "table", "section"])
            css = rnd.choice(["", "", ' class="a"', " class='x a b-c'", " class=a", ' CLASS="my-skills x"', ' title="<div>" class="b-c"', ' class=""', ' data-class="a"'])
            out.append(rnd.choice([f"<{name}{css}>", f"<{name}{css}>", f"</{name}>", f"</{name.upper()} >", "<br>", f"<img{css}/>", "t1", " t2 &amp; ", "&lt;b&gt;", "é\n", "<!-- </div> -->", '<script>var x = "</div><div>"</script>', "<style>div > p {}</style>"]))
            out.append(rnd.choice(["", " ", f" w{rnd.randrange(9)} "]))
        return "".join(out)

    pages = [page() for _ in range(150)] + ["", "no tags", "<div class=a>never closed <div>x", "</div></p>", '<p class="a">one<p class="a">two<div class="a">three</div>']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(-1, None)], "id int, html string").repartition(4)
    found = E.with_parts(F.col("html"), E.marked(F.col("html"), wanted))
    got = {r.id: r.e for r in df.select("id", found.alias("e")).collect()}
    assert got.pop(-1) is None
    for i, p in enumerate(pages):
        tree = Tree(wanted)
        tree.feed(p)
        tree.close()
        # elements without an inside (void ones) come with the same start as what is around them: compare as sets of (name, text)
        assert sorted((e["name"], "".join("".join(e["parts"]).split())) for e in got[i]) == sorted((k, "".join("".join(t).split())) for k, t in tree.found), p


def test_nested_elements(spark):
    page = '<div class="job-description"><div>one</div><div>two</div></div><div>out</div>'
    row = spark.createDataFrame([(page,)], "html string").select(html.class_body(F.col("html"), "job-description").alias("b"), html.class_text(F.col("html"), "job-description", "|").alias("t"), html.class_text(F.col("html"), "none").alias("none"), html.class_body(F.col("html"), "none").alias("blank")).first()
    assert tuple(row) == ("<div>one</div><div>two</div>", "one|two", None, "")


@pytest.mark.parametrize("text, want", [("a &amp;lt; b", "a &lt; b"), ("&#233;&#xE9;&eacute;&nbsp;&apos;", "ééé '"), ("&#x1F600;&#0;&#xD800;&#99999999;", "😀&#0;&#xD800;&#99999999;"), ("&nothing; & &;", "&nothing; & &;"), ("", ""), (None, None)])
def test_character_references(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(E.decoded(F.col("t"))).first()[0] == want


def test_elements_of_a_long_page(spark):
    page = "<div class=a>" + "<div><p>x" * 3000 + "</div>" * 3000 + "</div>tail"
    found = spark.createDataFrame([(page,)], "html string").select(html.class_text(F.col("html"), "a").alias("t")).first()
    assert found.t == "x" * 3000


def test_marks_in_comments_and_scripts_are_no_elements(spark):
    page = '<!-- <b class="a">no</b> --><script>x = \'<i class="a">no</i>\'</script><script class="a">no</script><p class="a">yes &amp; <!-- </p> --> so</p><script class="a">open'
    found = spark.createDataFrame([(page,)], "html string").select(E.marked(F.col("html"), {"a": "a"}).alias("e")).first().e
    assert [(x.tag, x.parts) for x in found] == [('<script class="a">', []), ('<p class="a">', ["yes &", "so"]), ('<script class="a">', ["open"])]


def test_detail_pages_are_read_in_one_pass(spark, tmp_path):
    """No join of a table with itself, and the elements of a page by one Arrow function."""
    from postmill.plans import queries as Q

    spark.range(20).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp'2020-01-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    plan = Q.QUERIES["page_nested"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
