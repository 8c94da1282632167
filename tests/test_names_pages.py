import pytest
from pyspark.sql import functions as F

from loomrank.operators import candidates as A
from loomrank.operators import names, pages
from loomrank.plans import queries as Q


def table(spark, rows, column="name"):
    return spark.createDataFrame([(r,) for r in rows], f"{column} string")


def found(df):
    return {r["name"]: r["family"] for r in df.collect()}


def test_names_to_families(spark):
    known = table(spark, ["Alegreya Sans", "EB Garamond", "Work Sans", "work sans", "Roboto Condensed", "Rock & Roll", "Light", "Source Sans 3"], "family")
    raw = {
        "Alegreya Sans Black": "Alegreya Sans", "EB  Garamond Medium": "EB Garamond", "work sans": "work sans", "WORK SANS Extra-Bold Italic": "Work Sans", "Roboto Condensed Light": "Roboto Condensed",
        "Rock &amp; Roll,": "Rock & Roll", "Light": "Light", "Source Sans Pro": "Source Sans 3", "Source Serif Pro Ultra-Light": "Source Serif 4", "Source Sans Pro Semi-Bold Roman": "Source Sans 3",
        "Roboto Narrow": None, "EB Garamond SC": None, "Alegreya Sans SemiBold": None, "source sans pro": None, "Bold": None, "": None, " .": None, None: None,
    }
    assert found(names.resolved(table(spark, raw), known)) == {k: v for k, v in raw.items() if v}
    assert found(names.resolved(table(spark, ["Old Name Bold"]), known, {"Old Name": "Light"})) == {"Old Name Bold": "Light"}


def test_names_in_records_of_use(spark):
    known = table(spark, ["Jost", "Libre Franklin", "Futura", "Lato"], "family")
    raw = {"LATO (web) Heavy": "Lato", "Franklin Gothic Demi": "Libre Franklin", "Futura": "Futura", "Futura (Paratype) Book": "Futura", "Times New Roman": None, "Lato &amp; co": None, "(x)": None}
    assert found(names.resolved(table(spark, raw), known, usage=True)) == {k: v for k, v in raw.items() if v}
    assert found(names.resolved(table(spark, ["FUTURA  medium"]), table(spark, ["Jost"], "family"), usage=True)) == {"FUTURA  medium": "Jost"}


def test_suggestions(spark):
    known = table(spark, ["Alpha One", "The Alphabet", "Salph", "Beta", "Alph A", "Zalpha", "--"], "family")
    got = {r["label"]: r["families"] for r in names.nearest_families(table(spark, ["Alpha-Centauri", "be", "!!", "xyzw"], "label"), known).collect()}
    assert got == {"Alpha-Centauri": ["Alph A", "Alpha One", "Salph", "The Alphabet"], "be": ["Beta", "The Alphabet"]}
    rows = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b"), ("t", "c")], "source string, family string")
    assert {r["source"]: (r["labels"], r["families"]) for r in names.source_counts(rows).collect()} == {"s": (3, ["a", "b"]), "t": (1, ["c"])}
    order = names.instance_order(spark.createDataFrame([("b", 400, "normal"), ("A", 700, "normal"), ("a", 400, "normal"), ("A", 400, "italic")], "family string, weight int, style string"))
    assert [tuple(r) for r in order.collect()] == [("A", 400, "italic"), ("a", 400, "normal"), ("A", 700, "normal"), ("b", 400, "normal")]


def mined(df):
    return sorted((r["heading"], r["partner"]) for r in df.collect())


def test_headings_and_cells(spark):
    html = spark.createDataFrame(
        [(1, "<h2>1. <i>Alpha</i> &amp; Beta Two</h2><h3 id='x'>12. Gamma\n&amp; Delta</h3><h2>Alpha & Beta</h2><h4>3. No & Heading</h4><h2>4. " + "x" * 300 + " & y</h2>"), (2, None), (3, "")], "page int, html string"
    )
    assert mined(pages.element_pairs(html, "html", ("h2", "h3"), pages.NUMBERED)) == [("Alpha", "Beta Two"), ("Gamma", "Delta")]
    titled = spark.createDataFrame([("<h3>7 Best of: Alpha + Beta</h3><h3>8 Plain & Simple</h3><h2>9 A: B: C & D</h2>",)], "html string")
    assert mined(pages.element_pairs(titled, "html", ("h2", "h3"), pages.TITLED)) == [("Alpha", "Beta"), ("B: C", "D")]
    cells = spark.createDataFrame([("<td>Alpha One + B&amp;W 2</td><li>3. <b>Gamma</b> + Delta</li><strong>lower + Case</strong><td>A + Beta</td><p>Out + Side</p><tdx>Al + Be</tdx>",)], "html string")
    assert mined(pages.element_pairs(cells, "html", ("td", "li", "strong"), pages.JOINED, 90)) == [("Alpha One", "B&W 2"), ("Gamma", "Delta")]


def test_roles_links_cards(spark):
    row = "<td><strong>{} and {}</strong></td>\n<td>Serif</td><td>{}</td>"
    html = spark.createDataFrame([(row.format("A", "B", "Body Text + Headings") + row.format("C", "D", "Headings + Body Text") + row.format("E", "F", "Headings"),)], "html string")
    assert mined(pages.role_pairs(html, "html")) == [("B", "A"), ("C", "D")]
    link = 'href="https://fonts.googleapis.com/css2?{}"'
    links = spark.createDataFrame([(link.format("family=A+B:wght@400;700&family=C%20D") + link.format("family=One") + link.format("family=1&family=2&family=3") + 'href="https://other/css2?family=X&family=Y"',)], "html string")
    assert mined(pages.stylesheet_pairs(links, "html")) == [("A B", "C D")]
    specimen = spark.createDataFrame([('<div class="type"><a href="/specimen/A+B">Alpha</a><a href="/specimen/C">Beta</a><a href="/specimen/D">Third</a></div><div class="type"><a href="/specimen/Z">Lone</a></div>',)], "html string")
    assert mined(pages.card_pairs(specimen, "html", r'(?s)<div class="type">.{0,400}?</div>', pages.SPECIMEN, 2)) == [("Alpha", "Beta")]


def test_rules_bundles_and_records(spark):
    sheet = spark.createDataFrame([(1, "#one .firstfont{x:y;font-family: \"Alpha\", serif}#one .firstfont{font-family:Later}#one .secondfont{font-family:'Beta'}#two .firstfont{font-family:Lone}#three .secondfont{font-family:Other}"), (2, "")], "page int, css string")
    assert mined(pages.rule_pairs(sheet, "css")) == [("Alpha", "Beta")]
    script = spark.createDataFrame([('{a:{id:"a",family:"Old"},"b-1":{id:"b-1",family:"Beta"},a:{id:"a",family:"Alpha"}};[{id:"p",headingFontId:"a",bodyFontId:"b-1"},{id:"q",headingFontId:"a",bodyFontId:"zz"}]',)], "js string")
    assert mined(pages.registry_pairs(script, "js")) == [("Alpha", "Beta")]
    objects = spark.createDataFrame([('[{heading:"A",body:"B",x:1},{heading:\\"C\\",body:\\"D\\"},{heading:"E"}]',)], "js string")
    assert mined(pages.bundle_pairs(objects, "js")) == [("A", "B"), ("C", "D")]
    answer = spark.createDataFrame([('{"results":[{"heading_font_family":"A","body_font_family":"B","x":1},{"heading_font_family":"C"}]}',), ("broken",), (None,)], "body string")
    assert mined(pages.api_pairs(answer, "body")) == [("A", "B")]
    fonts = spark.createDataFrame([(1, "A", "google"), (2, "B", "google"), (3, "C", "paid")], "id long, name string, kind string")
    pairs = spark.createDataFrame([(1, 2, True), (2, 1, None), (1, 3, False), (1, 9, False)], "heading_id long, body_id long, community boolean")
    assert sorted(map(tuple, pages.keyed_pairs(pairs, fonts).collect())) == [("A", "B", "community"), ("B", "A", "curated")]


def test_candidate_families_have_their_sizes_and_names():
    for made, n in ((A.parameter_candidates(), 20), (A.parameter_candidates(sweeps=False), 5), (A.axis_candidates(), 23), (A.screen_candidates(), 17), (A.challengers(), 18), (A.hybrids(), 30)):
        assert len(made) == n == len({c.name for c in made})
    assert sum(c.guard is not None for c in A.axis_candidates("body")) == 4 and not any(c.guard is not None for c in A.axis_candidates("head"))


def test_guards_and_exclusions(spark):
    pairs = spark.createDataFrame([(0, i, 300 + 100 * i, 1.0 / (i + 1)) for i in range(6)], "h_id long, id long, weight int, s double")
    rows = A.sweep(pairs, [A.Candidate("all", F.col("s")), A.Candidate("few", -F.col("s"), F.col("weight") > 500)]).collect()
    by = {name: [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["candidate"] == name] for name in ("all", "few")}
    assert by == {"all": [0, 1, 2, 3, 4, 5], "few": [5, 4, 3]}
    ranked = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (0, 3, 0.7, 3)], "h_id long, id long, score double, rank int")
    assert {r["id"]: r["rank"] for r in A.excluding(ranked, ranked.where("id = 1")).collect()} == {2: 1, 3: 2}


@pytest.mark.parametrize("name", ["parameter_sweep", "axis_sweep", "screen_sweep", "challenger_sweep", "hybrid_sweep"])
def test_sweeps_are_registered_with_sql(name):
    assert name in Q.queries() and name in Q.oracle_sql()
