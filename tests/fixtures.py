"""Small made-up pages, one for each thing that a page reader has to tell apart, and a made-up site of a few pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOMAIN = "ex.org"
_FOUR = ("Ada Byron", "Carl Gauss", "Emmy Noether", "Max Born")


def _slug(name: str) -> str:
    return name.lower().replace(" ", "-")


def _card(name: str) -> str:
    to = f"/people/{_slug(name)}"
    return (
        f'<div class="card"><a href="{to}"><img alt="Photo of {name}"></a><h3><a href="{to}">{name}</a></h3>'
        f"<p>Professor of Botany</p><p>{name.split()[0].lower()}@ex.org</p></div>"
    )


PAGES = {
    "profile": """<html><head><title>Jane Q. Doe - Soil Unit</title></head><body><nav><a href="/x">Menu</a></nav><main><h1>Jane Q. Doe, PhD</h1>
<p>Associate Professor of Soil Science</p><p><strong>Research Interests:</strong></p><ul><li>Soil carbon; wetland soils</li><li>Remote sensing</li></ul>
<h2>Teaching</h2><p>SWS 4244 Wetlands</p><h2>Graduate Students</h2><ul><li>Ann Lee (PhD)</li><li>Bob Roe - MS</li></ul><p>Extension focus: nutrient management</p>
<p>Write to jdoe [at] ex [dot] org</p><a href="https://scholar.google.com/citations?hl=en&user=abc">Scholar</a><a href="https://lab.ex.org/doe">Doe Lab</a>
</main><footer>webmaster@ex.org</footer></body></html>""",
    "empty": """<html><body><main></main><div><h1>Ian Poe</h1><p>Lecturer in Ecology</p><a href="mailto:ipoe@ex.org">mail</a></div></body></html>""",
    "linked": f"""<html><body><main>{"".join(map(_card, _FOUR))}<div><a href="/news/ann-lee">Ann Lee</a></div>
<a href="/other/place/mary-stray">Mary Stray</a></main></body></html>""",
    "vcards": "<html><body>" + "".join(
        f'<div class="vcard faculty soil-physics emeritus"><span class="fn">{n}</span><p>Professor</p><a href="/p/{i}">Profile</a></div>'
        for i, n in enumerate((*_FOUR, "Lise Meitner"))
    ) + '<div class="vcard staff"><span class="fn">Sam Clerk</span></div></body></html>',
    "cards": "<html><body><section>" + "".join(
        f"<article><h4>{n}</h4><p>Lecturer</p><p>Building {i}</p><p>Bees and {n.split()[1]}s</p></article>" for i, n in enumerate((*_FOUR, "Lise Meitner", "Nora Bell"))
    ) + "</section></body></html>",
    "table": """<html><body><table><tr><th>Name</th><th>Title</th><th>E-mail</th><th>Area</th><th>Research</th></tr>
<tr><td>Doe, Jane</td><td>Professor</td><td>jane@ex.org</td><td>old</td><td>Soil; Water</td></tr><tr><td>not a person here 7</td><td></td><td></td><td></td><td></td></tr></table></body></html>""",
    "students": """<html><body><h2>Doctoral students</h2><table><tr><th>Student</th><th>Advisor</th><th>Chair</th><th>Topic</th></tr>
<tr><td>Ann Lee</td><td>Doe</td><td>Roe</td><td>Peat</td></tr></table></body></html>""",
    "list": """<html><body><main><h2>PhD</h2><p>Ann Lee</p><p>Advisor: Jane Doe</p><p>Bob Roe - Advisor: Smith</p><h2>Masters</h2><p>Cid Fox</p></main></body></html>""",
    "people": """<html><body><a rel="next" href="?page=2">Next</a><a href="/people?page=3">3</a><a href="https://other.org/people?page=4">4</a><a href="/people#top">1</a></body></html>""",
    "units": """<html><body><div id="content"><h2>College of Soil</h2><ul><li><a href="/u/a">Unit A</a></li><li><a href="/u/a2">Unit A</a></li></ul>
<h2>Other</h2><ul><li><a href="/u/b">Unit B</a></li></ul></div></body></html>""",
    "unit": """<html><body><a href="https://cat.ex.org/">Catalogue</a><a href="https://soil.ex.org/map">Map</a><a href="https://soil.ex.org/">Department website</a><a href="https://q.org/">Website</a></body></html>""",
    "hub": """<html><body><a href="/people/faculty">Our Faculty</a><a href="/faculty/list">All of us</a><a href="/grad/students">Graduate Students</a><a href="/people/">People</a>
<a href="/people/staff">Faculty and more staff</a><a href="/news/faculty">Faculty News</a><a href="/a.pdf">Faculty handbook</a><a href="https://q.org/faculty">Faculty</a></body></html>""",
}
ROSTER_LINES = ["Doe, Jane", "Associate Professor", "Soil Science", "Roe, Rick", "Professor", "Poe, Ian", "Lecturer", "Botany", "end"]


def _profile(name: str, title: str, more: str = "") -> str:
    return f"<html><head><title>{name}</title></head><body><main><h1>{name}</h1><p>{title}</p>{more}</main></body></html>"


_LIST = '<html><body><main>{}<a rel="next" href="{}">Next</a></main></body></html>'
_ITEM = '<div><h3><a href="/people/{}">{}</a></h3><p>{}</p></div>'
SITE = {
    "https://soil.ex.org/": '<html><body><nav><a href="/faculty/">Faculty</a><a href="/people/">People</a></nav></body></html>',
    "https://soil.ex.org/faculty/": _LIST.format(
        _ITEM.format("jane-doe", "Jane Doe", "Professor") + _ITEM.format("ian-poe", "Ian Poe", "Lecturer"), "/faculty/?page=2"
    ),
    "https://soil.ex.org/faculty/?page=2": _LIST.format(
        _ITEM.format("eva-kern", "Eva Kern", "Professor") + _ITEM.format("sam-clerk", "Sam Clerk", "Office Manager") + _ITEM.format("jane-doe", "Jane Doe", "Professor"), "/faculty/"
    ),
    "https://soil.ex.org/people/jane-doe": _profile(
        "Jane Doe", "Professor of Soil Science", "<h2>Research</h2><p>Peat; Soil carbon</p><h2>Students</h2><ul><li>Kim Ash (MS)</li></ul><p>jdoe@ex.org</p>"
    ),
    "https://soil.ex.org/people/ian-poe": _profile("Ian Poe", "Lecturer", "<h2>Teaching</h2><p>SWS 4244 Wetlands</p>"),
    "https://soil.ex.org/people/graduate-students/": PAGES["list"].replace("Smith", "Kern"),
    "https://water.ex.org/": "<html><body><p>Nothing here yet</p></body></html>",
    "https://water.ex.org/people/": PAGES["table"],
}
UNITS = [
    (0, "u0", "College of Earth", "Soil", ["https://old-soil.ex.org/", "https://soil.ex.org/"], []), (1, "u1", "College of Earth", "Water", ["https://water.ex.org"], []),
    (2, "u2", "College of Sky", "Air", ["https://air.ex.org/"], []), (3, "u3", "College of Sky", "Stars", [], []),
]
ROSTER = [(0, "Doe, Jane", "Dean", "Soil"), (1, "Ray Moon", "Professor", "Stars"), (2, "Ray Moon", "", ""), (3, "Una Note", "Lecturer", "medicine")]


def pages(spark: SparkSession, *names: str) -> DataFrame:
    """The micro-pages of these names, or all."""
    rows = [(n, f"https://ex.org/{n}", h) for n, h in PAGES.items() if n in names or not names]
    return spark.createDataFrame(rows, "page_id string, url string, html string")


def site(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The made-up site's pages, its units and the catalogue's roster."""
    fetched = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE.items())], "page_id int, url string, html string")
    units = spark.createDataFrame(UNITS, "ord long, unit_id string, college string, name string, sites array<string>, hints array<string>")
    return fetched, units, spark.createDataFrame(ROSTER, "ord long, name string, title string, department string")
