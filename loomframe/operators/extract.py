"""People, students, links and profiles from element rows, as joins, windows and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import emails as em
from loomframe.functions import text as tx
from loomframe.functions import urls as ur
from loomframe.operators import ordered as od
from loomframe.operators.clean import TITLE, is_noise_text, like, plausible_faculty
from loomframe.session import written
from loomframe.sources.html import attr

# What headings, labels, links and classes mean.
CHROME_TAGS = ["script", "style", "noscript", "svg", "iframe", "select", "option", "template", "nav", "footer"]
CHROME_CLASSES = (
    r"(?i)\b(breadcrumbs?|skip-?link|cookie|mega-?menu|main-menu|site-footer|footer-links|side-?bar|sub-?nav|side-?nav|sub-?menu|"
    r"secondary-(menu|nav)|widget-area)\b"
)
ACCORDION = r"(?i)(accordion|collaps|panel|tab|toggle|expand)[-_ ]?(title|header|heading|toggle|trigger|button|link)|accordion-?title|js-toggle"
BLOCK_TAGS = ["p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "blockquote"]
TEXT_TAGS = ["p", "div", "span", "section", "article", "dd", "blockquote", "td"]
HEADINGS = {
    "research": r"(?i)^(research|research\s+(interests?|areas?|focus|summary|programs?|expertise|overview|description|and\s+scholarship)|"
    r"areas?\s+of\s+(research|expertise|interest|specialization|specialty)|expertise|(current\s+)?(research\s+)?interests?|"
    r"program\s+areas?|specializations?|scholarly\s+interests|research\s+topics?|current\s+research)$",
    "teaching": r"(?i)^(teaching|courses?(\s+taught)?|classes(\s+taught)?|current\s+courses|instruction|"
    r"teaching\s+(interests?|responsibilities|assignments?|areas?|activities)|courses\s+offered)$",
    "extension": r"(?i)^(extension|extension\s+(programs?|activities|focus|areas?|and\s+outreach|education|work)|"
    r"outreach|outreach\s+and\s+engagement|extension\s+and\s+outreach|public\s+engagement|extension\s+programs?\s+and\s+resources)$",
    "students": r"(?i)^(current\s+)?((graduate|grad|phd|ph\.d\.|ms|m\.s\.|masters?|master'?s|doctoral|undergraduate|postdoc\w*|postdoctoral)\s+)*"
    r"(students?|advisees|(lab|group|research\s+group|team)\s+members|(lab|group)\s+(people|personnel)|"
    r"my\s+(students|team|group)|current\s+(group|team|lab)|lab\s+personnel|people|team|group)$",
}
LABELS = {
    "research": r"(?i)^(research(?:\s+(?:interests?|areas?|focus|program))?|areas?\s+of\s+(?:research|expertise)|interests?|expertise|specializations?)"
    r"\s*[:\-–—]\s*(.{3,})$",
    "teaching": r"(?i)^(teaching|courses?(?:\s+taught)?|classes\s+taught)\s*[:\-–—]\s*(.{3,})$",
    "extension": r"(?i)^(extension(?:\s+(?:focus|programs?|areas?))?)\s*[:\-–—]\s*(.{3,})$",
}
AREA_PREFIX = r"(?i)^(research(\s+(interests?|areas?|focus|program))?|areas?\s+of\s+(research|expertise)|interests?|expertise|specializations?)\s*[:\-–—]\s*"
GENERIC_AREA = r"(?i)^(research|program areas?|publications?|read more|more|teaching|extension|contact.*)$"
LOCATION = (
    r"(?i)\b(REC|R\.E\.C\.|research (and|&) education center|research center|station|campus|building|hall|"
    r"room|po box|gainesville|lab\b|laboratory|institute|center\b)"
)
ROLE = r"(?i)\b(chair|coordinator|director|head|associate dean|graduate program)\b"
ADVISOR = r"(?i)(?:co-?)?(?:advisor|adviser|major\s+professor|supervisor|mentor|chair|advised\s+by)s?\s*[:\-–—]?\s*"
PERSON_COLUMNS = {
    "name": r"\bname\b|faculty|person", "title": "title|rank|position", "email": "e-?mail", "research": "research|interest|expertise|area|specialt",
}
STUDENT_COLUMNS = {
    "name": r"\bname\b|student", "advisor": "advis|major prof|mentor|supervis|chair", "program": "degree|program|level|track",
    "research": "research|topic|thesis|project|interest|dissertation", "lab": r"\blab\b|group",
}
ROLE_CLASSES = ["primary", "adjunct", "courtesy", "affiliate", "emeritus", "professor", "lecturer", "instructor", "visiting", "research", "associate", "assistant", "joint"]
STATUS_CLASSES = ["individual", "vcard", "entry", "odd", "even", "alt", "first", "last", "faculty", "organization", "family", "connections"]
STAFF_CLASSES = ["staff", "external-advisory-board", "advisory-board", "student", "students", "administration", "admin", "support"]
RANK_LINE = (
    r"(?i)^(?:(?:Distinguished|Assistant|Associate|Research|Clinical|Courtesy|Adjunct|Affiliate|Emeritus|Visiting|Full|Senior|Master)\s+)*"
    r"(?:Professor|Lecturer|Scientist|Instructor|Curator|Scholar|Researcher|Engineer|Librarian)(?:\b.*)?$"
)
GENERIC_LINK = (
    r"(?i)^(read more|more|view( full)?( profile| bio)?|profile|full profile|bio|biography|learn more|website|web ?site|homepage|home page|details|"
    r"see more|visit|cv|more info(rmation)?|about)\b"
)
LINK_NOISE = "prospective|apply|admission|alumni|undergrad|how to|handbook|resources|forms|news|event|seminar|job|career|award|opportunit"
PHONE = r"\d{3}[-.)\s]\d{3,4}"


def text_of(lines: str = "lines") -> Column:
    """The text of an element; its pieces were squashed when they were read."""
    return F.coalesce(F.array_join(lines, " "), F.lit(""))


def _ident() -> Column:
    return F.concat_ws(" ", attr("class"), attr("id"))


def is_chrome(mode: str) -> Column:
    """Site furniture; the loose mode trusts tags alone, for sites that mislabel their whole body."""
    tags = F.col("tag").isin(CHROME_TAGS)
    if mode == "loose":
        return tags
    form = (F.col("tag") == "form") & F.contains(F.lower(F.concat_ws(" ", _ident(), attr("role"))), F.lit("search"))
    role = (F.col("tag") != "form") & F.lower(attr("role")).isin("navigation", "banner", "contentinfo", "search")
    header = (F.col("tag") == "header") & (F.array_contains("inner", "nav") | like(_ident(), r"(?i)site-header|masthead|global|top-?bar"))
    return tags | form | role | header | ((F.col("tag") != "form") & like(_ident(), CHROME_CLASSES))


def _root_rank(mode: str) -> Column:
    rank = F.when(F.col("tag") == "body", 6)
    if mode == "strict":
        rank = (
            F.when(F.col("tag") == "main", 1).when(attr("role") == "main", 2).when(F.col("tag") == "article", 3)
            .when(attr("id") == "content", 4).when(attr("id") == "main", 5).when(F.col("tag") == "body", 6)
        )
    return F.coalesce(rank, F.when(F.col("parent") == -1, 7))


def content_roots(nodes: DataFrame, page: str, mode: str = "strict") -> DataFrame:
    """``(page, root, root_end)``: main, role main, article, #content, #main or body, the first there is; body alone if loose."""
    ranked = nodes.withColumn("__rank", _root_rank(mode))
    best = F.min(F.struct("__rank", "node", "end")).alias("r")
    return ranked.where("__rank is not null").groupBy(page).agg(best).select(page, F.col("r.node").alias("root"), F.col("r.end").alias("root_end"))


def outside(df: DataFrame, page: str, stop: Column) -> DataFrame:
    """Rows that stand in no element for which ``stop`` holds: a running maximum of where such elements end."""
    before = Window.partitionBy(page).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(stop, F.col("end"))).over(before)
    return df.withColumn("__reach", F.coalesce(reach, F.lit(-1))).where(F.col("node") > F.col("__reach")).drop("__reach")


def page_tokens(nodes: DataFrame, page: str = "page_id", mode: str = "strict") -> DataFrame:
    """``(page, tok, kind, level, text, cells)``: headings (h), list items (li), paragraphs (p) and table rows (row) in order.

    Elements are read once and move once, by page, without those that play no part; text is cut only for those that may show it.
    """
    tag, role, text = F.col("tag"), attr("role"), F.col("text")
    heading = like(tag, "^h[1-6]$")
    knob_like = ~heading & (tag.isin("summary", "dt", "button") | role.isin("tab", "button") | like(attr("class"), ACCORDION))
    leaf_like = tag.isin(TEXT_TAGS) & ~F.arrays_overlap("children", F.lit(BLOCK_TAGS)) & ~F.arrays_overlap("inner", F.lit(["ul", "ol", "li", "table"]))
    strong, cell = tag.isin("strong", "b"), tag.isin("td", "th")
    shown = F.when(heading | knob_like | leaf_like | strong | cell, text_of())
    own = F.when(tag == "li", text_of("own"))
    cut = nodes.select(
        page, "node", "end", "parent", "tag", _root_rank(mode).alias("rank"), is_chrome(mode).alias("chrome"), heading.alias("heading"), knob_like.alias("knob_like"), leaf_like.alias("leaf"),
        F.arrays_overlap("inner", F.lit(["ul", "ol"])).alias("lists"), strong.alias("strong"), cell.alias("cell"), shown.alias("text"), own.alias("own"),
    )
    knob = F.col("knob_like") & (text != "") & (F.length(text) < 90)
    row, item = tag == "tr", (tag == "li") & ~F.coalesce(knob, F.lit(False))
    kind = F.when(F.col("heading") | knob, "h").when(row, "row").when(item, "li").when(F.col("leaf"), "p")
    stops = F.when(F.col("heading") | knob | row | F.col("leaf") | (item & ~F.col("lists")), F.col("end"))
    parts = cut.withColumns({"kind": kind, "stops": stops}).where("rank is not null or chrome or strong or cell or kind is not null").drop("heading", "knob_like", "leaf", "lists")
    order = Window.partitionBy(page).orderBy("node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    root = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "node", "end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.withColumn("root", root).withColumn("inside", (F.col("node") > F.col("root.node")) & (F.col("node") <= F.col("root.end")))
    beyond = lambda reach: F.col("node") > F.coalesce(F.max(reach).over(before), F.lit(-1))
    parts = parts.withColumn("inside", F.col("inside") & beyond(F.when(F.col("inside") & F.col("chrome"), F.col("end"))) & ~F.col("chrome"))
    parts = parts.withColumn("flat", F.col("inside") & beyond(F.when(F.col("inside"), F.col("stops"))) & F.col("kind").isNotNull())
    table_part = tag.isin("td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "col")
    # An element counts for itself, and bold text and cells also for what they stand in.
    of = lambda when, owner, part: F.when(when, F.struct(F.col(owner).alias("owner"), F.lit(part).alias("part")))
    told = F.array_compact(F.array(of(F.col("flat") & ~table_part, "node", 0), of(F.col("strong"), "parent", 1), of(F.col("cell"), "parent", 2)))
    parts = parts.select(page, "node", "tag", "kind", "text", "own", F.explode(told).alias("o")).select("*", "o.owner", "o.part")
    point = F.struct("node", "text")
    full = parts.groupBy(page, "owner").agg(
        F.max(F.when(F.col("part") == 0, F.struct("tag", "kind", "text", "own"))).alias("e"), F.min(F.when(F.col("part") == 1, point)).alias("b"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == 2, point))), lambda x: x["text"]).alias("cells"),
    )
    full = full.where("e is not null").select(page, F.col("owner").alias("node"), "e.*", F.col("b.text").alias("bold"), F.when(F.size("cells") > 0, F.col("cells")).alias("cells"))
    in_row = F.when(F.col("kind") == "row", F.array_join(F.array_remove(F.coalesce("cells", F.array().cast("array<string>")), ""), " | "))
    full = full.withColumn("text", F.coalesce(F.when(F.col("kind") == "li", F.col("own")), in_row, F.col("text"))).where("text <> ''")
    is_bold = (F.col("kind") == "p") & (F.col("bold") == F.col("text")) & (F.length("text") <= 60)
    level = F.when(F.col("kind") != "h", 0).when(heading, F.substring("tag", 2, 1).cast("int")).otherwise(5)
    return full.select(
        page, F.row_number().over(order).cast("long").alias("tok"), F.when(is_bold, "h").otherwise(F.col("kind")).alias("kind"),
        F.when(is_bold, 6).otherwise(level).alias("level"), F.when(is_bold, F.regexp_replace("text", "[: ]+$", "")).otherwise(F.col("text")).alias("text"), "cells",
    )


def page_sections(tokens: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, sec, title, level, lines)``: tokens under the heading before them; sec 0 has those before any heading."""
    numbered = tokens.withColumn("sec", od.running_count(F.col("kind") == "h", [page], ["tok"]))
    head = F.max(F.when(F.col("kind") == "h", F.struct("text", "level")))
    lines = F.array_sort(F.collect_list(F.when(F.col("kind") != "h", F.struct("tok", "text"))))
    return numbered.groupBy(page, "sec").agg(head.alias("h"), F.transform(lines, lambda x: x["text"]).alias("lines")).select(
        page, "sec", F.coalesce("h.text", F.lit("")).alias("title"), F.coalesce("h.level", F.lit(0)).alias("level"), "lines"
    )


def section_lines(sections: DataFrame, page: str = "page_id") -> DataFrame:
    """Sections with the lines of the deeper ones that follow, up to the first one not deeper."""
    listed = sections.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("sec", "title", "level", "lines"))).alias("all"))

    def whole(s: Column, i: Column) -> Column:
        later = F.slice(F.col("all"), i + 2, F.size("all"))
        stop = F.array_position(F.transform(later, lambda x: x["level"] <= s["level"]), True)
        inner = F.when(stop > 0, F.slice(later, F.lit(1), (stop - 1).cast("int"))).otherwise(later)
        more = F.when(s["level"] > 0, F.flatten(F.transform(inner, lambda x: x["lines"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(s["sec"].alias("sec"), s["title"].alias("title"), s["level"].alias("level"), F.concat(s["lines"], more).alias("lines"))

    return listed.select(page, F.inline(F.transform("all", whole)))


def split_areas(lines: Column, limit: int = 15) -> tuple[Column, Column]:
    """Areas and summary of section lines: long lines give the summary, others are cut at ; • and |."""
    plain = F.transform(lines, lambda l: F.regexp_replace(tx.squash(l), AREA_PREFIX, ""))
    good = F.filter(plain, lambda l: (l != "") & ~like(l, GENERIC_AREA) & ~like(l, r"(?i)^(select\s+)?publications?\b"))
    summary = F.left(F.coalesce(F.get(F.filter(good, lambda l: F.length(l) > 160), F.lit(0)), F.lit("")), F.lit(700))
    parts = F.flatten(F.transform(F.filter(good, lambda l: F.length(l) <= 160), lambda l: F.split(l, r"\s*[;•|]\s*")))
    trimmed = F.transform(parts, lambda p: tx.strip(p, r" .,\-–"))
    areas = tx.fold_distinct(F.filter(trimmed, lambda p: F.length(p).between(3, 120) & ~like(p, GENERIC_AREA)))
    return F.slice(areas, 1, limit), summary


def inline_labels(tokens: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, tok, label, value)`` of 'Label: value' lines."""
    rows = tokens.where(F.col("kind").isin("p", "li"))
    found = F.array(*[F.struct(F.lit(k).alias("label"), F.regexp_extract("text", p, 2).alias("value")) for k, p in LABELS.items()])
    return rows.select(page, "tok", F.explode(found).alias("f")).select(page, "tok", "f.*").where("value <> ''")


def student_line(line: Column) -> Column:
    """struct(name, program) of 'Jane Doe (PhD)' or 'Doe, Jane - MS'; null if the line is no student."""
    word = r"(?i)\(?\b(ph\.?\s?d\.?|doctoral|ms|m\.s\.|master'?s?|postdoc\w*|undergraduate|b\.s\.)\b\)?"

    def parts(l: Column) -> Column:  # noqa: E741
        whole, inner = F.regexp_extract(l, word, 0), F.regexp_extract(l, word, 1)
        rest = F.when(whole != "", tx.squash(F.replace(l, whole, F.lit(" ")))).otherwise(l)
        cut = tx.let(rest, lambda r: F.when(like(r, r"^[^,]+,\s*[A-Z]"), r).otherwise(F.get(F.split(r, r"\s+[-–—|]\s+|\s*\(|\s*,\s*(?=[a-z])"), F.lit(0))))
        return F.struct(tx.strip(cut, r" ,;:\-").alias("name"), F.when(inner != "", tx.program(inner)).otherwise("").alias("program"))

    def student(p: Column) -> Column:
        return F.when(tx.looks_like_name(p["name"]), F.struct(tx.display_name(p["name"]).alias("name"), p["program"].alias("program")))

    return tx.let(tx.let(tx.squash(line), parts), student)


def page_links(nodes: DataFrame, pages: DataFrame, page: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page, node, href, url, host, path, text, aside)`` of all anchors; aside: they stand in nav or footer."""
    anchors = nodes.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    based = anchors.join(pages.select(page, F.col(url_col).alias("base")), page)
    href = attr("href")
    url = F.when(F.startswith(F.trim(href), F.lit("mailto:")), "").otherwise(ur.canon_url(href, F.col("base")))
    out = based.select(page, "node", "end", "parent", "base", "attrs", href.alias("href"), url.alias("url"), text_of().alias("text"), "aside", "roled", "above")
    return out.withColumns({"host": ur.url_part(F.col("url"), "host"), "path": ur.url_part(F.col("url"), "path")})


def categorize_links(links: DataFrame, domain: str, page: str = "page_id") -> DataFrame:
    """``(page, kind, url, ord)``: links to students, faculty lists and hubs, each URL once by kind."""
    good = links.where((F.col("url") != "") & ur.in_domain(F.col("host"), domain) & ~like(F.col("path"), ur.SKIP_ENDINGS))

    def kind(x: Column) -> Column:
        t, p = x["t"], x["p"]
        hay = F.concat_ws(" ", t, p)
        students = like(hay, r"\b(graduate|grad|phd|ph\.d\.|doctoral|masters?|current)\b.{0,12}\bstudents?\b|/(graduate-students|grad-students|phd-students|current-students|students)/?$")
        students = students | t.isin("students", "our students", "student directory")
        mixed = F.replace(t, F.lit("faculty & staff"), F.lit("faculty"))
        by_text = like(t, r"\b(faculty|professors|investigators|researchers)\b") & ~F.contains(t, F.lit("emerit")) & ~F.contains(mixed, F.lit("staff"))
        by_path = like(p, r"\b(faculty|professors)\b") & ~like(p, "/(news|events?)/") & (F.length(F.regexp_replace(p, "[^/]", "")) <= 4)
        hub = like(t, "^(people|our people|directory|faculty (and|&) staff|faculty/staff|faculty-staff|meet (the )?(faculty|our team)|personnel)$")
        hub = hub | like(p, "/(people|directory|personnel)/?$")
        return F.when((F.length(t) <= 60) & ~like(hay, LINK_NOISE), F.when(students, "students").when(by_text | by_path, "faculty").when(hub, "hub"))

    # One expression, so that a text is folded once: filters over columns would each hold its tables again.
    judged = tx.let(F.struct(tx.fold(F.col("text")).alias("t"), F.lower("path").alias("p")), kind)
    kept = good.withColumn("kind", judged).where("kind is not null")
    return kept.groupBy(page, "kind", "url").agg(F.min("node").alias("ord"))


def next_pages(links: DataFrame, page: str = "page_id", limit: int = 40) -> DataFrame:
    """``(page, url, ord)``: links to further pages of the same listing, not canonicalised but for the fragment."""
    full = F.regexp_replace(ur.join_url(F.col("base"), F.col("href")), "#.*$", "")
    same = links.withColumn("full", full).where(ur.url_part(F.col("full"), "host") == ur.url_part(F.col("base"), "host"))
    stem = lambda u: F.regexp_replace(F.substring_index(F.regexp_replace(ur.url_part(u, "path"), "/$", ""), "/page/", 1), "/$", "")
    paged = like(F.col("full"), r"([?&](page|pg|paged|p|cn-pg|pagenum|pageno|pagenumber)=\d+)|(/page/\d+/?$)") & (stem(F.col("full")) == stem(F.col("base")))
    text = F.lower("text")
    named = F.contains(attr("rel"), F.lit("next")) | text.isin("next", "next page", "›", "»", "next ›", "next »") | F.contains(F.lower(attr("aria-label")), F.lit("next"))
    found = same.where((named | (paged & like(text, r"^\d+$"))) & (F.col("full") != F.col("base")))
    once = found.groupBy(page, F.col("full").alias("url")).agg(F.min("node").alias("ord"))
    return od.top_rows(once, [page], ["ord"], limit)


BLOCK = 64


def within(outer: DataFrame, inner: DataFrame, page: str | list[str], start: str, stop: str, at: str) -> DataFrame:
    """Rows of ``inner`` with the rows of ``outer`` that they stand in (start < at <= stop), met by blocks of BLOCK elements."""
    keys = [page] if isinstance(page, str) else page
    spread = outer.withColumn("__block", F.explode(F.sequence((F.col(start) / BLOCK).cast("int"), (F.col(stop) / BLOCK).cast("int"))))
    placed = inner.withColumn("__block", (F.col(at) / BLOCK).cast("int"))
    return spread.join(placed, [*keys, "__block"]).where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(stop))).drop("__block")


def named_nodes(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, node, tag, attrs, text, named)`` of the elements that may hold a card's name; named: their text is like one."""
    may = F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "strong", "b", "a") | (attr("itemprop") == "name") | like(attr("class"), r"(^|\s)(fn|n|name)(\s|$)")
    rows = nodes.where(may).select(page, "node", "tag", "attrs", text_of().alias("text"))
    return rows.withColumn("named", tx.looks_like_name(F.col("text")))


def link_names(links: DataFrame, nodes: DataFrame, page: str = "page_id", names: DataFrame | None = None) -> DataFrame:
    """Links with ``name`` and ``strong``: from the link's text or labels, else (weak) its picture or a heading near by.

    Near by: one of the first four headings of the nearest of the four elements around the link that has a name there.
    """
    names = named_nodes(nodes, page) if names is None else names
    label = F.coalesce(F.nullif(attr("aria-label"), F.lit("")), attr("title"))
    label = F.regexp_replace(label, r"(?i)^(view|read|visit|go to)\s+(the\s+)?(profile|bio|page)?\s*(for|of)?\s*", "")
    pictures = nodes.where("tag = 'img'").select(page, F.col("node").alias("i"), attr("alt").alias("alt"))
    alt = within(links.where("end > node").select(page, "node", "end"), pictures, page, "node", "end", "i").groupBy(page, "node").agg(F.min_by("alt", "i").alias("alt"))
    shown = F.coalesce(F.nullif(F.regexp_extract("alt", r"(?i)(?:headshot|photo|picture|portrait|image)\s+of\s+(?:dr\.?\s+)?([^,.–—]+)", 1), F.lit("")), F.col("alt"), F.lit(""))
    generic = like(F.col("text"), GENERIC_LINK) | (F.col("text") == "")
    heads = names.where(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "strong", "b")).select(page, F.col("node").alias("h"), "text", "named")
    around = links.where(generic).select(page, "node", F.posexplode(F.slice("above", 1, 4)).alias("climb", "a"))
    ends = nodes.select(page, F.col("node").alias("a"), F.col("end").alias("a_end"))
    cards = around.select(page, "a").distinct().join(ends, [page, "a"])
    order = Window.partitionBy(page, "a").orderBy("h")
    first = within(cards, heads, page, "a", "a_end", "h").withColumn("no", F.row_number().over(order)).where("no <= 4 and named")
    first = first.groupBy(page, "a").agg(F.min_by("text", "h").alias("t"))
    near = around.join(first, [page, "a"]).groupBy(page, "node").agg(F.min_by("t", "climb").alias("near"))
    # Written before names are judged, whose large expressions then stand in a plan without shuffles.
    joined = written(links.join(alt, [page, "node"], "left").join(near, [page, "node"], "left"), "links-in-cards")
    strong = F.when(tx.looks_like_name(F.col("text")), F.col("text")).when(tx.looks_like_name(label), label)
    weak = F.when(tx.looks_like_name(shown), shown).otherwise(F.col("near"))
    picked = joined.withColumn("__strong", strong).withColumn("__name", F.coalesce("__strong", weak))
    named = picked.where("__name is not null").withColumns({"strong": F.col("__strong").isNotNull(), "name": tx.display_name(F.col("__name"))})
    return named.where("name <> ''").drop("alt", "near", "__strong", "__name")


def card_fields(cards: DataFrame, domain: str) -> DataFrame:
    """title, e-mail, location, roles and specialty of cards (name, lines, loud, linked, given); linked: cards around a
    profile link, which keep three special lines and read roles from their lines; others have roles ``given``."""
    linked = F.col("linked")
    fine = lambda l, n: F.length(l) < n
    pick = lambda rows: F.coalesce(F.get(rows, F.lit(0)), F.lit(""))
    quiet = F.transform("lines", lambda l: F.struct(l.alias("l"), is_noise_text(l).alias("noise"), like(l, TITLE).alias("titled")))
    out = cards.withColumn("__lines", quiet)
    titled = F.filter("__lines", lambda x: x["titled"] & ~x["noise"] & (F.length(x["l"]) < F.when(linked, 120).otherwise(140)))
    out = out.withColumn("title", F.coalesce(F.get(titled, F.lit(0))["l"], F.lit("")))
    out = out.withColumn("__rest", F.filter("__lines", lambda x: (x["l"] != F.col("title")) & (linked | ~x["noise"])))
    out = out.withColumn("location", pick(F.transform(F.filter("__rest", lambda x: like(x["l"], LOCATION) & fine(x["l"], 100)), lambda x: x["l"])))
    roles = F.transform(F.filter("__rest", lambda x: like(x["l"], ROLE) & fine(x["l"], 100)), lambda x: x["l"])
    out = out.withColumn("__roles", F.when(linked, roles).otherwise(F.array().cast("array<string>")))
    plain = lambda x: (x["l"] != F.col("location")) & ~F.contains(x["l"], F.lit("@")) & ~like(x["l"], PHONE) & ~x["noise"]
    special = F.filter("__rest", lambda x: plain(x) & fine(x["l"], F.when(linked, 120).otherwise(100)) & ~F.array_contains("__roles", x["l"]))
    specialty = F.slice(F.transform(special, lambda x: x["l"]), F.lit(1), F.when(linked, 3).otherwise(2))
    email = em.pick_email(em.find_emails(F.array_join("loud", " ")), F.col("name"), domain)
    shown = F.when(linked, F.slice("__roles", 1, 2)).otherwise(F.slice("given", 1, 3))
    return out.withColumns({"specialty": specialty, "email": email, "roles": shown, "lines": F.slice("lines", 1, 6)}).drop("__lines", "__rest", "__roles", "loud", "linked", "given")


_CARD = ["ord", "profile_url", "name", "lines", "loud", "given", "areas"]
_NONE = "cast(array() as array<string>)"


_METHODS = {"strict": "links", "loose": "loose"}


def linked_cards(nodes: DataFrame, links: DataFrame, domain: str, page: str = "page_id", modes: tuple[str, ...] = ("strict",)) -> DataFrame:
    """Cards of people with profile links: links in large path groups, each with the text of the largest of the five elements
    around it that holds no other candidate's link. links: the page's links with names. ``method`` names the mode; all modes are worked out at once."""
    own = [page, "method"]
    roots = [content_roots(nodes, page, m).withColumn("method", F.lit(_METHODS[m])) for m in modes]
    links = links.join(reduce(DataFrame.union, roots), page).where("node > root and node <= root_end and not aside and url <> ''")
    links = links.where(~F.col("roled") | (F.col("method") != "links"))
    here = (ur.url_part(F.col("base"), "host") == F.col("host")) & (F.regexp_replace("path", "/$", "") == F.regexp_replace(ur.url_part(F.col("base"), "path"), "/$", ""))
    links = links.where(ur.in_domain(F.col("host"), domain) & ~like(F.col("path"), ur.SKIP_ENDINGS) & ~here)
    best = links.groupBy(*own, "url").agg(F.min("node").alias("ord"), F.min_by(F.struct("node", "host", "path", "name", "above"), F.struct(~F.col("strong"), "node")).alias("c"))
    query = F.contains("url", F.lit("?"))
    folder = F.when(query, F.col("path")).otherwise(F.coalesce(F.nullif(F.regexp_extract("path", "^(.*/)[^/]*/[^/]*$", 1), F.lit("")), F.lit("/")))
    cands = best.select(*own, "url", "ord", "c.*").withColumn("folder", folder)
    cands = written(cands.withColumn("prefix", F.concat("host", "folder")), "candidates")
    groups = od.large_groups(cands, own, "prefix").select(*own, "prefix")
    chosen = cands.join(groups, [*own, "prefix"]).where(~like(F.col("folder"), ur.SKIP_PATHS))
    around = chosen.select(*own, "node", F.posexplode(F.concat(F.array("node"), F.slice("above", 1, 5))).alias("climb", "a"))
    ends = nodes.select(page, F.col("node").alias("a"), F.col("end").alias("a_end"))
    sized = around.select(*own, "a").distinct().join(ends, [page, "a"])
    held = within(sized.withColumn("__from", F.col("a") - 1), cands.select(*own, F.col("node").alias("o")), own, "__from", "a_end", "o")
    alone = held.groupBy(*own, "a").agg(F.count(F.lit(1)).alias("n"))
    counted = around.join(alone, [*own, "a"]).withColumn("__free", (F.col("n") == 1) | (F.col("climb") == 0))
    stop = F.min(F.when(~F.col("__free"), F.col("climb"))).over(Window.partitionBy(*own, "node"))
    card = counted.withColumn("__stop", stop).where("__stop is null or climb < __stop").groupBy(*own, "node").agg(F.max_by("a", "climb").alias("a"))
    texts = nodes.select(page, F.col("node").alias("a"), "lines", "loud")
    rows = chosen.join(card, [*own, "node"]).join(texts, [page, "a"])
    return rows.select(*own, "ord", F.col("url").alias("profile_url"), "name", "lines", "loud", F.expr(_NONE).alias("given"), F.expr(_NONE).alias("areas"))


def _first_of_name(cards: DataFrame, keys: list[str]) -> DataFrame:
    return od.keep_first(cards.withColumn("__key", tx.name_key(F.col("name"))), [*keys, "__key"], ["ord"]).drop("__key")


def own_cards(cards: DataFrame, page: str = "page_id") -> DataFrame:
    """Cards without the lines that tell their name once more, and of each ``key`` (of the name) the first on its page by its method.

    Of cards around a link the lines with the name go, of others short lines with its last word. Names and lines of all methods are
    folded at once in a step without a shuffle: folding brings tables of 25,000 characters, which a plan with shuffles would repeat
    with each of its changes.
    """
    around = F.col("method").isin(*_METHODS.values())
    told = F.array(F.when(around, F.col("name")).otherwise(F.substring_index("name", " ", -1)), tx.display_name(F.col("name")))

    def judged(folded: Column) -> Column:
        fresh = F.filter("lines", lambda l, i: ~F.contains(F.get(folded, i + 2), F.get(folded, F.lit(0))) | (~around & (F.length(l) > 60)))
        return F.struct(fresh.alias("lines"), tx.key_of(F.get(folded, F.lit(1))).alias("key"))

    rows = cards.withColumn("__own", tx.let(tx.fold_each(F.concat(told, "lines")), judged)).drop("lines")
    rows = written(rows, "own-cards").select(*rows.columns[:-1], "__own.*")
    return written(od.keep_first(rows, [page, "method", "key"], ["ord"]), "first-cards")


def linked_people(nodes: DataFrame, pages: DataFrame, domain: str, page: str = "page_id", mode: str = "strict") -> DataFrame:
    """People of listing pages by their profile links."""
    return people_of_cards(linked_cards(nodes, link_names(page_links(nodes, pages, page), nodes, page), domain, page, (mode,)), domain, page).drop("method", "key")


def people_of_cards(cards: DataFrame, domain: str, page: str = "page_id") -> DataFrame:
    """``own_cards`` with their fields read, without those of staff."""
    people = card_fields(own_cards(cards, page).withColumn("linked", F.col("method").isin(*_METHODS.values())), domain)
    people = people.withColumn("specialty", F.when(F.size("areas") > 0, F.slice("areas", 1, 6)).otherwise(F.col("specialty"))).drop("areas")
    return people.where(plausible_faculty(F.col("title"), F.col("lines")) & ~is_noise_text(F.col("name")))


def table_cells(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, table_node, row, col, is_head, cell, cell_end, text, listed, loud)`` of all tables; rows and columns count from 0.

    listed: a cell's lines with semicolons between them; loud: its text without what stands in nav or footer. Both are null
    where they are as its text is, so that most cells move their text once and not three times.
    """
    tables = nodes.where("tag = 'table'").select(page, F.col("node").alias("table_node"), F.col("end").alias("table_end"))
    trs = nodes.where("tag = 'tr'").select(page, F.col("node").alias("tr"))
    rows = within(tables, trs, page, "table_node", "table_end", "tr").groupBy(page, "tr").agg(F.max("table_node").alias("table_node"))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy(page, "table_node").orderBy("tr")) - 1)
    cells = nodes.where(F.col("tag").isin("td", "th")).select(
        page, F.col("parent").alias("tr"), F.col("node").alias("cell"), F.col("end").alias("cell_end"), (F.col("tag") == "th").alias("is_head"), text_of().alias("text"),
        F.array_join("lines", "; ").alias("listed"), F.array_join("loud", " ").alias("loud"),
    ).withColumns({c: F.nullif(c, "text") for c in ("listed", "loud")})
    col = F.row_number().over(Window.partitionBy(page, "tr").orderBy("cell")) - 1
    return rows.join(cells, [page, "tr"]).withColumn("col", col).drop("tr")


def mapped_rows(cells: DataFrame, columns: dict[str, str], last_wins: bool, page: str = "page_id") -> DataFrame:
    """``(page, table_node, row, <column>..)``: data rows by header meaning; of equal headers the last or the first counts."""
    heads = cells.where("row = 0 and is_head").withColumn("head", tx.fold(F.col("text")))
    meaning = F.array_compact(F.array(*[F.when(like(F.col("head"), p), F.lit(k)) for k, p in columns.items()]))
    pick = F.max if last_wins else F.min
    at = heads.select(page, "table_node", "col", F.explode(meaning).alias("key")).groupBy(page, "table_node", "key").agg(pick("col").alias("col"))
    body = cells.where("row > 0").join(at, [page, "table_node", "col"])
    value = lambda k: F.max(F.when(F.col("key") == k, F.struct("text", "listed", "loud", "cell", "cell_end"))).alias(k)
    return body.groupBy(page, "table_node", "row").agg(*[value(k) for k in columns]).where("name is not null")


def table_people(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """People of tables; of equal headers the last counts. Their profile is the first absolute link of the name's cell."""
    rows = mapped_rows(table_cells(nodes, page), PERSON_COLUMNS, True, page).where(tx.looks_like_name(F.col("name.text")))
    empty = F.array().cast("array<string>")
    areas, _ = split_areas(F.when(F.col("research").isNull(), empty).otherwise(F.array(F.coalesce("research.listed", "research.text"))))
    found = em.find_emails(F.coalesce("email.loud", "email.text"))
    text = lambda c: F.coalesce(F.col(c)["text"], F.lit(""))
    people = rows.select(
        page, "table_node", "row", tx.display_name(text("name")).alias("name"), text("title").alias("title"),
        F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("email"), F.coalesce(areas, empty).alias("specialty"), F.col("name.cell").alias("cell"), F.col("name.cell_end").alias("cell_end"),
    )
    anchors = nodes.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).select(page, F.col("node").alias("i"), ur.canon_url(attr("href")).alias("u"))
    linked = within(people.select(page, "cell", "cell_end"), anchors, page, "cell", "cell_end", "i").groupBy(page, "cell").agg(F.min_by("u", "i").alias("u"))
    return people.join(linked, [page, "cell"], "left").withColumn("profile_url", F.coalesce("u", F.lit(""))).drop("cell", "cell_end", "u")


VCARD_NAMES = [".fn", ".n", "h2", "h3", "h4", "strong"]
CARD_NAMES = [".fn", ".n", "[itemprop=name]", ".name", "h1", "h2", "h3", "h4", "h5", "strong", "b", "a"]


def _selects(selector: str) -> Column:
    if selector.startswith("."):
        return F.array_contains(F.split(attr("class"), r"\s+"), selector[1:])
    return attr("itemprop") == "name" if selector.startswith("[") else F.col("tag") == selector


def _named_in(cards: DataFrame, names: DataFrame, page: str, selectors: list[str], most: int) -> DataFrame:
    """``(page, card, name)``: of the first ``most`` elements inside a card for each selector, the first that is like a name, selector by selector."""
    ranks = F.array_compact(F.array(*[F.when(_selects(x), F.lit(i)) for i, x in enumerate(selectors)]))
    points = names.select(page, F.col("node").alias("i"), "text", "named", F.explode(ranks).alias("rank"))
    hit = within(cards.select(page, "card", "card_end"), points, page, "card", "card_end", "i")
    near = hit.withColumn("no", F.row_number().over(Window.partitionBy(page, "card", "rank").orderBy("i"))).where((F.col("no") <= most) & F.col("named"))
    return near.groupBy(page, "card").agg(tx.display_name(F.min_by("text", F.struct("rank", "i"))).alias("name"))


def _profile_links(cards: DataFrame, links: DataFrame, page: str, domain: str) -> DataFrame:
    """``(page, card, profile_url)``: the first link of a card that speaks of a profile, else its first link, none to the page itself."""
    own = (F.regexp_replace("path", "/$", "") == F.regexp_replace(ur.url_part(F.col("base"), "path"), "/$", "")) & ~F.contains("url", F.lit("?"))
    inner = links.where((F.col("url") != "") & ur.in_domain(F.col("host"), domain) & ~like(F.col("path"), ur.SKIP_ENDINGS) & ~own).select(page, F.col("node").alias("i"), "url", "text")
    around = cards.select(page, "card", (F.col("card") - 1).alias("__from"), "card_end")
    hit = within(around, inner, page, "__from", "card_end", "i")
    wanted = ~like(F.col("text"), "(?i)profile|bio|more|read|view")
    return hit.groupBy(page, "card").agg(F.min_by("url", F.struct(wanted, "i")).alias("profile_url"))


def vcard_cards(nodes: DataFrame, links: DataFrame, names: DataFrame, domain: str, page: str = "page_id") -> DataFrame:
    """Microformat cards; their classes tell staff, roles and research areas."""
    classes = F.filter(F.split(attr("class"), r"\s+"), lambda c: c != "")
    vcard = F.array_contains(classes, "vcard")
    cards = outside(nodes.where(vcard & ~F.col("aside") & ~F.col("roled")), page, F.lit(True)).withColumn("classes", classes)
    staff = F.arrays_overlap("classes", F.lit(STAFF_CLASSES)) & ~F.array_contains("classes", "faculty")
    cards = cards.where(~staff).select(page, F.col("node").alias("card"), F.col("end").alias("card_end"), "classes", "lines", "loud")
    named = cards.join(_named_in(cards, names, page, VCARD_NAMES, 1), [page, "card"]).join(_profile_links(cards, links, page, domain), [page, "card"], "left")
    roles = F.transform(F.filter("classes", lambda c: F.array_contains(F.lit(ROLE_CLASSES), c)), lambda c: F.initcap(F.replace(c, F.lit("-"), F.lit(" "))))
    known = F.lit(ROLE_CLASSES + STATUS_CLASSES + STAFF_CLASSES)
    slugs = F.filter("classes", lambda c: ~F.array_contains(known, c) & ~like(c, "^(cn-|cn_|is-|has-|js-)") & (F.length(c) > 3) & ~like(c, r"^([a-f0-9\-]{20,}|\d+)$"))
    rows = named.withColumns({"given": roles, "areas": F.transform(slugs, tx.slug_to_phrase), "ord": F.col("card"), "profile_url": F.coalesce("profile_url", F.lit(""))})
    return rows.select(page, *_CARD)


def repeated_cards(nodes: DataFrame, links: DataFrame, names: DataFrame, domain: str, page: str = "page_id") -> DataFrame:
    """Repeated sibling cards: of all parents with five or more like children, most of them named, the one with most.

    Cards are chosen by their first lines and their length; their texts join the chosen ones alone.
    """
    bad = ["script", "style", "select", "nav", "footer", "head", "table", "thead", "tr"]
    long = F.length(F.array_join("lines", " ")) > 1500
    kids = nodes.where(~F.col("tag").isin("script", "style", "nav", "footer") & ~F.col("aside")).select(
        page, "parent", "tag", F.col("node").alias("card"), F.col("end").alias("card_end"), long.alias("long"), F.slice("lines", 1, 4).alias("leading")
    )
    parents = nodes.where(~F.col("tag").isin(bad)).select(page, F.col("node").alias("parent"))
    sizes = kids.groupBy(page, "parent", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("card").alias("f"))
    group = sizes.groupBy(page, "parent").agg(F.max_by(F.struct("tag", "n"), F.struct("n", -F.col("f"))).alias("g")).select(page, "parent", "g.tag", "g.n").where("n >= 5")
    kids = kids.join(group.join(parents, [page, "parent"]), [page, "parent", "tag"])
    before = Window.partitionBy(page, "parent").orderBy("card").rowsBetween(Window.unboundedPreceding, 0)
    cards = kids.withColumn("__cut", F.max(F.col("long").cast("int")).over(before)).where("__cut = 0")
    leading = F.filter(F.transform("leading", tx.squash), tx.looks_like_name)
    cards = written(cards.withColumn("line_name", tx.display_name(F.get(leading, F.lit(0)))).drop("__cut", "long", "leading"), "cards")
    named = cards.join(_named_in(cards, names, page, CARD_NAMES, 3), [page, "card"], "left")
    named = named.withColumn("name", F.coalesce("name", F.nullif("line_name", F.lit("")))).where("name is not null").withColumn("ord", F.col("card"))
    named = written(_first_of_name(named.drop("line_name"), [page, "parent"]), "named-cards")
    found = named.groupBy(page, "parent", "n").agg(F.count(F.lit(1)).alias("m")).where((F.col("m") >= 5) & (F.col("m") >= F.col("n") * 0.6))
    best = found.groupBy(page).agg(F.max_by("parent", F.struct("m", -F.col("parent"))).alias("parent"))
    texts = nodes.select(page, F.col("node").alias("card"), "lines", "loud")
    chosen = written(named.join(best, [page, "parent"]), "chosen-cards")
    rows = chosen.join(texts, [page, "card"]).join(_profile_links(chosen, links, page, domain), [page, "card"], "left")
    rows = rows.withColumns({"profile_url": F.coalesce("profile_url", F.lit("")), "given": F.expr(_NONE), "areas": F.expr(_NONE)})
    return rows.select(page, *_CARD)


def vcard_people(nodes: DataFrame, pages: DataFrame, domain: str, page: str = "page_id") -> DataFrame:
    """People of microformat cards."""
    cards = vcard_cards(nodes, page_links(nodes, pages, page), named_nodes(nodes, page), domain, page)
    return people_of_cards(cards.withColumn("method", F.lit("vcards")), domain, page).drop("method", "key")


def card_people(nodes: DataFrame, pages: DataFrame, domain: str, page: str = "page_id") -> DataFrame:
    """People of repeated sibling cards."""
    cards = repeated_cards(nodes, page_links(nodes, pages, page), named_nodes(nodes, page), domain, page)
    return people_of_cards(cards.withColumn("method", F.lit("cards")), domain, page).drop("method", "key")


def listing_people(nodes: DataFrame, pages: DataFrame, domain: str, page: str = "page_id", links: DataFrame | None = None) -> DataFrame:
    """People of listing pages by the method that finds clearly most on a page: links, microformat cards or repeated cards.

    Links are taken from the content, or from the whole body where that has under three and the body more. Cards win with
    five or more and 1.4 times as many; microformat cards before others if they are not clearly fewer. Links, names and the
    cards of all methods are written as tables, as each is read several times; lines and fields are read once for all methods.
    links: the ``page_links``, if they are at hand as a table.
    """
    columns = [page, "ord", "name", "profile_url", "title", "email", "location", "roles", "specialty", "lines", "method"]
    links = written(page_links(nodes, pages, page), "links") if links is None else links
    names = written(named_nodes(nodes, page), "names")
    named = written(link_names(links, nodes, page, names), "named-links")
    found = [
        linked_cards(nodes, named, domain, page, ("strict", "loose")), vcard_cards(nodes, links, names, domain, page).withColumn("method", F.lit("vcards")),
        repeated_cards(nodes, links, names, domain, page).withColumn("method", F.lit("cards")),
    ]
    cards = [written(d.select(page, *_CARD, "method"), "method-cards") for d in found]
    # Read as one table: a union would hold the expressions of the fields once for each method.
    cards = nodes.sparkSession.read.schema(cards[0].schema).parquet(*[c.written_to for c in cards])
    every = written(people_of_cards(cards, domain, page).select(*columns, "key"), "listed")
    counts = every.groupBy(page).pivot("method", ["links", "loose", "vcards", "cards"]).count().na.fill(0)
    body = (F.col("links") < 3) & (F.col("loose") > F.col("links"))
    counts = counts.withColumn("linked", F.when(body, "loose").otherwise("links")).withColumn("n_linked", F.greatest("links", F.when(body, F.col("loose")).otherwise(F.lit(0))))
    alternative = F.when((F.col("vcards") >= 5) & (F.col("vcards") >= 0.8 * F.col("cards")), "vcards").when(F.col("vcards") >= F.col("cards"), "vcards").otherwise("cards")
    n_alt = F.when(F.col("alt") == "vcards", F.col("vcards")).otherwise(F.col("cards"))
    choice = counts.withColumn("alt", alternative).withColumn("method", F.when((n_alt >= 5) & (n_alt >= 1.4 * F.col("n_linked")), F.col("alt")).otherwise(F.col("linked")))
    choice = written(choice.select(page, "linked", "method"), "listing-methods")
    linked = every.join(choice.select(page, F.col("linked").alias("method")), [page, "method"])
    known = linked.groupBy(page, "key").agg(F.max_by("profile_url", "ord").alias("known"))
    chosen = every.join(choice.select(page, "method"), [page, "method"]).join(known, [page, "key"], "left")
    filled = chosen.withColumns({"profile_url": F.coalesce(F.nullif("profile_url", F.lit("")), "known", F.lit("")), "method": F.when(F.col("method") == "loose", "links").otherwise(F.col("method"))})
    return filled.select(*columns)


def people_on_pages(nodes: DataFrame, pages: DataFrame, domain: str, page: str = "page_id", links: DataFrame | None = None) -> DataFrame:
    """``listing_people``, and on pages with under three of them the people of tables whose names are not among them."""
    listed = written(listing_people(nodes, pages, domain, page, links), "people")
    few_there = pages.select(page).join(listed.groupBy(page).agg(F.count(F.lit(1)).alias("n")), page, "left").where("n is null or n < 3").select(page)
    tables = table_people(nodes, page).join(few_there, page, "left_semi").join(listed.select(page, "name"), [page, "name"], "left_anti")
    none = F.expr(_NONE)
    rows = tables.select(
        page, (F.lit(1 << 30) + F.col("table_node") + F.col("row")).cast("int").alias("ord"), "name", "profile_url", "title", "email", F.lit("").alias("location"),
        none.alias("roles"), "specialty", none.alias("lines"), F.lit("tables").alias("method"),
    )
    return listed.union(rows)


def page_students(nodes: DataFrame, tokens: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, ord, name, program, advisor_raw, research, lab)``: students of tables, or of headed lists on pages without any.

    In tables the first of equal headers counts. In lists a heading's programme holds for the lines below it, and an
    advisor's line goes to the student before it.
    """
    rows = mapped_rows(table_cells(nodes, page), STUDENT_COLUMNS, False, page).where(tx.looks_like_name(F.col("name.text")))
    text = lambda c: F.coalesce(F.col(c)["text"], F.lit(""))
    heads = nodes.where(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6", "strong", "caption")).withColumn("t", text_of())
    heads = heads.where("t <> '' and length(t) < 80").select(page, F.col("node").alias("h"), "t", "tag")
    before = rows.select(page, "table_node").distinct().join(heads, page).where("h < table_node or (tag = 'caption' and h = table_node + 1)")
    group = before.groupBy(page, "table_node").agg(F.coalesce(F.max_by(F.nullif(tx.program(F.col("t")), F.lit("")), "h"), F.lit("")).alias("group"))
    by_table = rows.join(group, [page, "table_node"], "left").select(
        page, (F.col("table_node").cast("long") * 100_000 + F.col("row")).alias("ord"), tx.display_name(text("name")).alias("name"),
        F.coalesce(F.nullif(tx.program(text("program")), F.lit("")), "group", F.lit("")).alias("program"), text("advisor").alias("advisor_raw"),
        text("research").alias("research"), text("lab").alias("lab"),
    )
    by_table = written(by_table, "students-of-tables")  # this and the lines are read several times, with large expressions
    rest = tokens.join(by_table.select(page).distinct(), page, "left_anti")
    label = F.regexp_extract("text", ADVISOR, 0)
    is_head = F.col("kind") == "h"
    lined = rest.withColumns({"__adv": ~is_head & (label != ""), "__group": od.carry_forward(F.when(is_head, F.nullif(tx.program(F.col("text")), F.lit(""))), [page], ["tok"])})
    lined = lined.withColumn("__st", F.when(~is_head & ~F.col("__adv"), student_line(F.col("text"))))
    left = tx.strip(F.get(F.split("text", ADVISOR, 2), F.lit(0)), r" \-–—|,:()")
    after = tx.squash(F.coalesce(F.get(F.split("text", ADVISOR, 2), F.lit(1)), F.lit("")))
    start = F.col("__st").isNotNull() | is_head
    lined = lined.withColumns({"__no": od.running_count(start, [page], ["tok"]), "__left": left, "__after": after})
    lined = written(lined.select(page, "tok", "__adv", "__group", "__st", "__no", "__left", "__after"), "student-lines")
    first_adv = lined.where("__adv").groupBy(page, "__no").agg(F.min_by("__after", "tok").alias("advisor"), F.min("tok").alias("adv_tok"))
    listed = lined.where("__st is not null").join(first_adv, [page, "__no"], "left").select(
        page, F.col("tok").alias("ord"), F.col("__st.name").alias("name"), F.coalesce(F.nullif("__st.program", F.lit("")), "__group", F.lit("")).alias("program"),
        F.coalesce("advisor", F.lit("")).alias("advisor_raw"), F.lit("").alias("research"), F.lit("").alias("lab"),
    )
    pending = lined.where("__st is not null").select(page, "__no")
    used = first_adv.join(pending, [page, "__no"]).select(page, F.col("adv_tok").alias("tok"))
    single = lined.where(F.col("__adv") & tx.looks_like_name(F.col("__left"))).join(used, [page, "tok"], "left_anti").select(
        page, F.col("tok").alias("ord"), tx.display_name(F.col("__left")).alias("name"), F.coalesce("__group", F.lit("")).alias("program"),
        F.col("__after").alias("advisor_raw"), F.lit("").alias("research"), F.lit("").alias("lab"),
    )
    return by_table.union(listed).union(single)


def catalogue_roster(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, pos, line)`` -> ``(key, name, title, department)``: 'Last, First', a rank within four lines, then a department.

    Of equal names the last counts. The line after the rank is no department if it is a rank or the next person.
    """
    order = Window.partitionBy(page).orderBy("pos")
    ahead = [F.lead("line", i).over(order) for i in range(1, 7)]
    wide = lines.select(page, "pos", "line", *[a.alias(f"a{i}") for i, a in enumerate(ahead)])
    ranks = F.array(*[F.coalesce((F.length(f"a{i}") < 80) & like(F.col(f"a{i}"), RANK_LINE), F.lit(False)) for i in range(4)])
    at = (F.array_position(ranks, True) - 1).cast("int")
    every = F.array(*[F.col(f"a{i}") for i in range(6)])
    rows = wide.where(F.contains("line", F.lit(",")) & F.length("line").between(4, 100) & ~like(F.col("line"), r"\d|https?://")).withColumns({"at": at, "next": every}).where("at >= 0")
    possible, following = F.get("next", F.col("at") + 1), F.get("next", F.col("at") + 2)
    person = F.contains(possible, F.lit(",")) & F.coalesce(like(following, RANK_LINE), F.lit(False))
    good = (F.col("at") < 3) & (F.length(possible) < 120) & ~like(possible, RANK_LINE) & ~person
    rows = rows.select(
        "pos", F.regexp_replace(F.lower("line"), "[^a-z0-9]", "").alias("key"), tx.display_name(F.col("line")).alias("name"), F.get("next", F.col("at")).alias("title"),
        F.when(F.coalesce(good, F.lit(False)), possible).otherwise("").alias("department"),
    )
    return od.keep_last(rows, ["key"], ["pos"])


def catalogue_units(nodes: DataFrame, pages: DataFrame, group_pattern: str, page: str = "page_id") -> DataFrame:
    """``(college, name, url, ord)``: list links under the last h2, where that names a group; each pair once."""
    first = page_links(nodes, pages, page).select(page, F.col("node").alias("i"), "url", "text")
    marks = nodes.where(F.col("tag").isin("h2", "li")).withColumn("t", text_of())
    group = F.when(F.col("tag") == "h2", F.when(like(F.col("t"), group_pattern), F.col("t")).otherwise(""))
    under = marks.withColumn("college", od.carry_forward(group, [page], ["node"])).where("tag = 'li' and college <> ''")
    hit = within(under.select(page, "node", "end", "college"), first, page, "node", "end", "i")
    one = hit.groupBy(page, "node", "college").agg(F.min_by(F.struct("url", "text"), "i").alias("l"))
    rows = one.select("college", F.col("l.text").alias("name"), F.col("l.url").alias("url"), F.col("node").alias("ord")).where("name <> '' and url <> ''")
    return od.keep_first(rows, ["college", "name"], ["ord"])


def unit_website(links: DataFrame, domain: str, skip_hosts: list[str], page: str = "page_id") -> DataFrame:
    """``(page, site)``: the first link of a unit page into the domain, links that speak of a website first."""
    good = links.where((F.col("url") != "") & ur.in_domain(F.col("host"), domain) & ~F.col("host").isin(skip_hosts))
    weight = F.when(like(tx.fold(F.col("text")), rf"website|more info|department|school|http|\.{domain}|home"), 2).otherwise(1)
    return good.groupBy(page).agg(F.max_by("url", F.struct(weight, -F.col("node"))).alias("site"))


def profile_score(fields: list[Column]) -> Column:
    return reduce(Column.__add__, [f.cast("int") for f in fields])


def parse_profiles(nodes: DataFrame, pages: DataFrame, domain: str, page: str = "page_id", hint: str | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """One row a profile page, strictly read, or loosely where that finds more and the strict reading scores below 3.

    nodes may hold more than the profile pages; tokens: their ``page_tokens``, if at hand. Only pages whose strict reading scores below
    3 or gives nothing are read loosely. Each part of a profile is written as a table, so that no plan holds the expressions of all of them: the driver keeps every
    plan as text, anew whenever one of its stages ends.
    """
    links = written(page_links(nodes, pages, page).where("not aside and url <> ''"), "profile-links")
    found, mailed = written(_profile_links_by_kind(links, domain, page), "profile-link-kinds"), written(_mailed(nodes, page), "profile-addresses")
    titles = written(nodes.where("tag = 'title'").groupBy(page).agg(F.min_by(text_of(), "node").alias("__title")), "profile-page-titles")
    parts, given = (found, mailed, titles, domain, page), [hint] if hint else []
    strict = written(_profiles(nodes, pages, tokens, *parts, "strict", hint).withColumn("mode", F.lit(0)), "profiles-read")
    left = written(pages.select(page, "url", *given).join(strict.where("score >= 3").select(page), page, "left_anti"), "profiles-left")
    every, n_left = strict, left.count()
    if n_left:
        # Where most pages are left, moving their elements would cost more than reading the others too.
        rest = nodes if 2 * n_left > pages.count() else nodes.join(left.select(page), page, "left_semi")
        every = strict.union(written(_profiles(rest, left, None, *parts, "loose", hint).withColumn("mode", F.lit(1)), "profiles-read"))
    order = F.struct(F.when((F.col("mode") == 0) & (F.col("score") >= 3), 100).otherwise(F.col("score")), -F.col("mode"))
    others = [c for c in every.columns if c != page]
    best = every.groupBy(page).agg(F.max_by(F.struct(*others), order).alias("r"))
    return best.select(page, *[F.col("r")[c].alias(c) for c in others if c != "mode"])


LINK_KINDS = ["google_scholar", "orcid", "edis_url", "lab_url", "website"]


def _mailed(nodes: DataFrame, page: str) -> DataFrame:
    """``(page, mailed)``: the addresses of a page's mailto links, in order."""
    mail = nodes.where((F.col("tag") == "a") & F.startswith(attr("href"), F.lit("mailto:")) & ((F.size("loud") > 0) | (F.size("lines") == 0)))
    address = F.lower(F.trim(F.replace(F.regexp_extract(attr("href"), r"^mailto:([^?]*)", 1), F.lit("%20"), F.lit(""))))
    return mail.where(like(address, f"^{em.EMAIL}$")).groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", address.alias("a")))), lambda x: x["a"]).alias("mailed"))


def _profile_links_by_kind(links: DataFrame, domain: str, page: str) -> DataFrame:
    """``(page, google_scholar, orcid, edis_url, lab_url, website, lab_name)``: the first link of each kind."""
    t, host = F.col("text"), F.col("host")
    own_path = F.regexp_replace("path", "/$", "") == F.regexp_replace(ur.url_part(F.col("base"), "path"), "/$", "")
    lab = like(t, r"(?i)\b(lab|laboratory|research group|group)\b") & ~like(host, "scholar|google|linkedin|twitter|facebook|researchgate") & ~own_path
    edis = (host == f"edis.ifas.{domain}") & (F.contains(F.lower(F.concat("url", t)), F.lit("author")) | like(F.concat("url", t), "(?i)topic_a|publications"))
    sort = (
        F.when(F.contains(host, F.lit("scholar.google.")), "google_scholar").when(F.contains(host, F.lit("orcid.org")), "orcid").when(edis, "edis_url")
        .when(lab, "lab_url").when(like(t, r"(?i)^(personal\s+)?(web ?site|home ?page)\b|\bpersonal (web)?site\b"), "website")
    )
    value = F.when(F.col("kind") == "google_scholar", ur.canon_scholar(F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.col("url")))).otherwise(F.col("url"))
    firsts = links.withColumn("kind", sort).where("kind is not null").groupBy(page, "kind").agg(F.min_by(F.struct(value.alias("v"), F.left("text", F.lit(80)).alias("t")), "node").alias("x"))
    by_kind = firsts.groupBy(page).pivot("kind", LINK_KINDS).agg(F.first("x"))
    return by_kind.select(page, *[F.coalesce(F.col(k)["v"], F.lit("")).alias(k) for k in LINK_KINDS], F.coalesce(F.col("lab_url")["t"], F.lit("")).alias("lab_name"))


def _profiles(
    nodes: DataFrame, pages: DataFrame, tokens: DataFrame | None, found_links: DataFrame, mailed: DataFrame, titles: DataFrame, domain: str, page: str, mode: str, hint: str | None
) -> DataFrame:
    tokens = written(page_tokens(nodes, page, mode), "profile-tokens") if tokens is None else tokens
    headed = tokens.where((F.col("kind") == "h") & F.col("level").between(1, 3)).where(tx.looks_like_name(F.col("text"))).groupBy(page).agg(F.min_by("text", "tok").alias("__h"))
    segment = F.get(F.split("__title", r"\s+[-|–—]\s+"), F.lit(0))
    given = F.col(hint) if hint else F.lit("")
    base = pages.select(page, "url", given.alias("__hint")).join(headed, page, "left").join(titles, page, "left")
    name = F.coalesce(F.nullif(tx.display_name(F.col("__h")), F.lit("")), F.when(tx.looks_like_name(segment), tx.display_name(segment)), F.nullif(tx.display_name(F.col("__hint")), F.lit("")))
    base = written(base.withColumn("name", name).where("name is not null").select(page, "url", "name"), "profile-names")

    lines = tokens.where(F.col("kind").isin("p", "li", "h")).join(base.select(page, "name"), page)
    spot = F.contains(tx.fold(F.col("text")), tx.fold(F.substring_index("name", " ", -1))) & (F.length("text") < 80)
    numbered = lines.withColumn("no", F.row_number().over(Window.partitionBy(page).orderBy("tok")) - 1)
    start = numbered.groupBy(page).agg(F.coalesce(F.min(F.when(spot, F.col("no"))), F.lit(0)).alias("start"))
    titled = (F.length("text") < 140) & like(F.col("text"), TITLE) & ~tx.looks_like_name(F.col("text")) & ~is_noise_text(F.col("text"))
    title = numbered.join(start, page).where("no >= start and no < start + 8").where(titled).groupBy(page).agg(F.min_by("text", "no").alias("title"))

    secs = section_lines(page_sections(tokens, page), page)
    kind = F.coalesce(*[F.when(like(F.col("title"), p), F.lit(k)) for k, p in HEADINGS.items()])
    grouped = secs.withColumn("kind", kind).where("kind is not null").select(page, "kind", F.col("sec").alias("o"), "lines", F.lit(0).alias("side"))
    labelled = inline_labels(tokens, page).select(page, F.col("label").alias("kind"), F.col("tok").alias("o"), F.array("value").alias("lines"), F.lit(1).alias("side"))
    joined = grouped.union(labelled).groupBy(page, "kind").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("side", "o", "lines"))), lambda x: x["lines"])).alias("lines"))
    wide = joined.groupBy(page).pivot("kind", list(HEADINGS)).agg(F.first("lines"))
    none = F.array().cast("array<string>")
    wide = wide.select(page, *[F.coalesce(k, none).alias(k) for k in HEADINGS])
    areas, summary = split_areas(F.col("research"))
    capped = lambda c, n, top: F.slice(tx.fold_distinct(F.filter(c, lambda l: F.length(l).between(3, n))), 1, top)
    students = F.slice(F.filter(F.transform("students", student_line), lambda s: s.isNotNull()), 1, 60)
    wide = written(wide, "profile-sections")
    fields = wide.select(page, areas.alias("research_areas"), summary.alias("research_summary"), capped("teaching", 200, 20).alias("teaching"), capped("extension", 240, 15).alias("extension"), students.alias("profile_students"))

    roots = nodes.join(content_roots(nodes, page, mode), page)
    text = roots.where("node = root").select(page, F.array_join("loud", " ").alias("loud_text"))
    side = roots.where((F.col("tag") == "aside") | like(attr("class"), "contact|sidebar")).where(~is_chrome(mode)).groupBy(page).agg(F.array_join(F.flatten(F.collect_list("loud")), " ").alias("side_text"))
    found = tx.ordered_distinct(F.concat(F.coalesce("mailed", none), em.find_emails(F.col("loud_text")), em.find_emails(F.col("side_text"))))
    own = F.filter("emails", lambda e: ~like(F.substring_index(e, "@", 1), em.GENERIC_LOCAL))
    picked = tx.present(em.pick_email(F.col("emails"), F.col("name"), domain))
    email = F.coalesce(picked, F.when(F.size(own) == 1, F.get(own, F.lit(0))), F.lit(""))
    mails = base.select(page, "name").join(text, page, "left").join(side, page, "left").join(mailed, page, "left").withColumn("emails", found).select(page, email.alias("email"))

    out = base
    for part in (written(title, "profile-titles"), written(fields, "profile-fields"), written(mails, "profile-mails"), found_links):
        out = out.join(part, page, "left")
    texts = ["title", "email", *LINK_KINDS, "lab_name", "research_summary"]
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})
    out = out.withColumns({c: F.coalesce(c, none) for c in ("research_areas", "teaching", "extension")})
    score = profile_score([*[F.col(c) != "" for c in ("email", "google_scholar", "title", "lab_url", "orcid")], *[F.size(c) > 0 for c in ("research_areas", "teaching", "extension")]])
    return out.select(page, F.col("url").alias("profile_url"), "name", *texts, "research_areas", "teaching", "extension", F.coalesce("profile_students", F.array().cast("array<struct<name:string,program:string>>")).alias("profile_students"), score.alias("score"))
