"""Clean-up of records: element filters, titles, staff, labels. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.text import dept_key, fold, fold_distinct, has_course_code, let, name_tokens, norm_unit, ordered_distinct, plain_key, squash, strip, strip_dept, unescape
from loomframe.session import written
from loomframe.operators.resolve import fix_shared_emails, merge_duplicates, repair_group

# What the clean-up takes for junk, a label, a code, a title or staff.
LABEL_JUNK = (
    r"(?iu)^(department|email|e-mail|phone|fax|office|orcid|profile|other|all faculty|affiliate faculty|primary faculty|"
    r"emeritus faculty|affiliations?|faculty|dr\.?|mr\.?|ms\.?|mrs\.?|prof\.?|ph\.?d\.?|m\.?s\.?|m\.?d\.?|b\.?s\.?|"
    r"read more|view profile|learn more|website|cv|curriculum vitae|publications?|google scholar|links?|research|"
    r"research interests?|areas? of (research|interest|expertise)|teaching|courses|contact( information)?|bio(graphy)?|"
    r"education|honors?( and awards)?|awards?|degrees?|more|details?|none|n/a|tbd)\s*:?$"
)
HR_CODE = r"^[A-Z]{2,6}(?:-[A-Z0-9&,.() ]{2,}){1,3}$"
TEACH_JUNK = (
    r"(?iu)course title|identifier|frequency|manage consent|search|submit|mailing address|office hours|phone|email|@|"
    r"privacy|cookie|skip to|copyright|all rights|login|menu|subscribe|follow us"
)
COLLEGE_LABELS = [
    "veterinary medicine", "journalism and communications", "nursing", "medicine", "dentistry", "pharmacy", "law", "business",
    "engineering", "arts", "education", "liberal arts and sciences", "agricultural and life sciences",
    "public health and health professions",
]
NOT_A_PERSON = [
    "schedule", "consultation", "canvas", "info", "information", "abroad", "assists", "center", "centre", "services", "support",
    "office", "help", "request", "apply", "contact", "resources", "registration", "scholarship", "scholarships", "calendar", "faq",
    "faqs", "policy", "policies", "guide", "handbook", "training", "workshop", "workshops", "tutorial", "events", "news",
    "directory", "portal", "system", "technology", "it", "admissions", "advising", "career", "careers", "internship", "internships",
    "giving", "donate", "alumni", "study", "login", "welcome", "consulting", "lab", "program", "programs", "department", "institute",
]
TITLE = (
    r"(?iu)\b(professor|lecturer|instructor|scientist|scholar|researcher|curator|librarian|clinician|"
    r"extension agent|agent|faculty|chair|director|dean|emerit\w+|affiliate|adjunct|fellow|physician|teaching)\b"
)
STAFF = (
    r"(?iu)\b(staff|administrative|secretary|assistant to|coordinator|technician|manager|analyst|programmer|"
    r"accountant|business|receptionist|specialist|student|postdoc\w*|post-doc\w*|intern|fiscal|"
    r"communications|webmaster|it support|advisor|clerical|stu ast|advisory board|board member|generalist|"
    r"human resources|hr|marketing|accounting|administrator|maintenance|warehouse|business manager|office manager|immigration)\b"
)
NOISE = (
    r"(?iu)^(send (an? )?e-?mail|e-?mail( me)?|see bio|view bio|view (full )?profile|read more|learn more|more|bio|biography|overview|"
    r"contact( info(rmation)?)?|website|cv|curriculum vitae|ssrn|publications?|research( profile)?|teaching( profile)?|"
    r"expand .*|.*submenu|menu|home|back|top|next|previous|\W+|[a-z]{1,3})$"
)
CREDENTIAL_WORDS = (
    "phd ph.d. md m.d. ms m.s. msn bsn rn dnp aprn cpnp-pc np fnp-bc agacnp-bc cns mba mph dvm dds jd pe faan fnap dnsc edd ma ba bs msc ds crnp "
    "cnm cnl facs fasla leed ap rd lds cpa dpt otr/l cscs"
).split()
STUDENT_JUNK = (
    r"(?iu)\b(forms?|syllabus|paper|registration|certificates?|handbook|polic(?:y|ies)|assistance|financial|committee|requirements?|"
    r"applications?|deadlines?|checklist|guidelines?|templates?|orientation|tuition|scholarships?|fellowships?|curriculum|courses?|"
    r"schedule|calendar|resources?|information|credit|unique|degrees?|thesis|dissertation|exams?|defense|advising|seminar|"
    r"travel|funding|opportunit\w+|study|professional|graduate|undergraduate|students?|faculty|staff|program|department)\b"
)
# Titles of those who teach, of staff, and bare ranks of the administration, for records that are otherwise empty.
FACULTY_WORD = (
    r"(?iu)professor|lecturer|instructor|faculty|scientist|researcher|fellow|emerit|chair|scholar|dean|investigator|clinician|"
    r"physician|librarian|curator|coach|artist|engineer|specialist in|agent"
)
STAFF_TITLE = (
    r"(?iu)\b(director of (finance|it|operations|development|engagement|communications|admissions|student)|it director|"
    r"coordinator|manager|administrator|analyst|secretary|accountant|buyer|payroll|human resources|"
    r"program assistant|office assistant|business manager|fiscal|budget|technician|webmaster|receptionist)\b"
)
BARE_STAFF = r"(?iu)^(director|assistant director|associate director|executive director|senior director)\b"
BUILDING = r"(?iu)\b(hall|building|bldg|center|centre|library|room)\b\s*\d*$"
SENTENCE = r"(?iu)\b(this|that|who|welcome|congratulations|joined|joins)\b"
_EDGE = r" \-–—•·|;,"
_AREA_PHRASES = (
    r"(?iu)faculty profile|search|submit|committee|adjunct faculty|affiliate and|^uf |^university of florida|"
    r"^school of |^college of |^department of |^center for |^institute for "
)
_DEGREE_LINE = r"(?iu)^(m\.?s\.?|ph\.?d\.?|b\.?s\.?|b\.?a\.?|m\.?a\.?|pharm\.?d\.?|d\.?v\.?m\.?|j\.?d\.?|m\.?b\.?a\.?)\s*[:.,]?(\s|$)"
_RANK = r"\b(assistant|associate|emeritus|distinguished|clinical|research|courtesy|adjunct|affiliate)?\s*professors?\b( of| emerit\w+)?"
_FURNITURE = r"^(home ?page|no photo available|courses taught|mentor|mentors|personal website|lab website|lab page)$"


def like(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(pattern))


def is_noise_text(col: Column) -> Column:
    def noise(t: Column) -> Column:
        words = F.filter(F.transform(F.split(t, r"[\s,;/]+"), lambda w: F.lower(strip(w, ".,;()"))), lambda w: w != "")
        credentials = let(words, lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: w.isin(CREDENTIAL_WORDS)))
        return (t == "") | like(t, NOISE) | credentials

    return let(squash(col), noise)


def plausible_faculty(title: Column, lines: Column) -> Column:
    """Keep without any text, or with a title word, or without a staff word; the text is the title or the first two lines."""
    text = F.coalesce(F.nullif(title, F.lit("")), F.array_join(F.slice(lines, 1, 2), " "), F.lit(""))
    return let(text, lambda t: (t == "") | like(t, TITLE) | ~like(t, STAFF))


def student_name_ok(col: Column) -> Column:
    bad = [STUDENT_JUNK, BUILDING, r"(?iu)^(dr|prof|professor)\b\.?", SENTENCE]
    return let(squash(col), lambda n: reduce(lambda ok, p: ok & ~like(n, p), bad, n != ""))


def _plain(texts: Column) -> Column:
    """Each text without references and runs of white space. Lists that need it go through it together, as a plan holds the table of names each time."""
    return F.transform(texts, lambda t: squash(unescape(t)))


def _trimmed(plain: Column) -> Column:
    return F.transform(plain, lambda t: strip(t, _EDGE))


def named_as_units(records: DataFrame, areas: Column, names: DataFrame) -> DataFrame:
    """Adds ``unit_names``: those of a record's areas (unescaped), folded, that are among ``names(n)``. A join, so neither has a bound.

    records: with a unique ``ord``.
    """
    keys = F.array_distinct(F.transform(_trimmed(areas), fold))
    found = records.select("ord", F.explode(keys).alias("n")).join(names.where("n <> ''").distinct(), "n").groupBy("ord").agg(F.collect_list("n").alias("unit_names"))
    none = F.array().cast("array<string>")
    return records.join(found, "ord", "left").withColumn("unit_names", F.coalesce("unit_names", none))


def clean_areas(areas: Column, name: Column, own_labels: Column, unit_names: Column) -> Column:
    """Research areas without contact data, labels, degrees, codes, ranks, own name and unit names; first spelling of each.

    own_labels: the record's departments and colleges; unit_names: those of all units, or as many of them as the areas
    name (see ``named_as_units``), both folded.
    """
    return _good_areas(_plain(areas), name, own_labels, unit_names)


def _good_areas(areas: Column, name: Column, own_labels: Column, unit_names: Column) -> Column:
    own = F.array_union(F.filter(name_tokens(name), lambda t: F.length(t) > 1), F.lit(["dr", "prof"]))

    def good(a: Column) -> Column:
        return let(fold(a), lambda f: judged(a, f))

    def judged(a: Column, f: Column) -> Column:
        words = F.regexp_extract_all(f, F.lit("[a-z]+"), F.lit(0))
        shouting = (F.upper(a) == a) & (F.lower(a) != a) & (F.length(a) > 3) & F.contains(a, F.lit(" "))
        own_unit = F.exists(own_labels, lambda d: (d != "") & ((f == d) | (f == F.concat(F.lit("department of "), d))))
        own_name = (F.size(words) > 0) & (F.size(F.array_except(words, own)) == 0)
        return ~(
            (F.length(a) < 3) | (F.length(a) > 140) | like(a, LABEL_JUNK) | F.endswith(a, F.lit(":")) | like(a, HR_CODE)
            | like(a, r"(?iu)@|https?://|\bphone\b|\bemail\b|\d{3}[-.\s]\d{3,4}") | own_unit | own_name
            | like(f, r"^(ph\.?d\.?|m\.?s\.?|m\.?d\.?|b\.?s\.?)[:\s]*(student)?$") | shouting | like(a, "^[A-Z]{4,}$") | like(a, _AREA_PHRASES)
            | F.array_contains(unit_names, f) | like(a, _DEGREE_LINE) | (like(f, _RANK) & (F.size(F.split(f, r"\s+")) <= 5)) | like(f, _FURNITURE)
        )

    return fold_distinct(F.filter(_trimmed(areas), good))


def clean_teaching(teaching: Column, extra: Column) -> Column:
    return _good_teaching(_plain(F.concat(teaching, extra)))


def _good_teaching(teaching: Column) -> Column:
    def good(t: Column) -> Column:
        loose = (F.size(F.split(t, r"\s+")) > 14) | F.endswith(t, F.lit(":")) | like(t, LABEL_JUNK)
        return F.length(t).between(4, 160) & ~like(t, TEACH_JUNK) & (has_course_code(t) | ~loose)

    return fold_distinct(F.filter(_trimmed(teaching), good))


def clean_extension(extension: Column) -> Column:
    return _good_extension(_plain(extension))


def _good_extension(extension: Column) -> Column:
    return F.filter(extension, lambda e: (e != "") & ~like(e, TEACH_JUNK) & (F.length(e) < 200))


def clean_title(title: Column) -> Column:
    return _good_title(squash(unescape(title)))


def _good_title(title: Column) -> Column:
    edge = r" ,;:|\-–—"
    t = strip(F.regexp_replace(title, r"(?iu)^(affiliations?)\s+", ""), edge)
    t = strip(F.regexp_replace(t, r"(?iu)\s+\S+(?:\s\S+)?['’]s\s+[\w&]+\s+(?:profile|page|website)(?:\s+page)?\s*$", ""), edge)
    bad = r"(?isu)^.{141}|collection of websites|^:|graduate faculty status|dean'?s office$"
    return let(t, lambda x: F.when(like(x, bad), "").otherwise(x))


def clean_summary(summary: Column) -> Column:
    return _good_summary(squash(unescape(summary)))


def _good_summary(summary: Column) -> Column:
    return F.regexp_replace(summary, r"(?isu)^Research Departmental Program Areas:.*?Research focus:\s*", "")


def is_not_a_person(name: Column, n_affiliations: Column, title: Column, email: Column) -> Column:
    words = F.regexp_extract_all(fold(name), F.lit("[a-z]+"), F.lit(0))
    return F.arrays_overlap(words, F.lit(NOT_A_PERSON)) | ((n_affiliations >= 8) & (title == "") & (email == ""))


def is_staff(title: Column) -> Column:
    """A title that speaks of staff or is a bare rank of the administration, without a word of those who teach."""
    return (title != "") & ~like(title, FACULTY_WORD) & (like(title, STAFF_TITLE) | like(title, BARE_STAFF))


def canonical_affiliations(affiliations: Column) -> Column:
    """Each (college, department key) once; a missing college is that of the same department elsewhere in the list."""
    once = lambda rows: ordered_distinct(rows, F.transform(rows, lambda a: F.concat_ws("|", a["college"], a["key"])))

    def adopted(keyed: Column) -> Column:
        def adopt(a: Column) -> Column:
            named = F.filter(keyed, lambda b: (b["college"] != "") & (b["department"] != "") & (b["key"] == a["key"]))
            college = F.when(a["college"] != "", a["college"]).otherwise(F.coalesce(F.get(named, F.size(named) - 1)["college"], F.lit("")))
            return F.struct(college.alias("college"), a["department"].alias("department"), a["shared"].alias("shared"), a["key"].alias("key"))

        return let(F.transform(once(keyed), adopt), once)

    # A key is worked out once an element, and mentioned once, as a plan holds its tables wherever it is.
    keyed = F.transform(affiliations, lambda a: F.struct(a["college"].alias("college"), a["department"].alias("department"), a["shared"].alias("shared"), dept_key(a["department"]).alias("key")))
    return F.transform(let(keyed, adopted), lambda a: F.struct(a["college"].alias("college"), a["department"].alias("department"), a["shared"].alias("shared")))


def canonicalize(records: DataFrame, units: DataFrame) -> DataFrame:
    """Department names in their first spelling (units first, then records in order), on records and affiliations.

    Different spellings are written with what they are known by, so that no plan works it out more than once.
    """
    exploded = records.select("ord", F.posexplode(F.concat(F.array("department"), F.transform("affiliations", lambda a: a["department"]))).alias("pos", "label"))
    labels = units.select(F.struct(F.lit(0).alias("side"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("pos")).alias("at"), F.col("name").alias("label"))
    labels = labels.union(exploded.select(F.struct(F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord"), "pos"), "label")).where("label <> ''")
    spelled = labels.groupBy("label").agg(F.min("at").alias("at")).select("label", "at", strip_dept(F.col("label")).alias("plain"))
    spelled = written(spelled, "spellings")
    spelled = written(spelled.withColumn("key", plain_key(F.col("plain"))), "spelling-keys")
    first = spelled.groupBy("key").agg(F.min_by("plain", "at").alias("spelled"))
    names = spelled.join(first, "key").select("label", "spelled")
    back = exploded.join(names, "label", "left").groupBy("ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("spelled", F.lit("")).alias("l")))), lambda x: x["l"]).alias("__names")
    )
    joined = records.join(back, "ord")
    renamed = F.transform(
        "affiliations",
        lambda a, i: F.struct(a["college"].alias("college"), F.get(F.col("__names"), i + 1).alias("department"), a["shared"].alias("shared")),
    )
    out = joined.withColumns({"department": F.get("__names", F.lit(0)), "affiliations": renamed}).drop("__names")
    return written(out, "spelled").withColumn("affiliations", canonical_affiliations(F.col("affiliations")))


def _plain_texts(records: DataFrame) -> DataFrame:
    """Names, titles and summaries of records and their affiliations, unescaped all together."""
    single = ["department", "college", "location", "lab_name", "title", "research_summary"]
    n, known = len(single), F.coalesce(F.size("affiliations"), F.lit(0))
    listed = lambda part: F.coalesce(F.col("affiliations")[part], F.array().cast("array<string>"))
    out = records.withColumn("__plain", _plain(F.concat(F.array(*single), listed("college"), listed("department"))))
    at = lambda i: F.get("__plain", i)
    affs = F.transform("affiliations", lambda a, i: F.struct(at(i + n).alias("college"), at(i + n + known).alias("department")))
    out = out.withColumns({"affiliations": affs, **{c: at(F.lit(i)) for i, c in enumerate(single)}}).drop("__plain")
    return out.withColumns({"title": _good_title(F.col("title")), "research_summary": _good_summary(F.col("research_summary"))})


def finalize(records: DataFrame, units: DataFrame, label_college: DataFrame) -> DataFrame:
    """The clean-up chain, in its order: names of departments, duplicates, texts, colleges, labels, lists, people, e-mails.

    units: (ord, name, college); label_college: (label, group).
    """
    merged = written(merge_duplicates(written(canonicalize(records, units), "canonical")), "one-a-person")
    merged = written(_plain_texts(merged), "plain-texts")
    first = units.groupBy(fold(F.col("name")).alias("label")).agg(F.min_by("college", "ord").alias("group"))
    asked = F.when(F.col("college") == "", F.col("department")).otherwise("")
    repaired = repair_group(merged, asked, first, label_college, units.select(F.col("college").alias("group")))
    fixed = F.when((F.col("college") == "") & (F.col("department") != ""), F.col("group")).otherwise(F.col("college"))
    repaired = written(repaired.withColumn("__fixed", fixed), "repaired-groups")
    own = F.array(F.struct(F.col("__fixed").alias("college"), F.col("department").alias("department")))
    adopt = F.transform("affiliations", lambda a: F.struct(F.coalesce(F.nullif(a["college"], F.lit("")), F.col("__fixed")).alias("college"), a["department"].alias("department")))
    changed = (F.col("college") == "") & (F.col("__fixed") != "")
    affs = F.when(changed & (F.size("affiliations") == 0), own).when(changed, adopt).otherwise(F.col("affiliations"))
    repaired = repaired.withColumns({"affiliations": affs, "college": F.col("__fixed")}).drop("group", "__fixed")
    repaired = repaired.withColumn("affiliations", F.filter("affiliations", lambda a: (a["college"] != "") | (a["department"] != "")))
    judged = F.transform(F.concat(F.array("department"), F.transform("affiliations", lambda a: a["department"])), lambda d: F.array_contains(F.lit(COLLEGE_LABELS), fold(d)))
    repaired = written(repaired.withColumn("__whole", judged), "repaired-labels")
    department = F.when((F.length("department") <= 2) | F.get("__whole", F.lit(0)), "").otherwise(F.col("department"))
    blanked = F.transform("affiliations", lambda a, i: F.struct(a["college"].alias("college"), F.when(F.get("__whole", i + 1), "").otherwise(a["department"]).alias("department")))
    repaired = repaired.withColumns({"department": department, "affiliations": F.array_distinct(blanked)}).drop("__whole")
    folded = units.select(F.transform(F.array("name", "college"), fold).alias("f")).select(F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).alias("college"))
    names = folded.select(F.explode(F.array("name", F.regexp_replace("name", r"\s+department$", ""), "college")).alias("n"))
    names = written(names.union(units.select(norm_unit(F.col("name")))), "unit-names")
    courses = F.transform(F.filter("research_areas", has_course_code), lambda a: F.regexp_replace(a, r"(?iu)^teaching[:\s]+", ""))
    areas = F.filter("research_areas", lambda a: ~has_course_code(a))
    lists = F.transform(F.array(areas, F.concat("teaching", courses), "extension", "roles"), _plain)
    own = F.transform(F.concat(F.array("department", "college"), F.transform("affiliations", lambda a: a["department"]), F.transform("affiliations", lambda a: a["college"])), fold)
    listed = written(repaired.withColumns({"__lists": lists, "__own": own}), "plain-lists")
    at = lambda i: F.get("__lists", F.lit(i))
    known = written(named_as_units(listed, at(0), names), "areas-of-units")
    cleaned = known.withColumns({
        "research_areas": _good_areas(at(0), F.col("name"), F.col("__own"), F.col("unit_names")), "teaching": _good_teaching(at(1)),
        "extension": _good_extension(at(2)), "roles": F.filter(at(3), lambda r: r != ""),
    }).drop("unit_names", "__lists", "__own")
    cleaned = written(cleaned, "clean-lists")
    person = ~is_not_a_person(F.col("name"), F.size("affiliations"), F.col("title"), F.col("email"))
    idle_staff = is_staff(F.col("title")) & (F.size("research_areas") == 0) & (F.col("google_scholar") == "")
    return fix_shared_emails(written(cleaned.where(person & ~idle_staff), "cleaned"))
