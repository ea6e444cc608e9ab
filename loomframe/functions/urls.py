"""URL functions, column to column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.text import let

# Query keys that only track, and paths and endings that are not people pages.
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|mc_.*|ref|replytocom|share|print|amp|_ga|sessionid|phpsessid)$"
SKIP_ENDINGS = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|jpe?g|png|gif|svg|mp4|mp3|css|js|ico)$"
SKIP_PATHS = (
    r"(?i)/(news|events?|tag|tags|category|categories|author|calendar|search|login|wp-content|feed|"
    r"alumni|students?|graduate-students|undergraduate|apply|give|donate|publications?)(/|$)"
)
_SHAPE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(col: Column, part: str) -> Column:
    """scheme, host (lower-cased), port, path or query of an absolute URL; '' where there is none."""
    group = {"scheme": 1, "host": 2, "port": 3, "path": 4, "query": 5}[part]
    found = F.regexp_extract(F.coalesce(F.trim(col), F.lit("")), _SHAPE, group)
    return F.lower(found) if part in ("scheme", "host") else found


def join_url(base: Column, href: Column) -> Column:
    """``href`` made absolute against ``base``; dot segments of its path are resolved, at the root they go nowhere."""
    return let(F.trim(href), lambda h: _joined(base, h))


def _resolved(segments: Column) -> Column:
    """A path of these segments without '.' and '..'."""
    step = lambda path, s: F.when(s == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).when(s == ".", path).otherwise(F.concat(path, F.array(s)))
    walked = F.aggregate(segments, F.array().cast("array<string>"), step)
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.concat(F.lit("/"), F.regexp_replace(F.array_join(ended, "/"), "^/+", ""))


def _joined(base: Column, h: Column) -> Column:
    root = F.concat(url_part(base, "scheme"), F.lit("://"), F.regexp_extract(F.trim(base), r"^[^:]+://([^/?#]*)", 1))
    folder = F.coalesce(F.nullif(F.regexp_extract(url_part(base, "path"), r"^(.*/)", 1), F.lit("")), F.lit("/"))
    own_path = F.regexp_extract(F.trim(base), r"^([^?#]*)", 1)
    own = F.regexp_extract(h, r"^([^?#]*)", 1)
    tail = F.substring(h, F.length(own) + 1, F.lit(1 << 20))

    def below(segments: Column) -> Column:
        last = F.size(segments) - 1
        return F.filter(segments, lambda s, i: (i == 0) | (i == last) | (s != ""))

    absolute = F.concat(root, _resolved(F.split(own, "/")), tail)
    relative = F.concat(root, let(below(F.split(F.concat(folder, own), "/")), _resolved), tail)
    return (
        F.when(F.regexp_like(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), h)
        .when(h == "", F.trim(base))
        .when(F.startswith(h, F.lit("//")), F.concat(url_part(base, "scheme"), F.lit(":"), h))
        .when(F.startswith(h, F.lit("?")) | F.startswith(h, F.lit("#")), F.concat(own_path, h))
        .when(F.startswith(h, F.lit("/")), absolute)
        .otherwise(relative)
    )


def canon_url(url: Column, base: Column | None = None) -> Column:
    """Absolute https URL without fragment, default port or tracking keys; keys sorted, first value of each, decoded.

    Schemes other than http and https, and URLs without a host, give ''.
    """
    raw = F.coalesce(F.trim(url), F.lit(""))
    local = F.regexp_like(raw, F.lit("^(mailto:|tel:|javascript:|#|data:|sms:)"))
    full = join_url(base, raw) if base is not None else raw
    return F.coalesce(F.when(~local, let(full, _canon)), F.lit(""))


def _query_pairs(query: Column) -> Column:
    """The wanted keys with their first values, sorted, as key=value texts."""
    pairs = F.filter(F.split(query, "&"), lambda p: F.regexp_like(p, F.lit("^[^=]+=.+")))
    keyed = F.transform(
        pairs,
        lambda p: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v")
        ),
    )
    wanted = F.filter(keyed, lambda p: p["k"].isNotNull() & ~F.regexp_like(p["k"], F.lit(TRACKING)))

    def first_values(found: Column) -> Column:
        first = let(F.transform(found, lambda p: p["k"]), lambda ks: F.filter(found, lambda p, i: F.array_position(ks, p["k"]) == i + 1))
        return F.transform(F.array_sort(first), lambda p: F.concat(p["k"], F.lit("="), p["v"]))

    return let(wanted, first_values)


def _canon(full: Column) -> Column:
    host, port, path = url_part(full, "host"), url_part(full, "port"), url_part(full, "path")
    built = F.concat(
        F.lit("https://"), host, F.when((port == "") | port.isin("80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path), F.regexp_replace(F.concat(F.lit("?"), F.array_join(_query_pairs(url_part(full, "query")), "&")), r"^\?$", ""),
    )
    return F.when(url_part(full, "scheme").isin("http", "https") & (host != ""), built).otherwise("")


def in_domain(host: Column, domain: str) -> Column:
    """The host is the domain or ends in it after a dot."""
    h = F.lower(F.coalesce(host, F.lit("")))
    return (h == domain) | F.endswith(h, F.lit("." + domain))


def is_page_path(path: Column) -> Column:
    return ~F.regexp_like(path, F.lit(SKIP_ENDINGS)) & ~F.regexp_like(path, F.lit(SKIP_PATHS))


def canon_scholar(href: Column) -> Column:
    user = F.regexp_extract(url_part(href, "query"), r"(?:^|&)user=([^&]+)", 1)
    query = url_part(href, "query")
    other = F.concat(F.lit("https://"), url_part(href, "host"), url_part(href, "path"), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(user != "", F.concat(F.lit("https://scholar.google.com/citations?user="), user)).otherwise(other)
