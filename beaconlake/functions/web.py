"""URLs, paths and user agents as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def _first(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*pairs[0])
    for p in pairs[1:]:
        out = out.when(*p)
    return out.otherwise(otherwise)


def let(x: Column, f) -> Column:
    """f(x), where x is computed once however often f uses it, wherever the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(x), f), 1)


def normalise_url(url: Column) -> Column:
    """Path and query of a URL: no scheme, host, fragment, nor a slash at the end of a path without query."""
    u = F.trim(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(u, r"^.*?://[^/]*", "")
    u = F.when(u.contains("://"), F.when(rest == "", "/").otherwise(rest)).otherwise(u)
    u = F.substring_index(u, "#", 1)
    u = F.when(u.startswith("/"), u).otherwise(F.concat(F.lit("/"), u))
    return F.when((F.length(u) > 1) & u.endswith("/") & ~u.contains("?"), F.regexp_replace(u, "/$", "")).otherwise(u)


def strip_query(url: Column) -> Column:
    path = F.substring_index(normalise_url(url), "?", 1)
    return F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)


def section_of(url: Column) -> Column:
    """First folder of the path; a file at the top belongs to the root."""
    parts = F.filter(F.split(F.substring_index(url, "?", 1), "/"), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    return F.when((F.size(parts) == 0) | ((F.size(parts) == 1) & first.contains(".")), "/ (root)").otherwise(F.concat(F.lit("/"), first, F.lit("/")))


def host_of(url: Column) -> Column:
    """Lower-case host without www., empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def host_path(url: Column) -> Column:
    """Host (www. stays) and path without a slash at its end: what two URLs of a page share."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    return F.concat(host, F.when(path == "", "/").otherwise(path))


def transactional(url: Column) -> Column:
    """Whether the URL is of a page to buy or to log in, which no answer cites."""
    low = F.lower(url)
    parts = F.split(F.regexp_extract(low, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1), "/")
    words = F.array(*map(F.lit, dims.TRANSACTIONAL))
    named = F.exists(parts, lambda p: F.exists(words, lambda w: (p == w) | (p.startswith(w) & F.substr(p, F.length(w) + 1, F.lit(1)).rlike("[^a-z0-9_]"))))
    return low.contains(dims.ADD_TO_CART) | named


def path_key(path: Column) -> Column:
    """Comparison key: lower case, no slashes at the end, the root stays."""
    p = F.regexp_replace(F.lower(path), r"(?<=.)/+$", "")
    return F.when(p == "", "/").otherwise(p)


def decoded_path(url: Column) -> Column:
    """Path of a URL or of a path, percent-decoded (a plus sign stays), slashes collapsed."""
    u = F.trim(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_extract(bare, r"^([^?#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)
    return F.regexp_replace(plain, "/{2,}", "/")


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path_key(path), "/"), lambda s: s != "")


def last_slug(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit("")), r"\.(?:html?|php|aspx?)$", "")


def starts_like(path: str, prefixes: list[str]) -> str:
    """SQL: whether the path (an expression) is one of the prefixes, or goes on after one with a slash or a dot."""
    return "(" + " or ".join(f"{path} = '{p}' or startswith({path}, '{p.rstrip('/')}/') or startswith({path}, '{p}.')" for p in prefixes) + ")"


def forged(url: str = "url", method: str = "method") -> Column:
    """Whether the request itself proves that its agent is no crawler: it writes, or asks for what only scanners want. Names of columns.

    Long chains like this one are built as text: one call instead of one for each of their parts."""
    path = f"concat('/', ltrim('/', lower(substring_index(coalesce({url}, ''), '?', 1))))"
    methods = ", ".join(f"'{m}'" for m in dims.WRITE_METHODS)
    return F.expr(f"upper(trim(coalesce({method}, ''))) in ({methods}) or exists(array({path}), p -> {starts_like('p', dims.FORGERY_PATHS)})")


#: Endings of files that programs serve, and of those that pages show; what scanners look for, and what media libraries hold.
_SERVED = "php php1 php2 php3 php4 php5 php6 php7 php8 php9 php0 asp aspx jsp cgi sql bak old zip tar gz ini log yml yaml".split()
_SHOWN = "jpg jpeg png gif webp avif svg ico css js woff woff2 ttf eot mp4 webm pdf".split()


def ending(path: Column) -> Column:
    """What follows the last dot of the path's last part, lower case; empty if there is no dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def classify_missing(path: str) -> Column:
    """Kind of a path (name of a column) that answered 404."""
    s = segments(F.col(path))
    return _first(
        [
            (F.expr(f"exists(array(lower({path})), p -> {starts_like('p', dims.PROBES)})"), F.lit("probe")),
            (ending(F.col(path)).isin(_SERVED) & ~F.lower(path).startswith("/wp-content/uploads/"), F.lit("suspicious")),
            ((F.size(s) >= 2) & (F.get(s, F.lit(0)) == F.get(s, F.lit(1))), F.lit("doubled_segment")),
            (is_asset(F.col(path)), F.lit("asset")),
        ],
        F.lit("page"),
    )


def is_asset(path: Column) -> Column:
    return ending(path).isin(_SHOWN)


def bot_number(agent: str = "agent") -> Column:
    """Place in dims.BOTS of the crawler whose pattern, the longest of those found, is in the agent (name of a column); null if there is none."""
    ordered = sorted(range(len(dims.BOTS)), key=lambda i: -len(dims.BOTS[i][0]))
    arms = " ".join(f"when contains(a, '{dims.BOTS[i][0]}') then {i}" for i in ordered)
    return F.expr(f"transform(array(lower({agent})), a -> case {arms} end)[0]")


def bot_field(number: str, field: int) -> Column:
    return F.expr("get(array(" + ", ".join("'" + b[field].replace("'", "''") + "'" for b in dims.BOTS) + f"), {number})")


def looks_human(agent: str = "agent") -> Column:
    hints = " or ".join(f"contains(a, '{h}')" for h in dims.GENERIC_BOT_HINTS)
    return F.expr(f"exists(array(lower(coalesce({agent}, ''))), a -> contains(a, 'mozilla') and not ({hints}))")


def source_type(domain: Column, own: str = "", competitors: list[str] | None = None) -> Column:
    """own > competitor > kinds of dims.SOURCE_TYPES > editorial."""
    def under(d: str) -> Column:
        return (domain == d) | domain.endswith("." + d)

    pairs = [(under(own), F.lit("own"))] if own else []
    pairs += [(under(c), F.lit("competitor")) for c in competitors or []]
    parts = F.split(domain, r"\.")
    site, first = F.get(parts, F.greatest(F.size(parts) - 2, F.lit(0))), F.get(parts, F.lit(0))
    # forum.example.org, forums.example.org, forum-x.org; gov.uk and the like have the kind in the last part but one.
    talks = first.isin("forum", "forums") | (site.startswith("forum") & (F.size(parts) >= 2))
    for kind, (whole, names) in dims.SOURCES.items():
        hit = reduce(lambda a, b: a | b, [under(d) for d in whole])
        hit = hit | (site.isin(names) if names else F.lit(False)) | (talks if kind == "ugc" else F.lit(False))
        pairs.append((hit, F.lit(kind)))
    return _first(pairs, F.lit("editorial"))


def robots_regex(pattern: Column) -> Column:
    """A robots.txt pattern as a Java expression: * is any run, $ at the end is the end."""
    escaped = F.regexp_replace(pattern, r"([\\.+?^${}()|\[\]\-])", r"\\$1")
    starred = F.regexp_replace(escaped, r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(starred, r"\\\$$", r"\$"))
