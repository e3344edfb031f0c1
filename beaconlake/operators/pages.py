"""Page snapshots: what the head of a page says, and how two snapshots of a site differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web as W

FIELDS = ["title", "description", "robots", "canonical", "h1", "schema_types", "hreflang"]


def _tag(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", " "), r"\s+", " "))


def _attribute(html: Column, tag: str, key: str, value: str, wanted: str) -> Column:
    """The attribute ``wanted`` of the first such tag whose attribute ``key`` is ``value``, in any order and quotes."""
    hit = F.regexp_extract(html, rf"""(?is)<{tag}\b(?=[^>]*\s{key}\s*=\s*["']?{value}["'\s>])[^>]*>""", 0)
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(hit, rf'(?is)\s{wanted}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(hit, rf"(?is)\s{wanted}\s*=\s*'([^']*)'", 1)))


def snapshot(pages: DataFrame) -> DataFrame:
    """The pages (url, html; null html is empty) with FIELDS and noindex instead of html."""
    h = F.coalesce("html", F.lit(""))
    return pages.select(
        *(c for c in pages.columns if c != "html"),
        _tag(h, "title").alias("title"),
        _attribute(h, "meta", "name", "description", "content").alias("description"),
        F.lower(_attribute(h, "meta", "name", "robots", "content")).alias("robots"),
        _attribute(h, "link", "rel", "canonical", "href").alias("canonical"),
        _tag(h, "h1").alias("h1"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(h, F.lit(r'"@type"\s*:\s*"([^"]+)"'), 1))).alias("schema_types"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(h, F.lit(r"""(?i)\shreflang\s*=\s*["']([^"']+)"""), 1))).alias("hreflang"),
    ).withColumn("noindex", F.col("robots").rlike(r"\b(?:noindex|none)\b"))


#: Issues between two snapshots by severity; those that depend are decided in ``diff``.
SEVERITY = {
    "not_in_after": "medium", "status_changed": "high", "became_noindex": "high", "became_index": "medium", "canonical_lost": "high", "description_lost": "high", "description_changed": "low",
    "title_lost": "medium", "title_changed": "low", "h1_changed": "low", "schema_lost": "medium", "open_graph_lost": "low", "hreflang_lost": "high", "two_plugins": "high",
}


def diff(before: DataFrame, after: DataFrame, key: str = "url") -> DataFrame:
    """key, url, issue, severity for each way in which a page of ``before`` differs in ``after``; snapshots with one row a ``key`` (two pages may have one URL). status, og_title and plugins are compared where both have them."""
    extra = [c for c in ("status", "og_title", "plugins") if c in before.columns and c in after.columns]
    a = after.select(key, F.lit(True).alias("there"), *(F.col(c).alias(f"{c}_2") for c in [*FIELDS, "noindex", *extra]))
    changed = lambda c: (F.col(c) != "") & (F.col(f"{c}_2") != "") & (F.col(c) != F.col(f"{c}_2"))
    lost = lambda c: (F.col(c) != "") & (F.col(f"{c}_2") == "")
    moved = W.host_path(F.col("canonical")) != W.host_path(F.col("canonical_2"))
    far = F.when(W.host_of(F.col("canonical")) != W.host_of(F.col("canonical_2")), "high").otherwise("medium")
    checks = {
        "became_noindex": F.col("noindex_2") & ~F.col("noindex"),
        "became_index": F.col("noindex") & ~F.col("noindex_2"),
        "canonical_lost": lost("canonical"),
        "canonical_changed": changed("canonical") & moved,
        "description_lost": lost("description"), "description_changed": ~lost("description") & (F.col("description") != F.col("description_2")),
        "title_lost": lost("title"), "title_changed": ~lost("title") & (F.col("title") != F.col("title_2")), "h1_changed": changed("h1"),
        "schema_lost": F.size(F.array_except("schema_types", "schema_types_2")) > 0,
        "hreflang_lost": (F.size("hreflang") > 0) & (F.size("hreflang_2") == 0),
    }
    if "og_title" in extra:
        checks["open_graph_lost"] = lost("og_title")
    if "plugins" in extra:
        checks["two_plugins"] = (F.size("plugins_2") > 1) & (F.size("plugins") <= 1)
    one = lambda name, severity=None: F.struct(F.lit(name).alias("issue"), (F.lit(SEVERITY[name]) if severity is None else severity).alias("severity"))
    found = F.array_compact(F.array(*(F.when(c, one(n, far if n == "canonical_changed" else None)) for n, c in checks.items())))
    broken = (F.col("status") == 200) & (F.coalesce("status_2", F.lit(0)) != 200) if "status" in extra else F.lit(False)
    rows = before.join(a, key, "left")
    issues = F.when(F.col("there").isNull(), F.array(one("not_in_after"))).when(broken, F.array(one("status_changed"))).otherwise(found)
    named = list(dict.fromkeys([key, "url"]))
    return rows.select(*named, F.explode(issues).alias("i")).select(*named, "i.issue", "i.severity")


def summary(before: DataFrame, after: DataFrame, issues: DataFrame, key: str = "url") -> DataFrame:
    """One row: pages, identical (in both, without an issue), and issues by severity. key: the one that the issues were found by."""
    same = before.select(key).join(after.select(key), key, "left_semi").join(issues.select(key), key, "left_anti")
    counts = issues.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")))
    return counts.withColumns({"pages": before.agg(F.count("*")).scalar(), "identical": same.agg(F.count("*")).scalar()})


#: What the head of a page says of the plugin that wrote it; what a REST index calls them; the premium ones.
FINGERPRINTS = [
    ("yoast", r"(?i)optimized with the yoast seo(?: premium)? plugin v?([\d.]+)"), ("yoast", r"(?i)class=[\"']yoast-schema-graph"), ("rankmath", r"(?i)search engine optimization by rank math(?: pro)?"), ("rankmath", r"(?i)class=[\"']rank-math-schema"),
    ("aioseo", r"(?i)all in one seo(?: pro)? ([\d.]+) - aioseo\.com"), ("aioseo", r"(?i)content=[\"']all in one seo \(aioseo\) ([\d.]+)"), ("aioseo", r"(?i)class=[\"']aioseo-schema"), ("seoframework", r"(?i)the seo framework by sybre waaijer"),
]
PREMIUM = {"yoast": r"(?i)yoast seo premium plugin", "rankmath": r"(?i)rank math pro", "aioseo": r"(?i)all in one seo pro"}
NAMESPACES = {"yoast/v1": "yoast", "rankmath/v1": "rankmath", "aioseo/v1": "aioseo", "seopress/v1": "seopress"}


def plugins(pages: DataFrame, namespaces: str | None = None) -> DataFrame:
    """The pages (url, html) with plugins, version (of the first that says it), premium; namespaces: an array column of a REST index."""
    h = F.coalesce("html", F.lit(""))
    found = F.array_compact(F.array(*(F.when(h.rlike(x), F.lit(p)) for p, x in FINGERPRINTS)))
    if namespaces:
        known = F.create_map(*(F.lit(x) for kv in NAMESPACES.items() for x in kv))
        found = F.concat(found, F.filter(F.transform(F.coalesce(namespaces, F.array().cast("array<string>")), lambda n: F.try_element_at(known, n)), lambda p: p.isNotNull()))
    version = F.coalesce(*(F.nullif(F.regexp_extract(h, x, 1), F.lit("")) for _, x in FINGERPRINTS if "(" in x.replace("(?", "").replace("\\(", "")))
    premium = reduce(lambda a, b: a | b, [h.rlike(x) for x in PREMIUM.values()])
    return pages.withColumns({"plugins": F.array_sort(F.array_distinct(found)), "version": version, "premium": premium})


def with_headers(snapshot_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The snapshot with what the X-Robots-Tag header adds to noindex. headers: url, status, x_robots."""
    rows = snapshot_rows.join(headers, "url", "left")
    return rows.withColumn("noindex", F.col("noindex") | F.coalesce(F.lower("x_robots").contains("noindex"), F.lit(False))).drop("x_robots")


def _found(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """The changes with their page p: by URL, else by its last part, as pages that were saved as files are named."""
    cols = [c for c in pages.columns if c != "url"]
    p = pages.select(W.host_path(F.col("url")).alias("k"), F.struct("url", *cols).alias("p"))
    by_file = pages.where("url rlike '[.]html$' and not contains(url, '://')").select(F.regexp_replace(F.element_at(F.split("url", "/"), -1), "[.]html$", "").alias("stem"), F.struct("url", *cols).alias("q"))
    last = F.element_at(F.split(F.regexp_replace(W.decoded_path(F.col("url")), "/+$", ""), "/"), -1)
    rows = changes.withColumns({"k": W.host_path(F.col("url")), "stem": F.when(last == "", "index").otherwise(last)})
    return rows.join(p, "k", "left").join(by_file, "stem", "left").withColumn("p", F.coalesce("p", "q")).drop("k", "stem", "q")


_VARIABLE = "%%[a-z_]+%%|%[a-z_]+%|#[a-z_]+"


def literal_parts(template: Column) -> Column:
    """What a template says besides its variables and separators."""
    return F.transform(F.filter(F.split(template, _VARIABLE), lambda t: ~t.rlike(r"^[ |:-]*$")), lambda t: F.trim(t))


def verify(changes: DataFrame, after: DataFrame) -> DataFrame:
    """The changes (url, field, value) with verdict (ok, mismatch, not_read, not_rendered) and what the page shows. after: a snapshot."""
    rows = _found(changes, after)
    v, f = F.col("value"), F.col("field")
    want = F.lower(F.trim(v)).isin("1", "yes", "true", "oui", "noindex")
    got = F.when(f == "title", F.col("p.title")).when(f == "description", F.col("p.description")).when(f == "canonical", F.col("p.canonical")).when(f == "noindex", F.when(F.col("p.noindex"), "noindex").otherwise("index"))
    got = F.coalesce(got, F.lit(""))
    parts = literal_parts(v)
    says = F.when(F.size(parts) > 0, F.forall(parts, lambda x: F.contains(F.lower(got), F.lower(x)))).otherwise(got != "")
    ok = F.when(f == "noindex", want == F.coalesce(F.col("p.noindex"), F.lit(False))).when(f == "canonical", (got != "") & (W.host_path(got) == W.host_path(v))).otherwise(says)
    verdict = F.when(F.col("p").isNull(), "not_read").when(f == "focus_keyword", "not_rendered").when(ok, "ok").otherwise("mismatch")
    return rows.select(*changes.columns, verdict.alias("verdict"), F.when(F.col("p").isNotNull(), got).otherwise("").alias("rendered"))


#: Where each plugin stores a field, and the call that writes it.
STORED = {
    "yoast": {"title": "_yoast_wpseo_title", "description": "_yoast_wpseo_metadesc", "canonical": "_yoast_wpseo_canonical", "focus_keyword": "_yoast_wpseo_focuskw", "noindex": "_yoast_wpseo_meta-robots-noindex"},
    "rankmath": {"title": "rank_math_title", "description": "rank_math_description", "canonical": "rank_math_canonical_url", "focus_keyword": "rank_math_focus_keyword", "noindex": "rank_math_robots"},
    "aioseo": {"title": "title", "description": "description", "canonical": "canonical_url", "noindex": "robots_noindex"},
    "seopress": {"title": "title", "description": "description", "canonical": "_seopress_robots_canonical", "noindex": "_seopress_robots_index", "focus_keyword": "_seopress_analysis_target_kw"},
}


def plan(changes: DataFrame, pages: DataFrame, plugin: str) -> DataFrame:
    """The changes with way (rest, cli, manual), method, path and body of the call that makes each, for a plugin. Nothing is sent. pages: a snapshot with post_id and rest_route."""
    rows = _found(changes, pages)
    own = F.col("post_id") if "post_id" in changes.columns else F.lit("")
    pid = F.coalesce(F.nullif(own, F.lit("")), F.col("p.post_id"), F.lit(""))
    route = F.when(F.coalesce(F.col("p.rest_route"), F.lit("")).rlike("^[a-z0-9_-]{1,40}$"), F.col("p.rest_route")).otherwise("posts")
    f, v = F.col("field"), F.col("value")
    no = F.lower(F.trim(v)).isin("1", "yes", "true", "oui", "noindex")
    key = F.try_element_at(F.create_map(*(F.lit(x) for kv in STORED[plugin].items() for x in kv)), f)
    quoted = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)
    pair = lambda k, x: F.concat(F.lit('{"'), k, F.lit('":'), x, F.lit("}"))
    if plugin == "rankmath":
        way, method, path = F.lit("rest"), F.lit("POST"), F.lit("/wp-json/rankmath/v1/updateMeta")
        meta = pair(key, F.when(f == "noindex", F.when(no, '["noindex","follow"]').otherwise('["index","follow"]')).otherwise(quoted(v)))
        body = F.concat(F.lit('{"objectType":"post","objectID":'), pid, F.lit(',"meta":'), meta, F.lit("}"))
    elif plugin == "yoast":
        rest = f.isin("title", "description", "focus_keyword") & (route == "posts")
        way, method = F.when(rest, "rest").otherwise("cli"), F.when(rest, "POST").otherwise("")
        path = F.when(rest, F.concat(F.lit("/wp-json/wp/v2/posts/"), pid)).otherwise("")
        stored = F.when(f == "noindex", F.when(no, "1").otherwise("2")).otherwise(v)
        body = F.when(rest, F.concat(F.lit('{"meta":'), pair(key, quoted(v)), F.lit("}"))).otherwise(F.concat_ws(" ", F.lit("wp post meta update"), pid, key, shell_quoted(stored)))
    elif plugin == "aioseo":
        way, method = F.when(f == "focus_keyword", "manual").otherwise("rest"), F.when(f == "focus_keyword", "").otherwise("POST")
        path = F.concat(F.lit("/wp-json/wp/v2/"), route, F.lit("/"), pid)
        data = F.when(f == "noindex", F.concat(F.lit('{"robots_default":false,"robots_noindex":'), no.cast("string"), F.lit("}"))).otherwise(pair(key, quoted(v)))
        body = F.concat(F.lit('{"aioseo_meta_data":'), data, F.lit("}"))
    else:
        way, method = F.when(f == "focus_keyword", "cli").otherwise("rest"), F.when(f == "focus_keyword", "").otherwise("PUT")
        end = F.when(f.isin("title", "description"), "title-description-metas").otherwise("meta-robot-settings")
        path = F.when(f == "focus_keyword", "").otherwise(F.concat(F.lit("/wp-json/seopress/v1/posts/"), pid, F.lit("/"), end))
        body = F.when(f == "focus_keyword", F.concat_ws(" ", F.lit("wp post meta update"), pid, key, shell_quoted(v))).otherwise(pair(key, F.when(f == "noindex", F.when(no, '"yes"').otherwise('""')).otherwise(quoted(v))))
    lost = ~pid.rlike(r"^\d{1,12}$")
    off = lost | (way == "manual")
    return rows.select(*changes.columns, F.when(off, "manual").otherwise(way).alias("way"), F.when(off, "").otherwise(method).alias("call"), F.when(off, "").otherwise(path).alias("path"), F.when(off, "").otherwise(body).alias("body"))


def shell_quoted(x: Column) -> Column:
    """A word of a shell command: in single quotes, where those inside are closed and opened again."""
    return F.when(x.rlike("^[A-Za-z0-9@%+=:,./_-]+$"), x).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


#: Variables of title templates: yoast, rankmath, aioseo, seopress.
VARIABLES = [
    ("%%title%%", "%title%", "#post_title", "%%post_title%%"), ("%%sep%%", "%sep%", "#separator_sa", "%%sep%%"), ("%%sitename%%", "%sitename%", "#site_title", "%%sitetitle%%"),
    ("%%sitedesc%%", "%sitedesc%", "#tagline", "%%tagline%%"), ("%%excerpt%%", "%excerpt%", "#post_excerpt", "%%post_excerpt%%"), ("%%primary_category%%", "%category%", "#categories", "%%post_category%%"),
    ("%%page%%", "%pagenumber%", "#page_number", "%%page%%"), ("%%currentyear%%", "%currentyear%", "#current_year", "%%currentyear%%"), ("%%term_title%%", "%term%", "#taxonomy_title", "%%term_title%%"),
    ("%%name%%", "%name%", "#author_name", "%%post_author%%"), ("%%date%%", "%date%", "#post_date", "%%post_date%%"), ("%%focuskw%%", "%focuskw%", "", "%%target_keyword%%"),
]
_PLUGIN = ["yoast", "rankmath", "aioseo", "seopress"]


def translated(template: Column, source: str, target: str) -> Column:
    """The template with the variables of one plugin as those of another; variables without a counterpart stay."""
    a, b = _PLUGIN.index(source), _PLUGIN.index(target)
    pairs = F.create_map(*(F.lit(x) for row in VARIABLES if row[a] and row[b] for x in (row[a], row[b])))
    # Cut into texts and variables in turn; one pass, so what is put in is never read again.
    words, texts = F.regexp_extract_all(template, F.lit(f"({_VARIABLE})"), 1), F.split(template, _VARIABLE)
    return F.array_join(F.transform(texts, lambda t, i: F.concat(t, F.coalesce(F.try_element_at(pairs, F.get(words, i)), F.get(words, i), F.lit("")))), "")
