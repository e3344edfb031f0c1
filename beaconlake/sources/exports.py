"""Files of other tools: delimited exports with headers in several languages, URL inventories, maps, logs of actions.

A file is a row (file, content as bytes), as ``read_files`` gives it; files are decoded and cut into rows in tasks, one
file at a time, and given on some thousand rows at a time. Headers are compared folded (no accents, signs or case)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number

#: Folded header names of the fields of a search-performance export.
PERFORMANCE = {
    "date": ["date", "dates", "jour", "jours", "fecha", "datum"],
    "query": ["query", "queries", "topqueries", "requete", "requetes", "requetespopulaires", "requeteslesplusfrequentes", "consulta", "consultas", "suchanfragen"],
    "page": ["page", "pages", "toppages", "pagesprincipales", "pageslesplusfrequentes", "pageslespluspopulaires", "url", "landingpage", "pagina", "paginas", "seite", "seiten"],
    "clicks": ["clicks", "clics", "totalclicks", "nombredeclics", "klicks"],
    "impressions": ["impressions", "affichages", "impresiones", "impressionen"],
    "ctr": ["ctr", "sitectr", "averagectr", "tauxdeclics", "ctrmoyen"],
    "position": ["position", "averageposition", "positionmoyenne", "posicion", "durchschnittlicheposition"],
}
#: Folded header names of URL inventories and redirect maps. A value is the first of these that a file has.
INVENTORY = {
    "url": ["url", "urls", "address", "adresse", "page", "pages", "toppages", "pageslesplusfrequentes", "pageslespluspopulaires", "loc", "source", "sourceurl", "urlsource", "from", "origin", "old", "oldurl", "ancienneurl", "landingpage", "adressedelapage", "pagina", "paginas", "seite"],
    "target": ["target", "targeturl", "destination", "to", "cible", "newurl", "nouvelleurl"],
    "code": ["code", "type", "status", "redirecttype", "statuscode", "httpcode"],
    "title": ["title", "title1", "titre", "pagetitle", "titredelapage", "name"],
    "method": ["method"], "decision": ["decision"], "note": ["note"],
}
VALUES = {"value": ["value", "valeur"], "clicks": ["clicks", "clics", "totalclicks", "nombredeclics", "klicks"], "hits": ["hits", "hitcount", "count", "visites", "sessions", "pageviews"], "links": ["backlinks", "referringdomains", "domainesreferents", "inlinks", "liensentrants", "links"], "impressions": ["impressions", "affichages", "impresiones"]}
#: Folded header names of an action log, and states that mean an action is still to come.
ACTIONS = {
    "date": ["date", "jour", "datum"], "site": ["site", "siteid", "domain", "domaine", "client"], "url": ["url", "page", "adresse", "lien"],
    "type": ["type", "action", "actiontype", "typeaction", "categorie", "category"], "description": ["description", "detail", "details", "note", "notes", "commentaire"], "status": ["status", "statut", "etat", "state"],
}
PLANNED = ["planned", "plan", "prevu", "planifie", "todo", "afaire", "next"]
#: Fields of a change request, words for yes and no.
CHANGES = ["title", "description", "canonical", "noindex", "focus_keyword"]
YES, NO = ["1", "true", "yes", "y", "oui", "o", "vrai", "si", "ja"], ["0", "false", "no", "n", "non", "faux", "nein", ""]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of a file or a folder; an empty folder is an error."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    if files.isEmpty():
        raise ValueError(f"no file in {path}")
    return files


def unpacked(content: bytes) -> bytes:
    """The bytes of a file that gzip, bzip2 or xz made, by how it begins, whatever its name is."""
    import bz2
    import gzip
    import lzma

    for magic, f in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ\x00", lzma.decompress)):
        if content.startswith(magic):
            return f(content)
    return content


def decoded(content: bytes) -> str:
    """Text in the first encoding that fits and gives no NUL: UTF-8, UTF-16, Windows Latin, Latin."""
    content = unpacked(content)
    for name in ("utf-8-sig", "utf-16", "cp1252"):
        try:
            text = content.decode(name)
        except UnicodeError:
            continue
        if "\0" not in text:
            return text
    return content.decode("latin-1")


def texts(files: DataFrame) -> DataFrame:
    """(file, text) of the files."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda x: decoded(bytes(x)))

    return files.select("file", text("content").alias("text"))


def _pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """What str.splitlines cuts the text into, blank pieces left out, with about ``size`` characters in lines at a time."""
    at, end = 0, "\n" if "\n" in text else "\r"
    while at < len(text):
        to = text.find(end, at + size) + 1 or len(text)
        yield from (x for x in text[at:to].splitlines(keepends=True) if x.strip())
        at = to


def _lines(text: str) -> Iterator[str]:
    """Lines of the text without its blank ones; only line feeds and carriage returns end a line."""
    held = ""
    for x in _pieces(text):
        held += x
        if x[-1] in "\r\n":
            yield held
            held = ""
    if held:
        yield held


def cells(files: DataFrame) -> DataFrame:
    """(file, row_no, names, values): the rows of delimited files under their folded headers. The delimiter is the one that the first line has most."""

    def cut(batches):
        import csv
        import itertools
        import re
        import unicodedata

        def folded(x: str) -> str:
            return re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())

        for b in batches:
            for file, content in zip(b.file, b.content, strict=True):
                text = decoded(bytes(content))
                head = next(_pieces(text), None)
                if head is None:
                    continue
                sep = max(",;\t|", key=head.count)
                rows = csv.reader(_lines(text), delimiter=sep)
                first = next(rows)
                names, at = [folded(x) for x in first], 0
                rows = itertools.chain([first], rows)
                while part := list(itertools.islice(rows, 4096)):
                    yield pd.DataFrame({"file": [file] * len(part), "row_no": range(at, at + len(part)), "names": [names] * len(part), "values": part})
                    at += len(part)

    return files.mapInPandas(cut, "file string, row_no long, names array<string>, values array<string>")


def field(names: list[str]) -> Column:
    """The value under the first column of the header that has one of the names; null if none has."""
    wanted = F.array(*map(F.lit, names))
    at = F.filter(F.transform(F.col("names"), lambda n, i: F.when(F.array_contains(wanted, n), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.trim(F.coalesce(F.get("values", F.get(at, F.lit(0))), F.lit(""))))


def whole_number(text: Column) -> Column:
    """The digits of the text as one number (1.5 is 15, as exports without decimals mean it); 0 without any."""
    return F.coalesce(F.regexp_replace(text, "[^0-9-]", "").try_cast("long"), F.lit(0).cast("long"))


def any_date(text: Column) -> Column:
    """A date in one of the usual notations, day before month."""
    t = F.trim(text)
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyyMMdd"]
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in forms))


def ambiguous_date(text: Column) -> Column:
    """Whether day and month of a date with slashes could be either."""
    return F.regexp_extract(text, r"^\s*(\d{1,2})/\d{1,2}/\d{4}\s*$", 1).try_cast("int") <= 12


def rate_percent(text: Column) -> Column:
    """A click rate in percent: a value of up to 1 without a percent sign is a share."""
    v = number(text)
    return F.round(F.when(~text.contains("%") & (v <= 1), v * 100).otherwise(v), 4)


def performance(files: DataFrame) -> DataFrame:
    """file, kind (dates, queries, pages), date, label, clicks, impressions, ctr, position, ambiguous: search-performance exports. Files of no known kind give no row."""
    has = lambda f: F.arrays_overlap("names", F.array(*map(F.lit, PERFORMANCE[f])))
    kind = F.when(has("date"), "dates").when(has("query"), "queries").when(has("page"), "pages")
    rows = cells(files).where("row_no > 0").withColumn("kind", kind).where("kind is not null")
    label = F.when(kind == "dates", field(PERFORMANCE["date"])).when(kind == "queries", field(PERFORMANCE["query"])).otherwise(field(PERFORMANCE["page"]))
    rows = rows.withColumn("label", label).withColumn("date", F.when(F.col("kind") == "dates", any_date(F.col("label"))))
    good = F.when(F.col("kind") == "dates", F.col("date").isNotNull()).otherwise(F.col("label") != "")
    clicks, shown, rate, place = (field(PERFORMANCE[f]) for f in ("clicks", "impressions", "ctr", "position"))
    return rows.where(good).select("file", "row_no", "kind", "date", "label", F.when(clicks.isNotNull(), whole_number(clicks)).alias("clicks"), F.when(shown.isNotNull(), whole_number(shown)).alias("impressions"), rate_percent(rate).alias("ctr"), number(place).alias("position"), F.coalesce(ambiguous_date(F.col("label")), F.lit(False)).alias("ambiguous"))


def metric_series(rows: DataFrame, metric: str, by: str = "file") -> DataFrame:
    """(series_id, d, v) of a metric of dates exports; rows without it are left out."""
    return rows.where("kind = 'dates'").select(F.col(by).alias("series_id"), F.col("date").alias("d"), F.col(metric).cast("double").alias("v")).where("v is not null")


def inventory_rows(files: DataFrame) -> DataFrame:
    """file, line_no, url, target, code, title, method, decision, note, value, value_kind of URL lists: with a header, or one URL a line (a second one is its target)."""
    known = F.array(*(F.lit(x) for f in ("url", "target") for x in INVENTORY[f]))
    rows = cells(files).withColumn("headed", F.arrays_overlap("names", known)).where("not headed or row_no > 0")
    at = lambda i: F.trim(F.coalesce(F.get("values", F.lit(i)), F.lit("")))
    web = at(1).rlike("^(/|https?://)")
    bare = {"url": at(0), "target": F.when(web, at(1)), "code": F.when(at(2).rlike(r"^\d+$"), at(2))}
    kinds = [(k, field(names)) for k, names in VALUES.items()]
    value = F.when(F.col("headed"), F.coalesce(*(c for _, c in kinds)))
    kind = F.when(F.col("headed"), F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in kinds)))
    columns = [F.when(F.col("headed"), field(names)).otherwise(bare.get(f, F.lit(None))).alias(f) for f, names in INVENTORY.items()]
    out = rows.select("file", F.col("row_no").alias("line_no"), *columns, F.coalesce(number(value), F.lit(0.0)).alias("value"), kind.alias("value_kind"))
    return out.where("url <> ''")


def map_rows(files: DataFrame) -> DataFrame:
    """A redirect map (source, target, code, decision, value, method, note): without a decision, a code of 410 or 451 is gone; without a code, a row without target is 410."""
    r = inventory_rows(files)
    none = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    code, decision = none("code"), none("decision")
    return r.select(
        F.col("url").alias("source"), F.coalesce("target", F.lit("")).alias("target"),
        F.coalesce(code, F.when(none("target").isNull(), "410").otherwise("301")).alias("code"),
        F.coalesce(decision, F.when(code.isin("410", "451"), "gone").otherwise("redirect")).alias("decision"),
        "value", F.coalesce("method", F.lit("")).alias("method"), F.coalesce("note", F.lit("")).alias("note"), "line_no",
    )


def rewrite_rules(files: DataFrame) -> DataFrame:
    """(at, expression, replacement) of lines ``expression => replacement``, in the order of files and lines; a line without => that is no comment is an error."""
    lines = texts(files).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).select("file", "line_no", F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#')")
    wrong = F.raise_error(F.format_string("%s line %d: expected 'expression => replacement'", "file", F.col("line_no") + 1))
    cut = F.instr("line", "=>")
    return lines.select(
        F.struct("file", "line_no").alias("at"),
        F.when(cut == 0, wrong).otherwise(F.trim(F.substring_index("line", "=>", 1))).alias("expression"),
        F.trim(F.substr("line", cut + 2)).alias("replacement"),
    )


def unescaped(x: Column) -> Column:
    """The text with the five entities of XML decoded."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def citations(files: DataFrame) -> DataFrame:
    """(file, url) of cited URLs: a JSON list, an object with one, or lines whose first cell counts and where # begins a comment."""
    t = texts(files).withColumn("v", F.try_parse_json("text"))
    lists = F.coalesce(*(F.try_variant_get("v", p, "array<string>") for p in ("$", "$.cited", "$.urls", "$.citations")))
    lines = F.transform(F.filter(F.split("text", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")), lambda x: F.trim(F.substring_index(x, ",", 1)))
    return t.select("file", F.explode(F.when(F.col("v").isNotNull(), lists).otherwise(lines)).alias("url")).where("url <> ''")


def missing_pages(files: DataFrame) -> DataFrame:
    """(url, value) of what answered 404: counted in access logs, or an inventory of them."""
    t = texts(files)
    is_log = F.substring("text", 1, 3000).rlike(r'"(?:GET|HEAD|POST) \S+ HTTP/[\d.]+" \d{3}')
    line = t.where(is_log).select(F.explode(F.split("text", r"\r?\n")).alias("line"))
    hit = line.select(F.regexp_extract("line", r'"(?:GET|HEAD|POST) (\S+) HTTP/[\d.]+" 404', 1).alias("url")).where("url <> ''")
    logs = hit.groupBy("url").agg(F.count("*").cast("double").alias("value"))
    other = inventory_rows(files.join(t.where(~is_log).select("file"), "file", "left_semi"))
    return logs.unionByName(other.groupBy("url").agg(F.sum("value").alias("value")))


def action_log(files: DataFrame) -> DataFrame:
    """date (text), site, url, type, description, status, planned of an agency's action log; files without a date or site column give no row."""
    need = [F.arrays_overlap("names", F.array(*map(F.lit, ACTIONS[f]))) for f in ("date", "site")]
    rows = cells(files).where(need[0] & need[1] & (F.col("row_no") > 0))
    out = rows.select(*(F.coalesce(field(names), F.lit("")).alias(f) for f, names in ACTIONS.items()))
    return out.withColumn("planned", F.regexp_replace(F.lower(F.translate("status", "éèê", "eee")), "[^a-z0-9]", "").isin(PLANNED))


def change_requests(files: DataFrame) -> DataFrame:
    """url, field, value, post_id of change requests. A field of no known name, a line break, a post id that is no number and a URL that is none are errors."""
    rows = cells(files).where("row_no > 0")
    get = lambda *names: F.coalesce(field(list(names)), F.lit(""))
    r = rows.select("file", "row_no", get("url").alias("url"), get("field").alias("field"), get("value").alias("value"), get("postid").alias("post_id"))
    problem = (
        F.when(~F.col("field").isin(CHANGES), F.concat(F.lit("no such field: "), "field"))
        .when(F.concat("url", "value", "post_id").rlike(r"[\r\n]"), "a line break in a field")
        .when(~F.col("post_id").rlike(r"^(\d{1,12})?$"), F.concat(F.lit("no number: "), "post_id"))
        .when(~F.col("url").rlike("^https?://"), F.concat(F.lit("no URL: "), "url"))
    )
    checked = F.when(problem.isNotNull(), F.raise_error(F.format_string("%s line %d: %s", "file", F.col("row_no") + 1, problem))).otherwise(F.col("url"))
    return r.select(checked.alias("url"), "field", "value", "post_id")


def survey_rows(files: DataFrame, strict: bool = False, brand: str = "") -> DataFrame:
    """Survey answers. Lenient: an answer without ``cited`` failed and is left out, a cited answer counts the brand. Strict: it is no, and unknown words, positions and moods are errors."""
    rows = cells(files).where("row_no > 0")
    get = lambda n: F.coalesce(field([n]), F.lit(""))
    r = rows.select("file", "row_no", *(get(n.replace("_", "")).alias(n) for n in ("prompt_id", "prompt", "family", "engine", "run", "date", "cited", "position", "sentiment", "cited_url", "brands", "sources")))
    word = F.lower("cited")
    sources = F.filter(F.split("sources", r"[\s|]+"), lambda u: u.startswith("http"))
    sources = F.array_distinct(F.concat(sources, F.when(F.col("cited_url") != "", F.array("cited_url")).otherwise(F.array().cast("array<string>"))))
    names = F.filter(F.split("brands", r"\|"), lambda b: b != "")
    yes = word.isin(YES)
    if brand:
        names = F.when(yes, F.array_union(names, F.array(F.lit(brand)))).otherwise(names)
    if strict:
        position = F.when(F.col("position") != "", F.lower("position")).when(yes, "none").otherwise("none")
        mood = F.when(F.col("sentiment") == "", "none").otherwise(F.lower("sentiment"))
        problem = F.when(~word.isin(YES + NO), "cited is neither yes nor no").when(~position.isin("first", "passing", "footnote", "none"), "no such position").when(~mood.isin("positive", "neutral", "negative", "mixed", "none"), "no such sentiment")
        yes = F.when(problem.isNotNull(), F.raise_error(F.format_string("%s line %d: %s", "file", F.col("row_no") + 1, problem))).otherwise(yes)
        unset = lambda c, v: F.when(F.col(c) == "", v).otherwise(F.col(c))
        r = r.where("prompt_id <> ''").withColumns({"position": position, "sentiment": mood, "family": unset("family", "unclassified"), "engine": unset("engine", "unknown"), "run": unset("run", "1")})
    else:
        r = r.where("cited <> ''").withColumn("engine", F.lower("engine"))
    return r.select("prompt_id", "prompt", "family", "engine", "run", "date", yes.alias("cited"), "position", "sentiment", "cited_url", names.alias("brands"), sources.alias("sources"))


def json_after_prefix(text: Column) -> Column:
    """The JSON value of a text that may begin with other words: from the first bracket of its first 4 000 characters on which the rest parses (40 are tried)."""
    starts = F.filter(F.sequence(F.lit(1), F.least(F.length(text), F.lit(4000))), lambda i: F.substring(F.substr(text, i), 1, 1).isin("{", "["))
    return F.get(F.filter(F.transform(F.slice(starts, 1, 40), lambda i: F.try_parse_json(F.substr(text, i))), lambda v: v.isNotNull()), F.lit(0))


def snapshots(files: DataFrame) -> DataFrame:
    """Pages of snapshot files ({"pages": [...]}), one row a normalised URL (the last one wins)."""
    from ..functions.web import host_path

    kind = "array<struct<url:string,status:int,title:string,description:string,robots:string,noindex:boolean,canonical:string,og_title:string,hreflang:int,schema_types:array<string>,post_id:string,rest_route:string,plugins:array<string>>>"
    rows = texts(files).select("file", F.posexplode(F.from_json(F.get_json_object("text", "$.pages"), kind)).alias("at", "p")).select("file", "at", "p.*")
    last = rows.groupBy("file", host_path(F.col("url")).alias("key")).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("file", "at"))), "at").alias("p"))
    return last.select("file", "key", "p.*")


def page_list(files: DataFrame) -> DataFrame:
    """(url, title, value) of pages that may be listed for answer engines: an export, or lines of URLs."""
    r = inventory_rows(files)
    return r.where("url rlike '^https?://'").select("url", F.coalesce("title", F.lit("")).alias("title"), "value")


def key_pages(files: DataFrame) -> DataFrame:
    """(at, url, title) of lines ``url | title`` (the title may be absent), in order."""
    lines = texts(files).select(F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).where("trim(line) <> '' and not startswith(trim(line), '#')")
    return lines.select("at", F.trim(F.substring_index("line", "|", 1)).alias("url"), F.trim(F.when(F.col("line").contains("|"), F.regexp_replace("line", r"^[^|]*\|", "")).otherwise("")).alias("title"))


def brand(files: DataFrame) -> DataFrame:
    """(file, name, aliases, domains) of brand files, JSON objects; one without a name is an error."""
    kind = "struct<name:string,aliases:array<string>,domains:array<string>>"
    t = texts(files).select("file", F.from_json("text", kind).alias("b"))
    name = F.when(F.coalesce("b.name", F.lit("")) == "", F.raise_error(F.concat("file", F.lit(": a brand needs a name")))).otherwise(F.col("b.name"))
    none = F.array().cast("array<string>")
    return t.select("file", name.alias("name"), F.coalesce("b.aliases", none).alias("aliases"), F.coalesce("b.domains", none).alias("domains"))


def prompts(files: DataFrame) -> DataFrame:
    """prompt_id, prompt, family of a survey's frozen prompts; a file without the columns prompt_id and prompt is an error."""
    rows = cells(files)
    missing = ~(F.array_contains("names", "promptid") & F.array_contains("names", "prompt"))
    checked = F.when(missing, F.raise_error(F.concat("file", F.lit(" needs the columns prompt_id and prompt")))).otherwise(field(["promptid"]))
    rows = rows.where(missing | (F.col("row_no") > 0))
    return rows.select(checked.alias("prompt_id"), field(["prompt"]).alias("prompt"), F.coalesce(field(["family"]), F.lit("")).alias("family"))
