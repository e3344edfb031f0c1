"""Answers of engines as their APIs return them: text, cited and consulted URLs, whether the engine searched.

Inputs have engine and json (one answer a row). The shapes are read by path; URLs keep their first place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANNOTATION = "struct<type:string,url:string>"
_PART = f"struct<type:string,text:string,annotations:array<{_ANNOTATION}>>"
_URL = "struct<url:string>"
SHAPES = {
    "openai": f"output array<struct<type:string,action:struct<sources:array<{_URL}>>,content:array<{_PART}>>>",
    "perplexity": f"output array<struct<type:string,results:array<{_URL}>,content:array<{_PART}>>>, choices array<struct<message:struct<content:string>>>, search_results array<{_URL}>",
    "gemini": "candidates array<struct<content:struct<parts:array<struct<text:string>>>,groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>,webSearchQueries:array<string>>>>",
    "anthropic": f"content array<struct<type:string,text:string,citations:array<{_URL}>,content:array<{_URL}>>>",
}


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _urls(rows: Column) -> Column:
    return F.filter(F.transform(F.coalesce(rows, _none(_URL)), lambda r: r["url"]), lambda u: u != "")


def _flat(lists: Column) -> Column:
    return F.flatten(F.coalesce(lists, F.array().cast("array<array<string>>")))


def _of(rows: Column, kind: str) -> Column:
    return F.filter(rows, lambda r: r["type"] == kind)


def _text(messages: Column) -> Column:
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(m["content"], _none(_PART))))
    return F.transform(_of(parts, "output_text"), lambda p: F.coalesce(p["text"], F.lit("")))


def parsed(answers: DataFrame) -> DataFrame:
    """The rows with text, cited, consulted and searched instead of json; an answer of another shape has an empty text and no URL."""

    def one(engine: str, text: Column, cited: Column, consulted: Column, searched: Column) -> DataFrame:
        d = answers.where(F.col("engine") == engine).withColumn("d", F.from_json("json", SHAPES[engine]))
        nothing = _none("string")
        return d.select(*(c for c in answers.columns if c != "json"), F.coalesce(text, F.lit("")).alias("text"), F.array_distinct(F.coalesce(cited, nothing)).alias("cited"), F.array_distinct(F.coalesce(consulted, nothing)).alias("consulted"), F.coalesce(searched, F.lit(False)).alias("searched"))

    out = F.col("d.output")
    says = _of(out, "message")
    notes = F.flatten(F.transform(F.flatten(F.transform(says, lambda m: F.coalesce(m["content"], _none(_PART)))), lambda p: F.coalesce(p["annotations"], _none(_ANNOTATION))))
    openai = one("openai", F.array_join(_text(says), "\n"), F.transform(F.filter(notes, lambda a: (a["type"] == "url_citation") & (a["url"] != "")), lambda a: a["url"]), _flat(F.transform(_of(out, "web_search_call"), lambda s: _urls(s["action"]["sources"]))), F.size(_of(out, "web_search_call")) > 0)

    old = F.get("d.choices", F.lit(0))["message"]["content"]
    new_text = F.array_join(_text(says), "\n")
    use_old = (F.coalesce(F.size(_text(says)), F.lit(-1)) <= 0) & (F.coalesce(F.size("d.choices"), F.lit(-1)) > 0)
    found = _flat(F.transform(_of(out, "search_results"), lambda s: _urls(s["results"])))
    perplexity = one("perplexity", F.when(use_old, old).otherwise(new_text), F.when(use_old, F.concat(found, _urls(F.col("d.search_results")))).otherwise(found), F.lit(None).cast("array<string>"), F.when(use_old, F.size(_urls(F.col("d.search_results"))) > 0).otherwise(F.size(_of(out, "search_results")) > 0))

    first = F.get("d.candidates", F.lit(0))
    # Redirect links hide where they lead; their title is the domain.
    def link(c: Column) -> Column:
        hidden = c["web"]["uri"].contains("grounding-api-redirect") & c["web"]["title"].contains(".")
        return F.when(hidden, F.concat(F.lit("https://"), F.lower(F.trim(c["web"]["title"])))).otherwise(c["web"]["uri"])

    parts = F.filter(F.transform(first["content"]["parts"], lambda p: p["text"]), lambda t: t != "")
    gemini = one("gemini", F.array_join(parts, "\n"), F.filter(F.transform(first["groundingMetadata"]["groundingChunks"], link), lambda u: u != ""), F.lit(None).cast("array<string>"), F.size(first["groundingMetadata"]["webSearchQueries"]) > 0)

    blocks = F.col("d.content")
    anthropic = one("anthropic", F.array_join(F.transform(_of(blocks, "text"), lambda b: F.coalesce(b["text"], F.lit(""))), ""), _flat(F.transform(_of(blocks, "text"), lambda b: _urls(b["citations"]))), _flat(F.transform(_of(blocks, "web_search_tool_result"), lambda b: _urls(b["content"]))), F.size(_of(blocks, "server_tool_use")) > 0)
    return openai.unionByName(perplexity).unionByName(gemini).unionByName(anthropic)


_SNAPSHOT = (
    "struct<questions:array<struct<question:string,theme:string,provider:string,cited:boolean,competitors_cited:array<string>,cited_urls:array<string>>>,"
    "visibility:struct<answers_measured:long,answers_with_mention:long>,by_provider:array<struct<slug:string,answers_measured:long,answers_with_mention:long>>>"
)


def tracker_snapshots(files: DataFrame, text: str = "text") -> DataFrame:
    """The other columns and snap: snapshots of a tracker, which sums its runs up. Words may stand before the JSON; the snapshot is its ``snapshot`` or the whole. A file without JSON, or of a site without a key, is an error."""
    from .exports import json_after_prefix

    keep = [c for c in files.columns if c != text]
    found = files.select(*keep, json_after_prefix(F.col(text)).alias("v"))
    state = F.try_variant_get("v", "$.state", "string")
    wrong = F.when(F.col("v").isNull(), "a file is no snapshot").when(state == "no_key", "the tracker has no key for this site: nothing was measured")
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.to_json("v"))
    whole = F.from_json(checked, f"struct<snapshot:{_SNAPSHOT}>")["snapshot"]
    return found.select(*keep, F.coalesce(whole, F.from_json(F.to_json("v"), _SNAPSHOT)).alias("snap"))


def tracker_answers(snapshots: DataFrame, brand: str) -> DataFrame:
    """Observations of the snapshots' questions, one a question and engine: prompt_id, prompt, family, engine, cited, brands, sources. What they count for is in tracker_counts."""
    keep = [c for c in snapshots.columns if c != "snap"]
    q = snapshots.select(*keep, F.explode("snap.questions").alias("q"))
    text, cited = F.coalesce("q.question", F.lit("")), F.coalesce("q.cited", F.lit(False))
    none = F.array().cast("array<string>")
    named = F.coalesce("q.competitors_cited", none)
    return q.select(*keep, F.substring(text, 1, 60).alias("prompt_id"), text.alias("prompt"), F.coalesce("q.theme", F.lit("")).alias("family"), F.lower(F.coalesce("q.provider", F.lit(""))).alias("engine"), cited.alias("cited"), F.when(cited, F.concat(F.array(F.lit(brand)), named)).otherwise(named).alias("brands"), F.coalesce("q.cited_urls", none).alias("sources"))


def tracker_counts(snapshots: DataFrame) -> DataFrame:
    """The other columns with kind (overall, engine), name, n and k: the tracker's own counts of answers and of those that cite the brand; where none was measured there is no row."""
    keep = [c for c in snapshots.columns if c != "snap"]
    one = lambda kind, name, c: F.struct(F.lit(kind).alias("kind"), name.alias("name"), c["answers_measured"].alias("n"), F.coalesce(c["answers_with_mention"], F.lit(0)).cast("long").alias("k"))
    engines = F.transform(F.coalesce("snap.by_provider", F.array().cast("array<struct<slug:string,answers_measured:long,answers_with_mention:long>>")), lambda p: one("engine", F.lower(F.coalesce(p["slug"], F.lit(""))), p))
    rows = snapshots.select(*keep, F.explode(F.concat(F.array(one("overall", F.lit("all"), F.col("snap.visibility"))), engines)).alias("r"))
    return rows.select(*keep, "r.*").where("n > 0")
