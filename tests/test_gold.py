"""Small inputs with results worked out by hand, for readers, sinks and operators that no query of the tables runs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from beaconlake import sinks
from beaconlake.operators import access, findings, migration, pages, passages, redirects, surveys
from beaconlake.sources import answers, exports, sitemaps, variants


def files(spark, **contents):
    return spark.createDataFrame([(k, v if isinstance(v, bytes) else v.encode()) for k, v in contents.items()], "file string, content binary")


def got(df, *columns):
    columns = columns or df.columns
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_survey_lenient_and_strict(spark):
    text = "Prompt ID;Prompt;Family;Engine;Run;Date;Cited;Position;Sentiment;Cited URL;Brands;Sources\np1;Best?;f;ChatGPT;1;2026-01-01;Oui;First;;https://me.com/a;x|y;https://a.com | https://b.com\np2;Other;;;;;;;;;z;no url\n"
    (a,) = exports.survey_rows(files(spark, s=text), brand="Me").collect()
    assert (a.prompt_id, a.engine, a.cited, a.brands, a.sources) == ("p1", "chatgpt", True, ["x", "y", "Me"], ["https://a.com", "https://b.com", "https://me.com/a"])
    a, b = sorted(exports.survey_rows(files(spark, s=text), strict=True).collect(), key=lambda r: r.prompt_id)
    assert (a.engine, a.cited, a.position, a.sentiment) == ("ChatGPT", True, "first", "none")
    assert (b.cited, b.position, b.family, b.engine, b.run, b.sources) == (False, "none", "unclassified", "unknown", "1", [])
    for bad in ("maybe;first;", "yes;middle;", "no;none;angry"):
        with pytest.raises(Exception, match="s line 2"):
            exports.survey_rows(files(spark, s=f"prompt_id;cited;position;sentiment\np;{bad}"), strict=True).collect()


def test_missing_pages_of_logs_and_lists(spark):
    log = '10.0.0.1 - - [01/Jan/2026:00:00:00 +0000] "GET /a HTTP/1.1" 404 1 "-" "x"\n' * 2 + '10.0.0.1 - - [01/Jan/2026:00:00:00 +0000] "GET /b HTTP/1.1" 200 1 "-" "x"\n'
    found = exports.missing_pages(files(spark, log=log, list="URL;Hits\n/a;3\n/c;4\n"))
    assert got(found) == [("/a", 2.0), ("/a", 3.0), ("/c", 4.0)]


def test_changes_are_checked(spark):
    good = "URL,Field,Value,Post ID\nhttps://a.com/x,title,New,12\nhttps://a.com/y,noindex,1,\n"
    assert got(exports.change_requests(files(spark, c=good))) == [("https://a.com/x", "title", "New", "12"), ("https://a.com/y", "noindex", "1", "")]
    for bad in ("https://a.com,colour,x,1", "https://a.com,title,x,one", "/a,title,x,1"):
        with pytest.raises(Exception, match="c line 2"):
            exports.change_requests(files(spark, c=f"url,field,value,post_id\n{bad}\n")).collect()


def test_cited_urls_of_json_and_lines(spark):
    found = exports.citations(files(spark, a='["https://a.com", "https://b.com"]', b='{"urls": ["https://c.com"]}', c="https://d.com,3\n# note\n\nhttps://e.com\n"))
    assert got(found) == [("a", "https://a.com"), ("a", "https://b.com"), ("b", "https://c.com"), ("c", "https://d.com"), ("c", "https://e.com")]


def test_snapshot_files_last_page_wins(spark):
    page = lambda url, title: {"url": url, "status": 200, "title": title}
    found = exports.snapshots(files(spark, s=json.dumps({"pages": [page("https://a.com/x/", "old"), page("https://a.com/x", "new"), page("https://a.com/y", "y")]})))
    assert sorted(r.title for r in found.collect()) == ["new", "y"]


def test_page_lists(spark):
    found = exports.page_list(files(spark, p="Address,Title 1,Clicks\nhttps://a.com/x,Ex,5\n/relative,No,1\n"))
    assert got(found) == [("https://a.com/x", "Ex", 5.0)]
    lines = exports.key_pages(files(spark, k="# best\nhttps://a.com/x | The X\nhttps://a.com/y\n"))
    assert [(r.url, r.title) for r in lines.orderBy("at").collect()] == [("https://a.com/x", "The X"), ("https://a.com/y", "")]


def test_rewrite_rules_in_order(spark):
    rules = exports.rewrite_rules(files(spark, r="# moves\n^/a/(.*)$ => /b/$1\n\n/old => /new => x\n")).orderBy("at").collect()
    assert [(r.expression, r.replacement) for r in rules] == [("^/a/(.*)$", "/b/$1"), ("/old", "/new => x")]
    with pytest.raises(Exception, match="r line 2"):
        exports.rewrite_rules(files(spark, r="a => b\nno arrow\n")).collect()


@pytest.mark.parametrize(
    ("expression", "literal"),
    [("^/shop/item-([0-9]+)[.]html$", "/shop/item-"), ("/(shop|store)/deep", "/deep"), ("/shopping|/store", ""), ("/SHOPs?/x", "/shop"), ("a{2,3}/abcde", "/abcde"), (r"\d+/page\.php", "/page.php"), ("/xyz+abc", "/xyz"), ("[ab]abcdef", "abcdef"), ("", ""), ("/abc*d", "/ab")],
)
def test_what_an_expression_needs(expression, literal):
    assert redirects.literal_of(expression, 2) == literal


def test_rules_first_known_rewriting_wins(spark):
    old = redirects.inventory(spark.createDataFrame([("/Old/A",), ("/old/b",), ("/x/c",), ("/zz",)], "url string"))
    new = redirects.inventory(spark.createDataFrame([("/new/a",), ("/all/b",), ("/y/c",)], "url string"))
    rules = spark.createDataFrame([(1, "^/old/(.*)$", "/new/$1"), (2, "^/OLD/(.*)$", "/all/$1"), (3, "x", "y")], "at int, expression string, replacement string")
    page = new.select(F.col("key").alias("to"), F.col("path").alias("target"))
    assert got(redirects.by_rules(old, page, rules), "key", "target", "rule") == [("/old/a", "/new/a", "^/old/(.*)$"), ("/old/b", "/all/b", "^/OLD/(.*)$"), ("/x/c", "/y/c", "x")]
    found = {r.key: r.method for r in redirects.match(old, new, rules).collect()}
    assert found["/old/a"] == found["/old/b"] == "rule" and found["/zz"] is None
    plan = redirects.by_rules(old, page, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 2  # the rules' one, and the pages'


def test_review_order_and_collapsed_chains(spark):
    rows = spark.createDataFrame([("/a", "/b", 301, "redirect", 1.0), ("/b", "/c", 301, "redirect", 9.0), ("/l", "/m", 301, "redirect", 1.0), ("/m", "/l", 301, "redirect", 1.0), ("/q", "", 410, "gone", 5.0)], "source string, target string, code int, decision string, value double")
    assert got(redirects.collapsed(rows.where("decision = 'redirect'")), "source", "target") == [("/a", "/c"), ("/b", "/c")]
    ordered = [r.source for r in redirects.in_order(rows).collect()]
    assert ordered.index("/b") < ordered.index("/a") and len(ordered) == 5
    assert [r.source for r in migration.to_test(rows, 2).collect()] == ["/b", "/q"]


def test_swaps_become_rules(spark):
    old = redirects.inventory(spark.createDataFrame([(f"/news/s{i}",) for i in range(6)] + [("/news/gone",)], "url string"))
    new = redirects.inventory(spark.createDataFrame([(f"/journal/s{i}",) for i in range(6)], "url string"))
    swaps = redirects.learn_swaps(old, new)
    (rule,) = redirects.swap_rules(swaps, old, new).collect()
    assert rule.exceptions == 1 and "news" in rule.regex and "journal" in rule.replacement


def test_candidates_share_rare_words(spark):
    new = redirects.inventory(spark.createDataFrame([(f"/p/{x}",) for x in ("red-wool-sock", "blue-wool-sock", "green-hat", "red-hat", "one", "two", "three", "four")], "url string"))
    left = redirects.inventory(spark.createDataFrame([("/old/wool-sock-red-2019",)], "url string"))
    (r,) = redirects.candidates(left, new, 2).collect()
    assert r.candidates == ["/p/red-wool-sock", "/p/blue-wool-sock"]


def test_landing_pages(spark):
    cases = [
        ('<meta name="robots" content="NOINDEX, follow"><link rel="canonical" href="https://a.com/x">', None, (True, "https://a.com/x", False)),
        ("<meta content='none' name='googlebot'>", None, (True, "", False)),
        ('<meta http-equiv="refresh" content="0;url=/x">', "index", (False, "", True)),
        ("<p>noindex</p>", "NoIndex", (True, "", False)),
        (None, None, (False, "", False)),
    ]
    rows = spark.createDataFrame([(i, h, x) for i, (h, x, _) in enumerate(cases)], "i int, html string, header string")
    found = rows.select("i", *(c.alias(n) for c, n in zip(migration.landing(F.col("html"), F.col("header")), ("noindex", "canonical", "refresh"), strict=True))).orderBy("i").collect()
    assert [(r.noindex, r.canonical, r.refresh) for r in found] == [want for *_, want in cases]


def test_headers_add_noindex(spark):
    rows = spark.createDataFrame([("u", False), ("v", False), ("w", True)], "url string, noindex boolean")
    headers = spark.createDataFrame([("u", 200, "NOINDEX"), ("w", 200, None)], "url string, status int, x_robots string")
    assert got(pages.with_headers(rows, headers), "url", "noindex", "status") == [("u", True, 200), ("v", False, None), ("w", True, 200)]


def test_robots_name_sitemaps(spark):
    text = "User-agent: *\nSitemap: https://a.com/s.xml # main\nsitemap:https://a.com/t.xml\nDisallow: /sitemap: x\n"
    assert got(access.sitemaps_of(spark.createDataFrame([("a", text), ("b", None)], "host string, text string"))) == [("a", "https://a.com/s.xml"), ("a", "https://a.com/t.xml")]


def test_agents_by_purpose(spark):
    rules = access.robots_rules(spark.createDataFrame([("a", "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /x")], "host string, text string"))
    paths = spark.createDataFrame([("a", "/"), ("a", "/x"), ("a", "/y")], "host string, path string")
    found = access.agents(access.access(paths, rules, ["GPTBot", "ClaudeBot"]))
    assert got(found, "agent", "state", "blocked", "sample") == [("ClaudeBot", "open", 1, ["/x"]), ("GPTBot", "closed", 3, ["/", "/x", "/y"])]
    assert sum(r.agents for r in access.by_purpose(found).collect()) == 2


def test_weights_and_priorities(spark):
    rows = spark.createDataFrame([(9, 5.0, 0, 99), (1, 5.0, 3, 99), (1, 5.0, 1, 99), (1, 5.0, 0, 4), (1, 5.0, 0, 99)], "impressions int, median double, recurring int, rank int")
    weight = surveys.volume_weight(F.col("impressions"), F.col("median"), F.col("recurring"), F.col("rank"))
    assert [r.w for r in rows.select(weight.alias("w")).collect()] == [3, 2, 1, 3, None]
    kinds = spark.createDataFrame([("wrong facts",), ("new",)], "kind string").select(surveys.gap_priority(F.col("kind")).alias("g")).collect()
    assert [r.g and tuple(r.g) for r in kinds] == [(2, "high"), None]


def test_map_and_series_files(spark):
    rows = spark.createDataFrame([("/a,b", "/c", 301, "slug", 0.85, "redirect", 3.0, "x"), ("/d", "", 410, "", None, "gone", 9.5, "")], "source string, target string, code int, method string, confidence double, decision string, value double, note string")
    lines = [r.line for r in sinks.map_lines(rows).orderBy("at").collect()]
    assert lines[0] == "source,target,code,method,confidence,decision,value,note" and '"/a,b",/c,301,slug,0.85,redirect,3,x' in lines and len(lines) == 3
    days = spark.createDataFrame([(datetime.date(2026, 1, 2), 2.5), (datetime.date(2026, 1, 1), 3.0)], "d date, v double")
    assert [r.line for r in sinks.series_lines(days).orderBy("at").collect()] == ["date,value", "2026-01-01,3", "2026-01-02,2.5"]


def test_json_walk_and_range_files(spark):
    deep = "[" * 40 + '{"cidr": "10.0.0.0/8"}' + "]" * 40
    rows = spark.createDataFrame([(1, deep), (2, "no json"), (3, None), (4, '"alone"'), (5, '{"a": {}, "b": [], "_c": {"cidr": "1.1.1.0/24"}}')], "id int, json string")
    nodes = variants.walk(rows, "json")
    assert got(nodes.groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("d"))) == [(1, 42, 41), (4, 1, 0), (5, 5, 2)]
    assert got(variants.harvest_ranges(rows)) == [(1, "10.0.0.0/8"), (5, "1.1.1.0/24")]
    text = '{"_generated": ["9.9.9.0/24"], "OpenAI": ["1.0.0.0/24", "bad", {"prefix": "2.0.0.0/24", "ip": "3.0.0.0/24"}], "b": {"ranges": [], "ips": ["4.0.0.0/24"]}, "c": "5.0.0.0/24", "d": 7}'
    found = variants.provider_ranges(spark.createDataFrame([(text,)], "json string"))
    assert got(found) == [("b", "4.0.0.0/24"), ("c", "5.0.0.0/24"), ("openai", "1.0.0.0/24"), ("openai", "2.0.0.0/24"), ("openai", "3.0.0.0/24")]


def test_sitemaps_that_list_each_other(spark):
    xml = lambda kind, *locs: f"<{kind}>" + "".join(f"<loc>{x}</loc>" for x in locs) + f"</{kind}>"
    site = [("https://a.com/i.xml", xml("sitemapindex", "https://A.com/i.xml", "https://a.com/s.xml", "https://a.com/j.xml")), ("https://a.com/j.xml", xml("sitemapindex", "https://a.com/i.xml", "https://a.com/no.xml")), ("https://a.com/s.xml", xml("urlset", "https://a.com/p?a=1&amp;b=2")), ("https://a.com/unlisted.xml", xml("urlset", "https://a.com/q"))]
    table = spark.createDataFrame(site, "url string, text string")
    found = sitemaps.follow(table, spark.createDataFrame([("https://a.com/i.xml",)], "url string"))
    assert got(found, "url", "depth", "state") == sorted([("https://a.com/i.xml", 0, "index"), ("https://a.com/s.xml", 1, "urlset"), ("https://a.com/j.xml", 1, "index"), ("https://a.com/no.xml", 2, "missing"), ("https://a.com/p?a=1&b=2", 2, "page")], key=repr)
    assert sitemaps.follow(table, spark.createDataFrame([], "url string")).count() == 0


def test_tracker_without_key_or_counts(spark):
    snap = {"questions": [{"question": "Best?" * 20, "theme": "t", "provider": "OpenAI", "cited": True, "competitors_cited": ["X"], "cited_urls": ["https://a.com"]}, {"question": "q"}], "visibility": {"answers_measured": 0}, "by_provider": [{"slug": "OpenAI", "answers_measured": 10, "answers_with_mention": 4}, {"slug": "none"}]}
    found = answers.tracker_snapshots(spark.createDataFrame([("s", json.dumps(snap))], "site string, text string"))
    assert got(answers.tracker_counts(found)) == [("s", "engine", "openai", 10, 4)]
    one, two = sorted(answers.tracker_answers(found, "Me").collect(), key=lambda r: r.prompt)
    assert (one.prompt_id, one.engine, one.cited, one.brands) == (("Best?" * 20)[:60], "openai", True, ["Me", "X"]) and (two.cited, two.brands, two.sources) == (False, [], [])
    with pytest.raises(Exception, match="no key"):
        answers.tracker_snapshots(spark.createDataFrame([('{"state": "no_key"}',)], "text string")).collect()


def test_store_is_written_once(spark, tmp_path):
    rows = lambda *keys: spark.createDataFrame([(p, e, r, f"{p}{e}{r}") for p, e, r in keys], "prompt_id string, engine string, run int, text string")
    path = str(tmp_path / "answers")
    assert surveys.kept_answers(spark, path) is None
    assert surveys.keep_answers(rows(("a", "x", 1), ("a", "y", 1), ("a", "x", 1)), path) == 2
    broken = tmp_path / "answers" / "batch=0" / "engine=x"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")  # of a write that never ended
    assert surveys.keep_answers(rows(("a", "x", 1), ("b", "x", 1), ("a", "x", 2)), path) == 2
    assert surveys.keep_answers(rows(("a", "x", 1), ("b", "x", 1), ("a", "x", 2)), path) == 0
    assert got(surveys.kept_answers(spark, path), "prompt_id", "engine", "run", "text") == [("a", "x", 1, "ax1"), ("a", "x", 2, "ax2"), ("a", "y", 1, "ay1"), ("b", "x", 1, "bx1")]
    plan = rows(("a", "x", 1), ("c", "x", 1)).drop("text")
    assert got(surveys.unanswered(plan, surveys.kept_answers(spark, path))) == [("c", "x", 1)]


def test_findings_and_their_lines_are_ordered(spark):
    issues = spark.createDataFrame([(f"u{i}", "title_lost", "high") for i in range(5)] + [("u1", "h1_changed", "low")] + [(f"u{i}", f"k{i}", "medium") for i in range(9)], "url string, issue string, severity string")
    top = findings.ranked([findings.of_pages(issues)]).orderBy("rank").collect()
    assert [(r.type, r.n, r.examples) for r in top[:2]] == [("title_lost", 5, ["u0", "u1", "u2"]), ("k0", 1, ["u0"])] and len(top) == 6
    checks = spark.createDataFrame([("a", "odd", "new", 2), ("b", "low", "llms", 9)], "host string, severity string, type string, count int")
    assert [r.type for r in findings.ranked([findings.of_access(checks)]).orderBy("rank").collect()] == ["llms", "new"]
    numbers = spark.range(500).select(F.col("id"), (-F.col("id")).alias("v"), F.lit(None).cast("string").alias("none"))
    lines = findings.report_lines([("n", numbers, ["v"]), ("m", numbers.limit(1), ["v"])]).orderBy("section", "at").collect()
    assert [json.loads(r.json)["id"] for r in lines[:500]] == list(range(499, -1, -1)) and (lines[500].name, json.loads(lines[500].json)["none"]) == ("m", None)


ROBOTS = """Disallow: /early
Content-Signal: ai-train=no
User-agent: Googlebot
User-agent: OAI-SearchBot
User-agent: PerplexityBot
User-agent: ChatGPT-User
User-agent: Google-Extended
Disallow: /

User-agent: *
Disallow: /private
"""
LLMS = """intro before the title
# Shop
# Again
- [Secret](https://shop.example/private/x): closed to those who may come
- [Elsewhere](https://other.example/a)
- [Cart](/checkout/)
- [Twice](/t)
* [Twice](/t)
- [no link] (x)
- [](empty)
"""


def test_every_check_of_access_fires(spark):
    hosts = spark.createDataFrame([("shop.example", ROBOTS), ("calm.example", "User-agent: *\nDisallow:\n")], "host string, text string")
    paths = hosts.select("host").crossJoin(spark.createDataFrame([("/",), ("/a",), ("/private/x",), *((x,) for x in access._SHOP)], "path string"))
    rules = access.robots_rules(hosts)
    llms = spark.createDataFrame([("shop.example", LLMS)], "host string, text string")
    found = access.audit(access.access(paths, rules, access.TOKENS), rules, hosts, llms, shop=True)
    of = lambda host: {r.type: (r.severity, r["count"]) for r in found.where(F.col("host") == host).collect()}
    shop, calm = of("shop.example"), of("calm.example")
    high = {t for t, (s, _) in shop.items() if s == "high"}
    assert high == {"search_engine_blocked", "chatgpt_search_blocked", "llms_offhost", "llms_contradiction"}
    assert {"answer_engine_blocked", "search_paths_refused", "user_fetcher_rule", "google_extended_scope", "transactional_open", "rules_outside_group", "content_signal", "llms_format", "llms_transactional", "llms_duplicates"} <= set(shop)
    assert (shop["llms_contradiction"][1], shop["llms_offhost"][1], shop["rules_outside_group"][1], shop["llms_transactional"][1], shop["llms_duplicates"][1]) == (1, 1, 1, 1, 1)
    assert set(calm) == {"transactional_open", "llms_absent"}
    long = spark.createDataFrame([("calm.example", "# T\n> s\n## P\n" + "".join(f"- [p{i}](/p{i})\n" for i in range(61)))], "host string, text string")
    again = access.audit(access.access(paths, rules, access.TOKENS), rules, hosts, long)
    assert [r["count"] for r in again.where("type = 'llms_too_long' and host = 'calm.example'").collect()] == [61]


def test_links_of_llms_files(spark):
    lines = access.llms_lines(spark.createDataFrame([("a", LLMS + "- [A](/x): note: more\n + [B](/y) tail\n- [C]( /z)\n* [D](/d):\n")], "host string, text string"))
    links = [(r.title, r.url, r.note) for r in lines.where("kind = 'link'").orderBy("pos").collect()]
    assert links[:2] == [("Secret", "https://shop.example/private/x", "closed to those who may come"), ("Elsewhere", "https://other.example/a", "")]
    assert links[5:] == [("A", "/x", "note: more"), ("D", "/d", "")]


def test_every_issue_between_snapshots(spark):
    columns = "url string, title string, description string, robots string, canonical string, h1 string, schema_types array<string>, hreflang array<string>, noindex boolean, status int, og_title string, plugins array<string>"
    row = lambda url, **x: tuple({"url": url, "title": "T", "description": "D", "robots": "", "canonical": f"https://a.com/{url}", "h1": "H", "schema_types": ["Article"], "hreflang": ["fr"], "noindex": False, "status": 200, "og_title": "O", "plugins": ["yoast"], **x}.values())
    changes = {
        "became_noindex": ({}, {"noindex": True}, "high"), "became_index": ({"noindex": True}, {}, "medium"), "canonical_lost": ({}, {"canonical": ""}, "high"), "canonical_changed": ({}, {"canonical": "https://a.com/else"}, "medium"),
        "description_lost": ({}, {"description": ""}, "high"), "description_changed": ({}, {"description": "E"}, "low"), "title_lost": ({}, {"title": ""}, "medium"), "title_changed": ({}, {"title": "U"}, "low"), "h1_changed": ({}, {"h1": "I"}, "low"),
        "schema_lost": ({}, {"schema_types": []}, "medium"), "hreflang_lost": ({}, {"hreflang": []}, "high"), "open_graph_lost": ({}, {"og_title": ""}, "low"), "two_plugins": ({}, {"plugins": ["yoast", "rankmath"]}, "high"), "status_changed": ({}, {"status": 404, "title": ""}, "high"),
    }
    before = spark.createDataFrame([row(k, **b) for k, (b, _, _) in changes.items()] + [row("same"), row("not_in_after"), row("far")], columns)
    after = spark.createDataFrame([row(k, **a) for k, (_, a, _) in changes.items()] + [row("same"), row("far", canonical="https://b.com/far"), row("new")], columns)
    issues = pages.diff(before, after)
    assert got(issues, "url", "issue", "severity") == sorted([*((k, k, s) for k, (_, _, s) in changes.items()), ("not_in_after", "not_in_after", "medium"), ("far", "canonical_changed", "high")], key=repr)
    (s,) = pages.summary(before, after, issues).collect()
    assert (s.pages, s.identical) == (17, 1)


def test_brands_and_prompts_need_their_fields(spark):
    assert got(exports.brand(files(spark, b='{"name": "Me", "domains": ["me.com"]}'))) == [("b", "Me", [], ["me.com"])]
    with pytest.raises(Exception, match="b: a brand needs a name"):
        exports.brand(files(spark, b='{"domains": []}')).collect()
    assert got(exports.prompts(files(spark, p="prompt_id,prompt\np1,One?\np2,Two?\n"))) == [("p1", "One?", ""), ("p2", "Two?", "")]
    with pytest.raises(Exception, match="p needs the columns"):
        exports.prompts(files(spark, p="id,prompt\n1,x\n")).collect()
    plan = surveys.survey_plan(exports.prompts(files(spark, p="prompt_id,prompt\np1,One?\n")), ["x", "y"], 2)
    assert got(plan, "prompt_id", "engine", "run") == [("p1", "x", 1), ("p1", "x", 2), ("p1", "y", 1), ("p1", "y", 2)]


def test_pages_that_are_too_little_stop(spark):
    rows = spark.createDataFrame([("a", 100), ("a", 50), ("b", 100), ("b", 49), ("c", 900)], "page string, words long")
    assert got(passages.stopped(rows, "page")) == [("b", 2, 149), ("c", 1, 900)]
