"""The rules of crawler forensics on lines of our own."""

from pyspark.sql import functions as F

from beaconlake.functions import net, stats, text, web
from beaconlake.operators import logs
from beaconlake.sources.logs import parse_combined, read_blocks
from beaconlake.sources.sitemaps import listed
from beaconlake.sources.variants import harvest_ranges

BOT = "Mozilla/5.0 (compatible; GPTBot/1.2)"
LINES = [
    f'10.0.0.1 - - [02/Jan/2024:10:00:00 +0100] "GET /a?x=1 HTTP/1.1" 200 12 "-" "{BOT}" 0.250',
    f'www.example.com:443 10.9.0.1 - - [02/Jan/2024:10:00:01 +0100] "GET /b HTTP/1.1" 301 - "-" "{BOT}"',
    f'10.9.0.2 - - [02/Jan/2024:10:00:02 +0100] "GET /wp-login.php HTTP/1.1" 404 5 "-" "{BOT}"',
    '10.9.0.3 - - [02/Jan/2024:10:00:03 +0100] "GET / HTTP/1.1" 200 5 "-" "Mozilla/5.0 Firefox/126.0"',
    "no line at all",
    "",
    f'2001:db8:1::9 - - [02/Jan/2024:10:00:04 +0100] "GET /c HTTP/1.1" 200 7 "-" "{BOT}"',
    f'2001:db8:8000::9 - - [02/Jan/2024:10:00:05 +0100] "GET /d HTTP/1.1" 200 7 "-" "{BOT}"',
]


def test_verdicts(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    parsed = parse_combined(lines)
    assert [r.parsed for r in parsed.orderBy("i").collect()] == [True] * 4 + [False] * 2 + [True] * 2
    cidr = read_blocks(spark.createDataFrame([("openai", "10.0.0.0/16"), ("openai", "no block"), ("openai", "2001:db8::/33")], "provider string, cidr string"))
    v = logs.verify(logs.classify(parsed.where("parsed")), cidr)
    assert {r.i: r.verdict for r in v.collect()} == {0: "verified", 1: "unverifiable", 2: "spoofed", 6: "verified", 7: "unverifiable"}
    (b,) = logs.bot_buckets(v).collect()
    assert (b.claimed, b.verified, b.spoofed, b.unverifiable, b.bytes, b.ips) == (5, 2, 1, 2, 26, 4)


def test_names_verify_addresses(spark):
    hits = spark.createDataFrame([("10.0.0.1", "google"), ("10.0.0.2", "google"), ("10.0.0.3", "google"), ("10.0.0.4", "google")], "ip string, ranges string")
    dns = spark.createDataFrame([("10.0.0.1", "a.googlebot.com", ["10.0.0.1"]), ("10.0.0.2", "evil.example", ["10.0.0.2"]), ("10.0.0.3", "b.googlebot.com", ["10.0.0.9"]), ("10.0.0.4", None, None)], "ip string, ptr string, forward array<string>")
    got = {r.ip[-1]: r.dns_verdict for r in logs.dns_verdict(hits, dns).collect()}
    assert got == {"1": "verified", "2": "spoofed", "3": "spoofed", "4": "unverifiable"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_functions(spark):
    lit = F.lit
    assert one(spark, web.normalise_url(lit("https://a.com/b/#c"))) == "/b"
    assert one(spark, web.section_of(lit("/blog/x"))) == "/blog/"
    assert one(spark, web.host_of(lit("https://www.A.com:80/x"))) == "a.com"
    kinds = {"/en/en/x": "doubled_segment", "/WP-LOGIN.php": "probe", "/.env.bak": "probe", "/old/page.php5": "suspicious", "/wp-content/uploads/a.zip": "page", "/a/b.JPG": "asset", "/a/b": "page"}
    paths = spark.createDataFrame([(k,) for k in kinds], "p string")
    assert {r.p: r.kind for r in paths.select("p", web.classify_missing("p").alias("kind")).collect()} == kinds
    hosts = {"me.com": "own", "x.me.com": "own", "old.reddit.com": "ugc", "forum.a.org": "ugc", "forums.b.co.uk": "ugc", "forum-x.fr": "ugc", "fr.wikipedia.org": "reference", "amazon.co.uk": "editorial", "amazon.de": "reviews", "impots.gouv.fr": "public", "nasa.gov": "public", "www.gov.uk": "public", "xreddit.com": "editorial"}
    table = spark.createDataFrame([(k,) for k in hosts], "d string")
    assert {r.d: r.kind for r in table.select("d", web.source_type(F.col("d"), "me.com").alias("kind")).collect()} == hosts | {"amazon.co.uk": "editorial"}
    assert one(spark, text.number(lit("1 234,5"))) == 1234.5
    import ipaddress

    for x in ("::1", "2001:DB8::ff00:42:8329", "::ffff:10.1.2.3", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "0.0.0.0", "255.255.255.255"):
        a = ipaddress.ip_address(x.split("%")[0])
        assert one(spark, net.address_key(f"\'{x}\'")) == f"{a.version}{int(a):032x}", x
    for x in (":", ":::", "1:2:3", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7:8:9"):
        assert one(spark, net.ipv6_digits(f"\'{x}\'")) is None, x
    for x, want in (("unknown, [2001:db8::1]:443, 10.0.0.1", "2001:db8::1"), ("10.0.0.1:8080", "10.0.0.1"), ("300.1.1.1", None), (" 10.0.0.7 , x", "10.0.0.7")):
        assert one(spark, net.first_address(f"\'{x}\'")) == want
    for x in ("10.0.0.0/8", "10.1.128.0/17", "192.0.2.77/32", "0.0.0.0/0", "2001:db8::/33", "2600:1f00::/26", "::/0", "10.1.2.3/30"):
        n = ipaddress.ip_network(x, strict=False)
        b = one(spark, net.block_bounds(f"\'{x}\'"))
        assert (b.lo, b.hi) == (f"{n.version}{int(n[0]):032x}", f"{n.version}{int(n[-1]):032x}"), x
    assert one(spark, net.block_bounds("'10.0.0.0/40'")) is None
    low, high = stats.wilson(lit(54), lit(180))
    assert (round(one(spark, low), 3), round(one(spark, high), 3)) == (0.238, 0.371)
    assert one(spark, stats.upper_median(F.array(*map(lit, range(10))))) == 5


def test_ranges_and_sitemaps(spark):
    payload = spark.createDataFrame([("p", '{"prefixes": [{"ipv4Prefix": "10.0.0.0/8"}, {"ipv6Prefix": "2001:db8::/32"}]}')], "provider string, json string")
    assert sorted(r.cidr for r in harvest_ranges(payload).collect()) == ["10.0.0.0/8", "2001:db8::/32"]
    files = spark.createDataFrame([("s", "<urlset><url><loc>https://a.com/x?a=1&amp;b=2</loc></url></urlset>"), ("t", "https://a.com/y\nno\n")], "url string, text string")
    assert sorted((r.sitemap, r.loc) for r in listed(files).collect()) == [("s", "https://a.com/x?a=1&b=2"), ("t", "https://a.com/y")]
