"""Access logs: combined and vhost lines, JSON lines and delimited rows, as log_record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import block_bounds, first_address
from ..functions.web import _first

FIELDS = ["ip", "ts", "method", "url", "status", "bytes", "agent", "rt_ms"]

#: Names of the fields in JSON lines and delimited headers, the first non-empty one counts.
ALIASES = {
    "ip": ["ip", "clientip", "client_ip", "remote_addr", "remote_ip", "c-ip", "ClientIP", "host"],
    "ts": ["time", "timestamp", "@timestamp", "ts", "datetime", "date", "time_local", "EdgeStartTimestamp"],
    "method": ["method", "request_method", "verb", "cs-method", "ClientRequestMethod"],
    "url": ["url", "uri", "path", "request_uri", "request", "cs-uri-stem", "ClientRequestURI"],
    "status": ["status", "status_code", "code", "response", "sc-status", "EdgeResponseStatus"],
    "bytes": ["bytes", "size", "body_bytes_sent", "bytes_sent", "sc-bytes", "EdgeResponseBytes"],
    "agent": ["user_agent", "useragent", "agent", "ua", "http_user_agent", "cs(User-Agent)", "ClientRequestUserAgent"],
    "rt": ["request_time", "response_time", "duration", "time_taken", "rt", "upstream_response_time"],
}

#: Names of the columns in the header line of a delimited log; the leftmost column that has one of them counts.
HEADERS = {
    "ip": ["ip", "client_ip", "clientip", "remote_addr", "remote_host", "host_ip", "adresse_ip", "visitor_ip"],
    "agent": ["user_agent", "useragent", "ua", "agent", "http_user_agent", "navigateur"],
    "url": ["url", "uri", "path", "request", "request_uri", "page", "chemin"],
    "status": ["status", "code", "status_code", "http_code", "response_code", "statut"],
    "ts": ["date", "time", "datetime", "timestamp", "time_local", "date_heure"],
    "bytes": ["bytes", "size", "bytes_sent", "taille"],
    "rt": ["response_time", "request_time", "duration", "time_taken", "temps"],
}
SEPARATORS = ["\t", ";", ",", "|"]


def apache_time(text: Column) -> Column:
    """Time of the brackets; the offset is left out, not applied."""
    return F.try_to_timestamp(F.regexp_extract(text, r"\[(\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2})", 1), F.lit("d/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz")


def any_time(text: Column) -> Column:
    """ISO, epoch in s, ms, us or ns (by which of them falls into this century), or the time of the brackets."""
    n = F.when(text.rlike(r"^\d{9,20}(\.\d+)?$"), text.try_cast("double"))
    century = lambda s: (s >= 946684800) & (s < 4102444800)
    epoch = _first([(century(n / k), F.timestamp_micros((n / k * 1e6).cast("long"))) for k in (1.0, 1e3, 1e6, 1e9)], F.lit(None).cast("timestamp"))
    iso = F.regexp_replace(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1), "T", " ").try_cast("timestamp_ntz")
    return F.coalesce(epoch.cast("timestamp_ntz"), iso, apache_time(F.concat(F.lit("["), F.regexp_replace(text, r"^\[", ""))))


def duration_ms(tail: Column) -> Column:
    """First token after the last quoted field that is a time: a decimal up to 900 is seconds, a whole number over 1000 microseconds."""
    tokens = F.filter(F.split(F.trim(tail), r"\s+"), lambda t: t.rlike(r"^\d+(?:\.\d+)?$"))
    first = F.get(tokens, F.lit(0))
    v = first.try_cast("double")
    return F.when(first.contains("."), F.when(v <= 900, v * 1000)).when(v > 1000, v / 1000)


#: A line: the last address before the time, time, request, status, size, referer, agent, what follows.
_COMBINED = r'^(?:.*\s)?((?:\d{1,3}\.){3}\d{1,3}|\[?[0-9a-fA-F]*:[0-9a-fA-F:.]+\]?)\s[^\[]*(\[\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2})(?:\s*[+-]\d{4})?\]\s*"((?:[^"\\]|\\.)*)"\s+(\d{3})\s+(\d+|-)(?:\s+"((?:[^"\\]|\\.)*)"\s+"((?:[^"\\]|\\.)*)")?(.*)$'


def once(name: str, value: Column) -> Column:
    """A column that is computed once for each row: a generator, which the optimiser doesn't copy into what reads it."""
    return F.explode(F.array(value)).alias(name)


def spread(lines: DataFrame) -> DataFrame:
    """Lines dealt evenly over the cluster's cores, where the input has fewer splits (one file of a codec that can't be split)."""
    n = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(n) if lines.rdd.getNumPartitions() < n else lines


def parse_combined(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of the combined format (host names before, durations after are fine). parsed is false where a line is malformed.

    One expression cuts a line into its parts, once; everything else reads the parts."""
    marked = F.regexp_replace(line, _COMBINED, "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$7\x01$8")
    part = lambda i: F.get("parts_", F.lit(i))
    found = lines.select("*", once("parts_", F.split(marked, "\x01")))
    found = found.select("*", once("ip", first_address("get(parts_, 0)")))
    return found.withColumns(
        {
            "ts": apache_time(part(1)),
            "method": F.nullif(F.regexp_extract(part(2), r"^([A-Z]+)\s", 1), F.lit("")),
            "url": F.nullif(F.regexp_extract(part(2), r"^[A-Z]+\s+(\S+)", 1), F.lit("")),
            "status": part(3).try_cast("int"),
            "bytes": F.coalesce(part(4).try_cast("long"), F.lit(0).cast("long")),
            "agent": part(6),
            "rt_ms": duration_ms(part(7)),
            "parsed": F.coalesce((F.size("parts_") == 8) & F.col("ip").isNotNull() & apache_time(part(1)).isNotNull(), F.lit(False)),
        }
    ).drop("parts_")


def parse_json(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON lines by the aliases; a duration over 50 is milliseconds, else seconds. A line is parsed once, and each field is sought once."""

    def sought(field: str) -> Column:
        return F.coalesce(*(F.nullif(F.try_variant_get("v_", f"$['{a}']", "string"), F.lit("")) for a in ALIASES[field]))

    def pick(field: str) -> Column:
        return F.col("picked_")[field]

    lines = lines.select("*", once("v_", F.try_parse_json(line)))
    lines = lines.select("*", once("picked_", F.struct(*(sought(f).alias(f) for f in ALIASES)))).drop("v_")
    rt = pick("rt").try_cast("double")
    url = F.regexp_replace(pick("url"), r"^[A-Z]+ (\S+)( HTTP/.*)?$", "$1")
    found = lines.withColumn("raw_ip_", pick("ip")).withColumns({"ip": first_address("raw_ip_"), "ts": any_time(pick("ts")), "method": pick("method"), "url": url, "status": pick("status").try_cast("int"), "bytes": F.coalesce(pick("bytes").try_cast("long"), F.lit(0).cast("long")), "agent": pick("agent"), "rt_ms": F.when(rt > 50, rt).otherwise(rt * 1000)})
    return found.drop("raw_ip_", "picked_").withColumn("parsed", F.col("ip").isNotNull() & F.col("ts").isNotNull() & F.col("url").isNotNull())


def parse_delimited(lines: DataFrame, header: str, line: str = "line") -> DataFrame:
    """Rows of a delimited log under a header line; fields are split naively, quotes mean nothing."""
    sep = max("\t;,|", key=header.count)
    names = [h.strip().strip('"').lower() for h in header.split(sep)]
    parts = F.split(F.col(line), {"|": r"\|", "\t": "\t"}.get(sep, sep))

    def pick(field: str) -> Column:
        at = [names.index(a.lower()) for a in ALIASES[field] if a.lower() in names]
        return F.coalesce(*(F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i in at), F.lit(None).cast("string"))

    rt = pick("rt").try_cast("double")
    found = lines.where(F.col(line) != header).withColumn("raw_ip_", pick("ip")).withColumns({"ip": first_address("raw_ip_"), "ts": any_time(pick("ts")), "method": pick("method"), "url": pick("url"), "status": pick("status").try_cast("int"), "bytes": F.coalesce(pick("bytes").try_cast("long"), F.lit(0).cast("long")), "agent": pick("agent"), "rt_ms": F.when(rt > 50, rt).otherwise(rt * 1000)})
    return found.drop("raw_ip_").withColumn("parsed", F.col("ip").isNotNull() & F.col("ts").isNotNull() & F.col("url").isNotNull())


def split_fields(line: Column, sep: Column) -> Column:
    """The fields of a delimited line, naively: quotes around a field go, quotes mean nothing else."""
    return F.transform(F.split(line, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))


def header_of(first: Column) -> Column:
    """What a file's first line says about its columns: struct (n, order, sep, at), at a map of field to place; null where it is no header.

    Every separator is tried; it needs an address, an agent and a URL, and the one that names most fields wins."""

    def read(order: int, sep: str) -> Column:
        names = F.transform(split_fields(first, F.lit(sep)), lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("_")))

        def place(names: Column, known: list[str]) -> Column:
            return F.array_min(F.transform(names, lambda x, i: F.when(x.isin(known), i)))

        at = F.map_filter(F.create_map(*(x for f, known in HEADERS.items() for x in (F.lit(f), place(names, known)))), lambda f, i: i.isNotNull())
        good = (F.size(names) >= 3) & at["ip"].isNotNull() & at["agent"].isNotNull() & at["url"].isNotNull()
        return F.when(good, F.struct(F.size(at).alias("n"), F.lit(-order).alias("order"), F.lit(sep).alias("sep"), F.map_entries(at).alias("at")))

    best = F.array_max(F.array(*(read(i, sep) for i, sep in enumerate(SEPARATORS))))
    return F.when(best.isNotNull(), F.struct(best["sep"].alias("sep"), F.map_from_entries(best["at"]).alias("at")))


def file_headers(lines: DataFrame) -> DataFrame:
    """(file, head) of the files of (file, start, at, line) whose first line is the header of a delimited log."""
    first = lines.where((F.col("start") == 0) & (F.col("at") == 0) & ~F.ltrim("line").startswith("{") & ~F.col("line").rlike(r"\[\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}"))
    return first.select("file", once("head", header_of(F.col("line")))).where("head is not null")


def parse_headed(lines: DataFrame, line: str = "line", head: str = "head") -> DataFrame:
    """Rows of delimited logs, each by its own file's header (see header_of)."""
    fields = F.col("fields_")
    get = lambda f: F.get(fields, F.col(head)["at"][f])
    digits = lambda f, kind: F.coalesce(F.when(get(f).rlike(r"^\d+$"), get(f).try_cast(kind)), F.lit(0).cast(kind))
    found = lines.select("*", once("fields_", split_fields(F.col(line), F.col(head)["sep"])))
    found = found.withColumn("raw_ip_", get("ip"))
    found = found.withColumns({"ip": first_address("raw_ip_"), "ts": any_time(get("ts")), "method": F.lit(""), "url": get("url"), "status": digits("status", "int"), "bytes": digits("bytes", "long"), "agent": get("agent"), "rt_ms": duration_ms(get("rt"))})
    good = F.col("ip").isNotNull() & F.col("ts").isNotNull() & F.col("url").isNotNull() & F.col("agent").isNotNull()
    return found.drop("raw_ip_", "fields_").withColumn("parsed", good)


def parse_logs(lines: DataFrame) -> DataFrame:
    """Log records of files of any format, as packed_lines gives them: format (json, csv or combined, told line by line and, for csv, by the file's header) and the fields.

    Headers are found in a pass of their own and joined back by file; then each line goes through the one parser that it
    needs, in one pass. Blank lines and header lines are no records."""
    heads = file_headers(lines)
    rows = lines.where(F.trim("line") != "").join(heads, "file", "left")
    rows = rows.where(F.col("head").isNull() | (F.col("start") > 0) | (F.col("at") > 0))
    kind = F.when(F.ltrim("line").startswith("{"), "json").when(F.col("head").isNotNull(), "csv").otherwise("combined")
    rows = rows.withColumn("format", kind)
    for name, parse in (("json", parse_json), ("csv", parse_headed), ("combined", parse_combined)):
        own = parse(rows.withColumn("own_", F.when(F.col("format") == name, F.col("line"))), "own_")
        rows = own.select(*rows.columns, F.struct(*FIELDS, "parsed").alias(f"{name}_"))
    record = F.when(F.col("format") == "json", F.col("json_")).when(F.col("format") == "csv", F.col("csv_")).otherwise(F.col("combined_"))
    return rows.select("file", "start", "at", "line", "format", once("r", record)).select("file", "start", "at", "line", "format", "r.*")


def read_blocks(ranges: DataFrame, name: str = "provider") -> DataFrame:
    """(ranges, lo, hi) from rows of (name, cidr); what is no block is left out."""
    return ranges.select(F.col(name).alias("ranges"), block_bounds("cidr").alias("b")).where("b is not null").select("ranges", "b.lo", "b.hi").distinct()
