"""Results as files: lines in the formats of redirect plugins and servers, policies, CSV and JSON.

Functions return the lines of a file as (at, line), to be written in order; ``write_lines`` writes them as one file."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import web as W
from .sources.packed import file_system

FORMATS = ["redirection", "yoast", "rankmath", "seopress", "generic", "htaccess", "nginx"]
#: Header lines, as the importers of each format expect them.
HEADERS = {
    "redirection": ["source,target,regex,code,type"],
    "yoast": ["Origin,Target,Type,Format"],
    "rankmath": ["id,source,matching,destination,type,category,status,ignore"],
    "seopress": [],
    "generic": ["source,target,code"],
    "htaccess": ["<IfModule mod_alias.c>"],
    "nginx": [],
}
_ENDINGS = {"htaccess": ["</IfModule>"]}


def csv_field(x: Column) -> Column:
    """A field of a CSV line: in quotes where it needs them; null is empty."""
    x = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_line(*fields: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, fields))


def regex_escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"([.+*?^${}()|\[\]\\#& ~])", r"\\$1")


def nginx_quoted(x: Column) -> Column:
    return F.when(x.rlike(r"[\s;{}'\"]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(x)


def exported(redirects: DataFrame, include_review: bool = False) -> DataFrame:
    """Rows of a map that are written: no manual and kept ones, reviews only if asked for and with a target."""
    wanted = ["redirect", "gone", *(["review"] if include_review else [])]
    return redirects.where(F.col("decision").isin(wanted) & ~((F.col("decision") == "review") & (F.coalesce("target", F.lit("")) == "")))


def redirect_lines(redirects: DataFrame, form: str, patterns: DataFrame | None = None, host: str = "", include_review: bool = False) -> DataFrame:
    """(at, line) of a redirect map (source, target, code, decision) in one of FORMATS.

    patterns: regex, replacement. Gone pages have no target; formats whose empty source would match everything leave the
    home page out; seopress needs absolute targets, so a host; sources with a query can't be written for servers and
    become comments."""
    if form not in FORMATS:
        raise ValueError(f"form must be one of {FORMATS}")
    if form == "seopress" and not host:
        raise ValueError("seopress needs absolute targets: give a host")
    query = W.query_of(F.col("source"))
    path = W.decoded_path(F.col("source"))
    rows = exported(redirects, include_review).withColumns({"src": F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), "to": F.coalesce("target", F.lit("")), "c": F.col("code").cast("string")})
    if form in ("rankmath", "seopress"):
        rows = rows.where(W.path_key(path) != "/")
    src, to, code = F.col("src"), F.col("to"), F.col("c")
    gone = code.isin("410", "451")
    kept = F.when(gone, "").otherwise(to)
    trimmed = F.regexp_replace(src, "/+$", "")
    base = F.when(trimmed == "", "/").otherwise(trimmed)
    absolute = F.when(to.startswith("/"), F.concat(F.lit(host.rstrip("/")), to)).otherwise(to)
    anchored = F.concat(F.lit("^"), regex_escaped(base), F.when(base == "/", "$").otherwise("/?$"))
    asks = src.contains("?")
    one = lambda *lines: F.array(*lines)
    lines = {
        "redirection": one(csv_line(src, kept, F.lit(0), code, F.when(gone, "error").otherwise("url"))),
        "yoast": one(csv_line(src, kept, code, F.lit("plain"))),
        "rankmath": one(csv_line(F.lit(""), F.regexp_replace(src, "^/+|/+$", ""), F.lit("exact"), to, code, F.lit(""), F.lit("active"), F.lit(""))),
        "seopress": one(csv_line(F.regexp_replace(src, "^/+", ""), F.when(gone, "").otherwise(absolute), code, F.lit("yes"), F.lit("exact_match"), F.lit(""), F.lit(""), F.lit(""), F.lit("both"))),
        "generic": one(csv_line(src, to, code)),
        "htaccess": one(F.when(asks, F.concat(F.lit("# needs a condition on the query, left out: "), src)).when(gone, F.concat(F.lit("RedirectMatch 410 "), anchored)).otherwise(F.concat_ws(" ", F.lit("RedirectMatch"), code, anchored, to))),
        "nginx": F.when(asks, one(F.concat(F.lit("# a source with a query: "), src))).when(gone, one(F.concat(F.lit("#   "), src))).otherwise(F.array_compact(one(F.concat(nginx_quoted(base), F.lit(" "), nginx_quoted(to), F.lit(";")), F.when(base != "/", F.concat(nginx_quoted(F.concat(base, F.lit("/"))), F.lit(" "), nginx_quoted(to), F.lit(";")))))),
    }[form]
    rank = F.when(gone & ~asks, 4).otherwise(1) if form == "nginx" else F.lit(1)
    body = rows.select(rank.alias("part"), "src", F.posexplode(lines).alias("k", "line")).select(F.struct("part", "src", "k").alias("at"), "line")
    spark = redirects.sparkSession
    fixed = [(0, x) for x in HEADERS[form]] + [(5, x) for x in _ENDINGS.get(form, [])] + ([(3, "# 410 candidates (location = /path { return 410; }):")] if form == "nginx" else [])
    parts = [body]
    if fixed:
        parts.append(spark.createDataFrame(fixed, "part int, line string").select(F.struct("part", F.lit("").alias("src"), F.lit(0).alias("k")).alias("at"), "line"))
    if patterns is not None and form not in ("rankmath", "seopress"):
        rx, new = F.col("regex"), F.col("replacement")
        line = {
            "redirection": csv_line(rx, new, F.lit(1), F.lit(301), F.lit("url")), "yoast": csv_line(rx, new, F.lit(301), F.lit("regex")), "generic": csv_line(rx, new, F.lit(301)),
            "htaccess": F.concat_ws(" ", F.lit("RedirectMatch 301"), rx, new), "nginx": F.concat(F.lit("~"), nginx_quoted(rx), F.lit(" "), nginx_quoted(new), F.lit(";")),
        }[form]
        parts.append(patterns.where("regex <> ''").select(F.struct(F.lit(2).alias("part"), rx.alias("src"), F.lit(0).alias("k")).alias("at"), line.alias("line")))
    return reduce(DataFrame.unionByName, parts)


def map_lines(redirects: DataFrame) -> DataFrame:
    """A redirect map as CSV of eight columns, in the order of review."""
    from .operators.redirects import ORDER

    columns = ["source", "target", "code", "method", "confidence", "decision", "value", "note"]
    c = lambda x: F.col(x) if x in redirects.columns else F.lit("")
    value = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    fields = {"confidence": F.format_string("%.2f", c("confidence").cast("double")), "value": value}
    body = redirects.select(F.struct(F.array_position(F.array(*map(F.lit, ORDER)), F.col("decision")).cast("int").alias("a"), (-F.col("value")).alias("b"), F.col("source").alias("c")).alias("at"), csv_line(*(fields.get(x, c(x)) for x in columns)).alias("line"))
    head = redirects.sparkSession.createDataFrame([(",".join(columns),)], "line string").select(F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("b"), F.lit("").alias("c")).alias("at"), "line")
    return head.unionByName(body)


def series_lines(series: DataFrame) -> DataFrame:
    """A series (d, v) as date,value CSV."""
    body = series.select(F.struct(F.lit(1).alias("part"), F.col("d").cast("string").alias("d")).alias("at"), csv_line(F.col("d"), F.regexp_replace(F.col("v").cast("string"), r"\.0$", "")).alias("line"))
    return series.sparkSession.createDataFrame([("date,value",)], "line string").select(F.struct(F.lit(0).alias("part"), F.lit("").alias("d")).alias("at"), "line").unionByName(body)


def packed_files(lines: DataFrame, path: str, packing: str, header: str | None = None, member_bytes: int = 4 << 20, line: str = "line") -> DataFrame:
    """(file, lines) of the files written: one for each partition that has rows, without extension, under a header line if there is one.

    packing: plain, gzip, bzip2 or xz. gzip begins a member every ``member_bytes`` of text, so that ranges of it can be
    read apart. A task writes under a name of its own and renames at the end, so a repeated task replaces its file."""
    if packing not in ("plain", "gzip", "bzip2", "xz"):
        raise ValueError(f"no such packing: {packing}")

    def write(batches):
        import bz2
        import lzma
        import zlib

        make = {"plain": None, "gzip": lambda: zlib.compressobj(6, zlib.DEFLATED, 31), "bzip2": bz2.BZ2Compressor, "xz": lzma.LZMACompressor}[packing]
        context = TaskContext.get()
        fs, base = file_system(path)
        name = f"{base}/{packing}-{context.partitionId():06d}"
        draft, sink, packer, size, n = f"{base}/_{packing}-{context.partitionId():06d}-{context.taskAttemptId()}", None, None, 0, 0
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.column(0).slice(i, 4096).to_pylist()
                if sink is None:
                    fs.create_dir(base, recursive=True)
                    sink, packer = fs.open_output_stream(draft), make and make()
                    part[:0] = [] if header is None else [header]
                    n -= header is not None
                data = "".join(f"{x or ''}\n" for x in part).encode("utf-8", "surrogatepass")
                n, size = n + len(part), size + len(data)
                sink.write(packer.compress(data) if packer else data)
                if packing == "gzip" and size >= member_bytes:
                    sink.write(packer.flush())
                    packer, size = make(), 0
        if sink is not None:
            sink.write(packer.flush() if packer else b"")
            sink.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "lines"])

    return lines.select(line).mapInArrow(write, "file string, lines long")
