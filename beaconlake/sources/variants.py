"""JSON of any depth as rows: a walk level by level over VARIANT, and what is read from it.

The frontier of a level is exploded into the next one, all documents at once, until nothing is left; a level is written
before it is read twice. So depth costs jobs, not recursion, and a document may be as deep as it likes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import block_bounds
from ..storage import stored

#: Fields whose text is a block wherever they stand; what looks like a block in a list; names of a vendor's lists and of the fields of their items.
BLOCK_FIELDS = ["ipv4Prefix", "ipv6Prefix", "prefix", "cidr"]
BLOCK = r"^\d{1,3}(?:\.\d{1,3}){3}/\d{1,2}$|^[0-9a-fA-F:]+/\d{1,3}$"
LISTS = ["prefixes", "ranges", "ips"]
ITEM_FIELDS = ["ipv4Prefix", "ipv6Prefix", "ip_prefix", "ipv6_prefix", "prefix", "cidr", "ip"]


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def children(level: DataFrame, value: str = "v") -> DataFrame:
    """The members of the objects and arrays of the column, with pos_, key_ (null in arrays) and v_; scalars have none."""
    spark = level.sparkSession
    inner = level.where(kind_of(F.col(value)).isin("OBJECT", "ARRAY"))
    return inner.lateralJoin(spark.tvf.variant_explode(F.col(value).outer()).toDF("pos_", "key_", "v_"))


def walk(rows: DataFrame, text: str, skip: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every node of the JSON texts: the rows' other columns, depth, path, key, name, in_list, kind and value.

    key: of members of objects; name: the nearest key above a node, itself included; in_list: whether it is an item of an
    array; value: scalars as text. Texts that are no JSON and nulls give no rows. skip: a condition on the key of members
    that are left out with all below them. The root has depth 0."""
    keep = [c for c in rows.columns if c != text]
    none = F.lit(None).cast("string")
    level = rows.select(*keep, F.lit(0).alias("depth"), F.lit("$").alias("path"), none.alias("key"), none.alias("name"), F.lit(False).alias("in_list"), F.try_parse_json(text).alias("v")).where("v is not null")
    levels = []
    while True:
        level = stored(level, "level")
        if level.isEmpty():
            break
        levels.append(level)
        step = F.when(F.col("key_").isNotNull(), F.concat(F.lit("."), "key_")).otherwise(F.format_string("[%d]", "pos_"))
        below = children(level)
        if skip is not None:
            below = below.where(~F.coalesce(F.get(F.transform(F.array("key_"), skip), F.lit(0)), F.lit(False)))
        level = below.select(*keep, (F.col("depth") + 1).alias("depth"), F.concat("path", step).alias("path"), F.col("key_").alias("key"), F.coalesce("key_", "name").alias("name"), F.col("key_").isNull().alias("in_list"), F.col("v_").alias("v"))
    if not levels:
        levels = [level]
    kind = kind_of(F.col("v"))
    out = reduce(DataFrame.unionByName, levels)
    return out.withColumns({"kind": kind, "value": F.when(~kind.isin("OBJECT", "ARRAY"), F.try_variant_get("v", "$", "string"))}).drop("v")


def harvest_ranges(payload: DataFrame, column: str = "json") -> DataFrame:
    """The other columns and cidr, once for each: blocks anywhere in vendors' JSON, as the text of a known field or of an item of a list."""
    keep = [c for c in payload.columns if c != column]
    nodes = walk(payload, column).where("kind = 'STRING'").withColumn("cidr", F.trim("value"))
    return nodes.where((F.col("in_list") | F.col("key").isin(BLOCK_FIELDS)) & F.col("cidr").rlike(BLOCK)).select(*keep, "cidr").distinct()


def provider_ranges(payload: DataFrame, column: str = "json") -> DataFrame:
    """(provider, cidr) of range files, objects by provider: a text, a list of texts or of objects, or a vendor's payload with such a list. Keys that begin with _ are metadata; what is no block is left out."""
    top = children(payload.select(F.try_parse_json(column).alias("v"))).where("key_ is not null and not startswith(key_, '_')").select(F.lower("key_").alias("provider"), F.col("v_").alias("v"))
    lists = [F.try_variant_get("v", f"$.{f}", "array<variant>") for f in LISTS]
    inner = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))
    one = F.array(F.col("v"))
    items = F.when(kind_of(F.col("v")) == "OBJECT", inner).when(kind_of(F.col("v")) == "STRING", one).otherwise(F.try_variant_get("v", "$", "array<variant>"))
    item = top.select("provider", F.explode(items).alias("v"))
    fields = F.array(*(F.try_variant_get("v", f"$.{f}", "string") for f in ITEM_FIELDS))
    found = F.when(kind_of(F.col("v")) == "OBJECT", fields).otherwise(F.array(F.try_variant_get("v", "$", "string")))
    out = item.select("provider", F.explode(found).alias("cidr")).select("provider", F.trim("cidr").alias("cidr"))
    return out.where(block_bounds("cidr").isNotNull()).distinct()


def linked_types(docs: DataFrame, column: str = "json") -> DataFrame:
    """The other columns and type: every @type of linked data at any depth, alone or in a list."""
    keep = [c for c in docs.columns if c != column]
    return walk(docs, column).where("name = '@type' and kind = 'STRING'").select(*keep, F.col("value").alias("type"))
