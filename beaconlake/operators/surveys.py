"""Visibility in AI answers: rates with intervals, voice, sources, the gap where a brand is left out."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, web
from ..storage import stored


#: What an answer of a survey is known by.
ANSWER_KEY = ["prompt_id", "engine", "run"]


def rates(obs: DataFrame, n: Column | None = None, k: Column | None = None) -> DataFrame:
    """Answers, those that cite the brand, rate and interval: overall, by engine and by family, in one pass.

    n, k: what a row counts for, where rows carry counts of their own (as trackers do); else a row is an answer."""
    rows = obs.withColumns({"n_": F.lit(1) if n is None else n, "k_": F.col("cited").cast("int") if k is None else k})
    sets = rows.groupingSets([["engine"], ["family"], []], "engine", "family").agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("n"), F.coalesce(F.sum("k_"), F.lit(0)).alias("k"), F.grouping("engine").alias("ge"), F.grouping("family").alias("gf"))
    kind = F.when(F.col("ge") == 0, "engine").when(F.col("gf") == 0, "family").otherwise("overall")
    return with_interval(sets.select(kind.alias("kind"), F.coalesce("engine", "family", F.lit("all")).alias("name"), "n", "k"))


def with_interval(counts: DataFrame) -> DataFrame:
    """The rows of n and k with rate, low and high."""
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.withColumns({"rate": F.try_divide("k", "n"), "low": low, "high": high})


def compare(obs: DataFrame, by: str, wave: str = "wave", both: bool = True) -> DataFrame:
    """Two waves by a column: shares, difference with its interval, z and its p, noise floor, signal. both: only values that both waves have, else a wave without one counts as 0 of 0."""
    w = obs.groupBy(by).agg(*(F.count_if(F.col(wave) == i).alias(f"n{i}") for i in (1, 2)), *(F.count_if((F.col(wave) == i) & F.col("cited")).alias(f"k{i}") for i in (1, 2)))
    w = w.where("n1 > 0 and n2 > 0") if both else w
    k1, n1, k2, n2 = (F.col(c) for c in ("k1", "n1", "k2", "n2"))
    low, high = stats.newcombe(k1, n1, k2, n2)
    share = lambda k, n: F.coalesce(F.try_divide(k, n), F.lit(0.0))
    return w.select(by, "n1", "k1", "n2", "k2", (share(k2, n2) - share(k1, n1)).alias("diff"), low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("signal"), stats.pooled_z(k1, n1, k2, n2).alias("z"), stats.normal_p(stats.pooled_z(k1, n1, k2, n2)).alias("p"), stats.noise_floor(n1, n2).alias("floor"))


def repetitions(obs: DataFrame) -> DataFrame:
    """How often each prompt was put to each engine: least, most and upper median over all pairs. Pairs are counted by n first, so one task sees each n once."""
    by_n = obs.groupBy("prompt_id", "engine").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    both = by_n.withColumns({"upto": F.sum("c").over(Window.orderBy("n")), "all": F.sum("c").over(Window.partitionBy())})
    return both.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("pairs"), F.min("n").alias("least"), F.max("n").alias("most"), stats.at_rank_of_counts(F.col("n"), F.col("upto"), F.col("all"), 0.5).alias("median"))


def share_of_voice(obs: DataFrame, brands: Column) -> DataFrame:
    """Mentions (a brand once in an answer) and their share of all."""
    n = obs.select(F.explode(F.array_distinct(brands)).alias("brand")).groupBy("brand").agg(F.count("*").alias("mentions"))
    return n.select("brand", "mentions", (F.col("mentions") / n.agg(F.sum("mentions")).scalar()).alias("share"))


def domains(obs: DataFrame, urls: Column) -> DataFrame:
    """(event, prompt_id, engine, cited, domain), a domain once in an answer."""
    hosts = F.array_distinct(F.filter(F.transform(urls, web.host_of), lambda h: h != ""))
    return obs.select("*", F.explode(hosts).alias("domain"))


def domain_reach(obs: DataFrame, urls: Column, own: str) -> DataFrame:
    """Answers that use a domain, their share of the answers with sources, and the domain's kind."""
    total = obs.where(F.size(urls) > 0).agg(F.count("*")).scalar()
    n = domains(obs, urls).groupBy("domain").agg(F.count("*").alias("answers"))
    return n.select("domain", "answers", (F.col("answers") / total).alias("share"), web.source_type(F.col("domain"), own).alias("type"))


def source_gap(obs: DataFrame, urls: Column, own: str, core_min: int = 4, core_share: float = 0.75) -> DataFrame:
    """Domains of the answers that leave the brand out. Core on a prompt and engine: in core_share of core_min absent answers or more; core altogether: on two prompts or more."""
    absent = obs.where(~F.col("cited"))
    size = absent.groupBy("prompt_id", "engine").agg(F.count("*").alias("absent"))
    per = domains(absent, urls).where(~((F.col("domain") == own) | F.col("domain").endswith("." + own))).groupBy("prompt_id", "engine", "domain").agg(F.count("*").alias("n"))
    core = (F.col("absent") >= core_min) & (F.col("n") / F.col("absent") >= core_share)
    out = per.join(size, ["prompt_id", "engine"]).groupBy("domain").agg(F.count_distinct(F.when(core, F.col("prompt_id"))).alias("core_in"), F.sum("n").alias("absent_answers"), F.count_distinct("prompt_id").alias("prompts"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    return out.withColumn("type", web.source_type(F.col("domain"), own)).withColumn("stability", F.when(F.col("core_in") >= 2, "core").otherwise("rotating"))


def never_cited(obs: DataFrame) -> DataFrame:
    return obs.groupBy("prompt_id").agg(F.bool_or("cited").alias("any")).where("not any").select("prompt_id")


def answer_brands(answers: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """Adds brands (in order of appearance, whole words only) and position of the first name: first, passing or none."""
    at = F.array_compact(F.array(*(F.when(F.regexp_instr(text, F.lit(rf"(?i)(?<![\w-]){n}(?![\w-])")) > 0, F.struct(F.regexp_instr(text, F.lit(rf"(?i)(?<![\w-]){n}(?![\w-])")).alias("at"), F.lit(n).alias("name"))) for n in names)))
    found = F.transform(F.array_sort(at), lambda x: x["name"])
    return answers.withColumn("brands", found).withColumn("position", F.when(F.get(found, F.lit(0)) == names[0], "first").when(F.array_contains(found, names[0]), "passing").otherwise("none"))


def quadrants(obs: DataFrame, by: str) -> DataFrame:
    """Families by their presence and size against the medians of both."""
    r = obs.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("cited").cast("double")).alias("rate"))
    r = r.withColumns({"mn": r.agg(F.percentile("n", 0.5)).scalar(), "mr": r.agg(F.percentile("rate", 0.5)).scalar()})
    side = F.concat_ws("-", F.when(F.col("n") >= F.col("mn"), "large").otherwise("small"), F.when(F.col("rate") >= F.col("mr"), "present").otherwise("absent"))
    return r.select(by, "n", "rate", side.alias("quadrant"))


def overview(obs: DataFrame) -> DataFrame:
    """One row: answers, prompts, families, engines."""
    return obs.agg(F.count("*").alias("answers"), *(F.count_distinct(c).alias(n) for c, n in (("prompt_id", "prompts"), ("family", "families"), ("engine", "engines"))))


def mix(obs: DataFrame, column: str) -> DataFrame:
    """How often each position (or sentiment) is among the answers that cite the brand."""
    return obs.where("cited").groupBy(column).agg(F.count("*").alias("answers"))


def own_pages(obs: DataFrame, urls: Column, own: str) -> DataFrame:
    """url, prompts (sorted) of the brand's pages, those of its subdomains too, among the sources."""
    rows = obs.select("prompt_id", F.explode(F.array_distinct(urls)).alias("url"))
    host = web.host_of(F.col("url"))
    return rows.where((host == own) | host.endswith("." + own)).groupBy("url").agg(F.array_sort(F.collect_set("prompt_id")).alias("prompts"))


def cited_urls(obs: DataFrame, own: str, k: int = 10) -> DataFrame:
    """url, answers, own of the k URLs cited most; own is a matter of the domain's name standing in the URL. obs: cited, cited_url."""
    n = obs.where("cited and cited_url <> ''").groupBy("cited_url").agg(F.count("*").alias("answers"))
    return n.select(F.col("cited_url").alias("url"), "answers", F.lower("cited_url").contains(own.lower()).alias("own")).orderBy(F.desc("answers"), "url").limit(k)


def top_gap(gap: DataFrame, k: int = 20) -> DataFrame:
    """The k domains of a source gap that matter most: those that are core on the most prompts, then in the most absent answers."""
    return gap.orderBy(F.desc("core_in"), F.desc("absent_answers"), "domain").limit(k)


#: Search fee of each engine for 1 000 calls, in dollars.
FEES = {"openai": 10.0, "perplexity": 2.5, "gemini": 14.0, "anthropic": 10.0}


def costs(prompts: DataFrame, engines: dict[str, int], runs: int) -> DataFrame:
    """engine, calls, fee of a survey. engines: searches a call may make."""
    n = prompts.agg(F.count_distinct("prompt_id").alias("n"))
    rows = F.array(*(F.struct(F.lit(e).alias("engine"), (F.col("n") * runs).alias("calls"), (F.col("n") * runs * uses * FEES[e] / 1000.0).alias("fee")) for e, uses in engines.items()))
    return n.select(F.explode(rows).alias("r")).select("r.*")


def prompt_family(text: Column, competitors: list[str]) -> Column:
    """Family of a prompt by its words; null where none fits."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    named = has(*(c.lower() for c in competitors)) if competitors else F.lit(False)
    objection = low.rlike(r"[^a-z](avis|fiable|arnaque|cher|lent|secure|reliable|scam)[^a-z]")
    return (
        F.when(objection, "objection").when(has("alternative", "remplacer", "migrer", "replace ", "migrate"), "replacement")
        .when(F.trim(low).rlike("^(est-ce qu|does |do |can |is )") | has(" gère-t-"), "qualification")
        .when(named | low.rlike(" vs[. ]") | has("différence entre"), "named-comparison")
        .when(has("comment ", "how to", "guide "), "implementation")
        .when(has("quel ", "quelle ", "meilleur", "best ", "which ", "top "), "category-discovery")
    )


def volume_weight(impressions: Column, median: Column, recurring: Column, rank: Column) -> Column:
    """3 above the export's median impressions or among the ten most recurring, 2 for three times or more, 1 below."""
    return F.when((impressions > median) | (rank <= 10), 3).when(recurring >= 3, 2).when(recurring >= 1, 1)


#: Kinds of gaps of an entity, with priority and severity.
ENTITY_GAPS = {"confusion": (1, "high"), "wrong facts": (2, "high"), "vague": (3, "medium"), "outdated": (4, "medium"), "no answer": (1, "high")}


def gap_priority(kind: Column) -> Column:
    """Struct of priority and severity of an entity gap."""
    known = F.create_map(*(x for k, (p, s) in ENTITY_GAPS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("priority"), F.lit(s).alias("severity")))))
    return F.try_element_at(known, kind)


def priorities(families: DataFrame, k: int = 12) -> DataFrame:
    """The k families most worth an effort: prompts * weight * (1 - rate) / effort. families: family, prompts, weight, rate, effort."""
    score = F.try_divide(F.col("prompts") * F.col("weight") * (1 - F.col("rate")), F.col("effort"))
    return families.withColumn("priority", score).orderBy(F.desc("priority"), "family").limit(k)


def survey_plan(prompts: DataFrame, engines: list[str], runs: int) -> DataFrame:
    """The prompts for each engine and run (1, 2, ...)."""
    each = F.explode(F.array(*map(F.lit, engines))).alias("engine")
    return prompts.select("*", each).select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))


def unanswered(plan: DataFrame, kept: DataFrame | None) -> DataFrame:
    """The rows of a survey's plan (prompt_id, engine, run and more) that no kept answer is for."""
    return plan if kept is None else plan.join(kept.select(*ANSWER_KEY).distinct(), ANSWER_KEY, "left_anti")


def keep_answers(answers: DataFrame, path: str) -> int:
    """Adds answers to the store under path, by engine, and says how many were new; those that it has, by prompt, engine and run, are left as they are.

    Of answers that come twice one is kept. A call writes a batch of its own, which counts when it is whole, so what a broken
    one leaves is no part of the store and the same call completes it."""
    kept = kept_answers(answers.sparkSession, path)
    new = stored(unanswered(answers.dropDuplicates(ANSWER_KEY), kept), "answers")
    n = new.count()
    if n:
        new.repartition("engine", F.pmod(F.xxhash64("prompt_id"), F.lit(16))).write.partitionBy("engine").parquet(f"{path}/batch={uuid4().hex}")
    return n


def kept_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """The answers of the store's whole batches; None before there are any."""
    ends = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = ends.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(ends)
    batches = [x.getPath().getParent().toString() for x in found or ()]
    return spark.read.option("basePath", path).parquet(*batches).drop("batch") if batches else None
