"""Benchmark analytics: targets, changes, regressions, noise, speed, and what each category meets.

Quality is long: (result_set, case_id, image, preset, size, metric, value). The metric catalogue has a fixed number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A mean change counts from so many standard errors on; two sizes are a pair up to this share apart; a drift is worth a note.
STANDARD_ERRORS, MAX_SIZE_CHANGE, DRIFT = 3.0, 0.01, 0.15
# The share of its own size from which a page counts as an export, and the edge that tells it in old sets.
OWN_SIZE, EXPORT_EDGE = 0.99, 1375
CASE = ["result_set", "case_id", "image", "preset", "size"]


def target_misses(quality: DataFrame, metrics: DataFrame) -> DataFrame:
    """(case columns, metric, value, miss): whether a case misses each target that applies to it. Targets relative to another
    metric, or only for cases with another metric, look into the case's own values."""
    others = quality.where("value is not null").groupBy(*CASE).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("all"))  # as many entries as metrics
    rows = quality.where("value is not null").join(F.broadcast(metrics.where("limit_ is not null")), "metric").join(others, CASE)
    base = F.when(F.col("relative_to").isNull(), 0.0).otherwise(F.try_element_at("all", "relative_to"))
    applies = (F.col("where_").isNull() | (F.coalesce(F.try_element_at("all", "where_"), F.lit(0.0)) != 0)) & base.isNotNull()
    limit = F.col("limit_") + base
    miss = F.when(F.col("ideal").isNotNull(), F.abs(F.col("value") - F.col("ideal")) > limit).when(F.col("better") == "higher", F.col("value") < limit).otherwise(F.col("value") > limit)
    return rows.where(applies).select(*CASE, "metric", "job", "value", miss.alias("miss"))


def meets_targets(quality: DataFrame, metrics: DataFrame) -> DataFrame:
    """(case columns, job, targets, missed, met) by case and job, for those with any target."""
    return target_misses(quality, metrics).groupBy(*CASE, "job").agg(F.count(F.lit(1)).alias("targets"), F.count_if("miss").alias("missed")).withColumn("met", F.col("missed") == 0)


def changes(quality: DataFrame, metrics: DataFrame, base: str = "base", cand: str = "cand") -> DataFrame:
    """(case_id, metric, before, after, worse, sigma): how much worse the candidate is, as a share for relative metrics."""
    side = lambda name, to: quality.where(F.col("result_set") == name).select("case_id", "metric", F.col("value").alias(to), F.col("size").alias(f"{to}_size"))
    both = side(base, "before").join(side(cand, "after"), ["case_id", "metric"]).where("before is not null and after is not null").join(F.broadcast(metrics), "metric")
    plain = F.when(F.col("ideal").isNotNull(), F.abs(F.col("after") - F.col("ideal")) - F.abs(F.col("before") - F.col("ideal"))).when(F.col("better") == "higher", F.col("before") - F.col("after")).otherwise(F.col("after") - F.col("before"))
    worse = F.when(F.col("relative"), F.when(F.col("before") != 0, plain / F.abs("before"))).otherwise(plain)
    sigma = F.when(F.col("after_size") == "export", F.col("sigma_export")).otherwise(F.col("sigma_preview"))
    return both.select("case_id", "metric", "before", "after", worse.alias("worse"), sigma.alias("sigma"))


def regressions(quality: DataFrame, metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """(metric, group, cases, change, allowed): metrics whose mean change over a category, or over all cases, is worse than three
    standard errors. categories: (case_id, category), several for a case."""
    found = changes(quality, metrics).where("sigma is not null and worse is not null")
    each = found.join(categories, "case_id").select("metric", F.col("category").alias("group"), "worse", "sigma").union(found.select("metric", F.lit("all"), "worse", "sigma"))
    sums = each.groupBy("metric", "group").agg(F.count(F.lit(1)).alias("cases"), F.avg("worse").alias("change"), (F.lit(STANDARD_ERRORS) * F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))) / F.count(F.lit(1))).alias("allowed"))
    return sums.where(F.col("change") > F.col("allowed")).select("metric", "group", "cases", F.round("change", 6).alias("change"), F.round("allowed", 6).alias("allowed"))


def target_changes(quality: DataFrame, metrics: DataFrame) -> DataFrame:
    """(metric, before_missed, before_scored, after_missed, after_scored, newly_missed, newly_met) over both result sets."""
    found = target_misses(quality, metrics)
    side = lambda name, to: found.where(F.col("result_set") == name).select("case_id", "metric", F.col("miss").alias(to))
    both = side("base", "before").join(side("cand", "after"), ["case_id", "metric"], "full")
    return both.groupBy("metric").agg(
        F.count_if("before").alias("before_missed"), F.count("before").alias("before_scored"), F.count_if("after").alias("after_missed"), F.count("after").alias("after_scored"),
        F.count_if(~F.col("before") & F.col("after")).alias("newly_missed"), F.count_if(F.col("before") & ~F.col("after")).alias("newly_met"),
    )


def noise_sigmas(quality: DataFrame, metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, pairs, sigma): root mean square change between pages of one image and preset whose long edges are up to 1 % apart.
    edges: (result_set, case_id, edge); an edge that several result sets have counts once, the first by name."""
    sized = quality.where("value is not null").join(edges, ["result_set", "case_id"])
    once = sized.groupBy("image", "preset", "edge", "metric").agg(F.min(F.struct("result_set", "value")).alias("v")).select("image", "preset", "edge", "metric", F.col("v.value").alias("value"))
    # pairs meet in blocks of 1 % of the edge: the own block of the smaller, and the next
    width = F.floor(F.log(F.col("edge")) / F.log(F.lit(1 + 2 * MAX_SIZE_CHANGE)))
    small = once.select("image", "preset", "metric", F.col("edge").alias("e1"), F.col("value").alias("before"), F.explode(F.array(width, width + 1)).alias("block"))
    large = once.select("image", "preset", "metric", F.col("edge").alias("e2"), F.col("value").alias("after"), width.alias("block"))
    pairs = small.join(large, ["image", "preset", "metric", "block"]).where((F.col("e2") > F.col("e1")) & (F.col("e2") - F.col("e1") <= MAX_SIZE_CHANGE * F.col("e1"))).join(F.broadcast(metrics.where("sigma_preview is not null")), "metric")
    plain = F.when(F.col("ideal").isNotNull(), F.abs(F.col("after") - F.col("ideal")) - F.abs(F.col("before") - F.col("ideal"))).otherwise(F.col("after") - F.col("before"))
    change = F.when(F.col("relative"), F.when(F.col("before") != 0, plain / F.abs("before"))).otherwise(plain)
    return pairs.withColumn("c", change).where("c is not null").groupBy("metric").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sqrt(F.avg(F.col("c") * F.col("c"))), 6).alias("sigma"))


def category_means(quality: DataFrame, categories: DataFrame) -> DataFrame:
    """(result_set, category, metric, cases, mean) over the cases that both result sets completed; category null is all of them."""
    both = quality.groupBy("case_id").agg(F.count_distinct("result_set").alias("sets")).where("sets = 2").select("case_id")
    done = quality.join(both, "case_id", "left_semi")
    of_category = done.join(categories, "case_id").groupBy("result_set", "category", "metric").agg(F.count("value").alias("cases"), F.round(F.avg("value"), 6).alias("mean"))
    overall = done.groupBy("result_set", "metric").agg(F.count("value").alias("cases"), F.round(F.avg("value"), 6).alias("mean"))
    return of_category.union(overall.select("result_set", F.lit(None).cast("string"), "metric", "cases", "mean"))


def met_counts(quality: DataFrame, metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, job, result_set, met, scored): cases that meet all their targets of a job, of those any applies to."""
    verdicts = meets_targets(quality, metrics)
    each = verdicts.join(categories, "case_id").select("category", "job", "result_set", "met").union(verdicts.select(F.lit("all"), "job", "result_set", "met"))
    return each.groupBy("category", "job", "result_set").agg(F.count_if("met").alias("met"), F.count(F.lit(1)).alias("scored"))


def speedups(cases: DataFrame) -> DataFrame:
    """(preset, cases, geomean, slowest): geometric mean of base time over candidate time. cases: (result_set, case_id, preset, seconds)."""
    side = lambda name, to: cases.where(F.col("result_set") == name).select("case_id", "preset", F.col("seconds").alias(to))
    both = side("base", "before").join(side("cand", "after"), ["case_id", "preset"]).where("before > 0 and after > 0")
    return both.groupBy("preset").agg(F.count(F.lit(1)).alias("cases"), F.round(F.exp(F.avg(F.ln(F.col("before") / F.col("after")))), 6).alias("geomean"), F.round(F.max("after"), 6).alias("slowest"))


def stage_totals(stages: DataFrame) -> DataFrame:
    """(result_set, stage, seconds, share): seconds of each stage over the cases that every result set completed. stages: (result_set,
    case_id, stages map)."""
    sets = stages.agg(F.count_distinct("result_set").alias("n"))
    common = stages.groupBy("case_id").agg(F.count_distinct("result_set").alias("k")).join(F.broadcast(sets), F.col("k") == F.col("n")).select("case_id")
    each = stages.join(common, "case_id", "left_semi").select("result_set", F.explode("stages").alias("stage", "seconds"))
    sums = each.groupBy("result_set", "stage").agg(F.sum("seconds").alias("seconds"))
    return sums.select("result_set", "stage", F.round("seconds", 6).alias("seconds"), F.round(F.col("seconds") / F.sum("seconds").over(Window.partitionBy("result_set")), 6).alias("share"))


def drift_notes(quality: DataFrame) -> DataFrame:
    """(case_id, before, after): cases whose number of regions changed by more than 15 %."""
    regions = quality.where("metric = 'regions'")
    side = lambda name, to: regions.where(F.col("result_set") == name).select("case_id", F.col("value").alias(to))
    return side("base", "before").join(side("cand", "after"), "case_id").where((F.col("before") != 0) & (F.abs(F.col("after") - F.col("before")) / F.col("before") > DRIFT))


def quality_table(quality: DataFrame, metrics: DataFrame) -> DataFrame:
    """(case_id, metric, before, after, delta): the candidate's value for each case, with the base's where it has one."""
    side = lambda name, to: quality.where(F.col("result_set") == name).select("case_id", "metric", F.col("value").alias(to))
    both = side("cand", "after").join(side("base", "before"), ["case_id", "metric"], "left").join(F.broadcast(metrics.select("metric")), "metric", "left_semi")
    return both.select("case_id", "metric", F.round("before", 10).alias("before"), F.round("after", 10).alias("after"), F.round(F.col("after") - F.col("before"), 10).alias("delta"))


def case_sizes(cases: DataFrame) -> DataFrame:
    """(case_id, edge, unscaled, size): the long edge of each case's page, whether the page keeps its image's own size, and which
    tolerance judges it. cases (case_id, asked, page_w, page_h, source_w, source_h); pages and sources may be null in old sets."""
    edge = F.coalesce(F.greatest("page_w", "page_h"), F.col("asked"))
    source = F.greatest("source_w", "source_h")
    own = F.when(source.isNotNull(), edge >= source).otherwise(F.col("asked") > edge)
    export = F.when(source.isNotNull(), edge >= OWN_SIZE * source).otherwise(F.col("asked") >= EXPORT_EDGE)
    return cases.select("case_id", edge.alias("edge"), own.alias("unscaled"), F.when(export, "export").otherwise("preview").alias("size"))


def case_flags(quality: DataFrame, metrics: DataFrame) -> DataFrame:
    """(case_id, flags): what is worse in each case than one pair allows, and regions that drifted; 'ok' where nothing is."""
    found = changes(quality, metrics)
    worse = found.where(F.col("worse") > STANDARD_ERRORS * F.col("sigma")).select("case_id", F.concat(F.col("metric"), F.lit(" worse")).alias("note"))
    notes = worse.union(drift_notes(quality).select("case_id", F.lit("regions drifted"))).groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list("note")), ", ").alias("flags"))
    return found.select("case_id").distinct().join(notes, "case_id", "left").select("case_id", F.coalesce("flags", F.lit("ok")).alias("flags"))


def misses(quality: DataFrame, metrics: DataFrame) -> DataFrame:
    """(case_id, misses): targets missed over targets scored in each set, the base's before an arrow where they differ."""
    of = target_misses(quality, metrics).groupBy("result_set", "case_id").agg(F.format_string("%d/%d", F.count_if("miss"), F.count(F.lit(1))).alias("cell"))
    side = lambda name, to: of.where(F.col("result_set") == name).select("case_id", F.col("cell").alias(to))
    both = side("cand", "after").join(side("base", "before"), "case_id", "left")
    return both.select("case_id", F.when(F.coalesce("before", "after") == F.col("after"), F.col("after")).otherwise(F.concat_ws(" -> ", "before", "after")).alias("misses"))


def category_order(categories: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(place, category): the categories there are: known ones in their order, then those without one, then the rest by name. As many
    rows as categories."""
    at = F.array_position(F.array(*map(F.lit, (*known, "uncategorized"))), F.col("category"))
    there = categories.select(F.coalesce("category", F.lit("uncategorized")).alias("category")).distinct()
    return there.select(F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(len(known) + 2), "category")).alias("place"), "category")


def sigma_overrides(items: DataFrame, metrics: DataFrame) -> DataFrame:
    """(metric, sigma) of items (item) that read METRIC=SIGMA. One that names no judged metric, or no number of 0 or more, is an
    error."""
    name, value = F.trim(F.regexp_extract("item", "^([^=]*)=", 1)), F.expr("try_cast(regexp_extract(item, '=(.*)$', 1) as double)")
    read = items.select("item", name.alias("metric"), value.alias("sigma")).join(F.broadcast(metrics.where("sigma_preview is not null").select("metric", F.lit(True).alias("judged"))), "metric", "left")
    good = F.col("judged") & (F.col("sigma") >= 0)
    return read.select("metric", F.when(good, F.col("sigma")).otherwise(F.raise_error(F.concat(F.lit("METRIC=SIGMA, a judged metric and a number of 0 or more; got "), F.col("item")))).alias("sigma"))
