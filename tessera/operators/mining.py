"""Frequent patterns and link analysis."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import functions as F

from tessera.operators.durable import stored
from tessera.operators.registry import IN, OUT, names, need, operator


@operator("frequent-item-set")
def frequent_item_set(inputs, attribute=None, min_support=0.1, min_confidence=0.5, **_):
    """Item sets with their share of all baskets, and rules. Items of a basket count once."""
    df, a = inputs[IN], names(need(attribute, "attribute"))[0]
    # read several times: by the counts, the trees and the number of baskets
    baskets = stored(df.select(F.array_distinct(a).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=float(min_support), minConfidence=float(min_confidence)).fit(baskets)
    n = baskets.count()
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq", (F.col("freq") / n).alias("support"))
    return {OUT: sets, "rules output": model.associationRules, "model": model}


@operator("association-rules")
def association_rules(inputs, attribute="items", freq="support", confidence=0.9, rules_count=200, **_):
    """All splits of item sets (items, support) into two sides, with confidence, lift, leverage, conviction and Jaccard index:
    the subsets of each item set are exploded and find their own support by two joins."""
    sets = inputs[IN].select(F.array_sort(attribute).alias("items"), F.col(freq).cast("double").alias("support"))
    some = sets.filter(F.size("items") > 1)
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("items")) - 2).cast("int"))
    part = lambda want: F.expr(f"filter(items, (x, i) -> ((shiftright(mask, i) & 1) = {want}))")
    splits = some.select("items", "support", F.explode(masks).alias("mask")).select("support", part(1).alias("antecedent"), part(0).alias("consequent"))
    j = splits.join(sets.toDF("antecedent", "sa"), "antecedent").join(sets.toDF("consequent", "sc"), "consequent")
    conf = F.col("support") / F.col("sa")
    made = j.select(
        "antecedent", "consequent", "support", conf.alias("confidence"), (conf / F.col("sc")).alias("lift"), (F.col("support") - F.col("sa") * F.col("sc")).alias("leverage"),
        F.when(conf < 1, (1 - F.col("sc")) / (1 - conf)).otherwise(F.lit(float("inf"))).alias("conviction"), (F.col("support") / (F.col("sa") + F.col("sc") - F.col("support"))).alias("jaccard"),
    )
    return {OUT: made.filter(F.col("confidence") >= float(confidence)).orderBy(F.desc("confidence"), F.desc("support"), "antecedent", "consequent").limit(int(rules_count))}


@operator("sequence-mining")
def sequence_mining(inputs, attribute=None, min_support=0.1, max_pattern_length=10, freq="freq", **_):
    a = names(need(attribute, "attribute"))[0]
    found = PrefixSpan(minSupport=float(min_support), maxPatternLength=int(max_pattern_length), sequenceCol=a).findFrequentSequentialPatterns(inputs[IN].select(a))
    return {OUT: found.withColumnRenamed("freq", freq)}


@operator("page-rank")
def page_rank(inputs, inlink="src", outlink="dst", damping_factor=0.85, maxIters=20, checkpoint_every=5, **_):  # noqa: N803
    """Ranks by a fixed number of rounds; a rank starts at 1, and that of pages without links goes to nobody. Links are a table in
    the shared folder, and so are the ranks after every few rounds."""
    df = inputs[IN]
    links = df.select(F.col(inlink).alias("src"), F.col(outlink).alias("dst")).distinct()
    degrees = links.groupBy("src").agg(F.count("*").alias("n"))
    edges = stored(links.join(degrees, "src"), "edges")
    pages = stored(links.select("src").union(links.select("dst")).distinct().toDF("page"), "pages")
    d, ranks = float(damping_factor), pages.withColumn("rank", F.lit(1.0))
    for i in range(int(maxIters)):
        given = edges.join(ranks, edges["src"] == ranks["page"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("given"))
        ranks = pages.join(given, pages["page"] == given["dst"], "left").select("page", (F.lit(1 - d) + d * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if (i + 1) % int(checkpoint_every) == 0:
            ranks = stored(ranks, "ranks")
    return {OUT: ranks}
