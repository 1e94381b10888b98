"""Channel-combination classification of puncta.

A punctum's channel pairs travel as one array; thresholds, edges,
cliques and the final label are row-local expressions on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.model import (
    AXON_SKIP_BELOW, CH2_MIN_THRESHOLD, CH2_THRESHOLD_FACTOR, CLIQUE_PROB_BONUS, CLIQUE_SIZE_BONUS,
    DENDRITE_SKIP_ABOVE, LOW_CONFIDENCE, REJECTED_SINGLE_CHANNELS,
    SINGLE_CHANNEL_CONFIDENCE, WEAK_CHANNELS, ClassifySettings)


def _touches(e: Column, channels) -> Column:
    return e["c1"].isin(*channels) | e["c2"].isin(*channels)


def pair_threshold(c1: Column, c2: Column, settings: ClassifySettings = ClassifySettings()) -> Column:
    """Probability an edge needs.

    A detected channel 4 or 5 always links (0); channel 2 is strict; others
    use the model's threshold when it has one, else the caller's.
    """
    base = settings.optimal_threshold
    strict = CH2_MIN_THRESHOLD if base is None else max(base * CH2_THRESHOLD_FACTOR, CH2_MIN_THRESHOLD)
    plain = settings.overlap_thresh if base is None else base
    return (F.when(c1.isin(*WEAK_CHANNELS) | c2.isin(*WEAK_CHANNELS), F.lit(0.0))
            .when((c1 == 2) | (c2 == 2), F.lit(float(strict))).otherwise(F.lit(float(plain))))


def linked_sets(edges: Column) -> Column:
    """Channel sets whose pairs are all among the edges: struct<chans, label, size, weak>.

    Channels join one after the other: a new one extends every set whose
    members it is linked to. Any channel numbers and any number of channels
    work; the list is as long as the graph has cliques.
    """
    ends = F.concat(F.transform(edges, lambda e: e["c1"]), F.transform(edges, lambda e: e["c2"]))
    channels = F.array_sort(F.array_distinct(ends))

    def extend(sets: Column, c: Column) -> Column:
        linked = lambda m: F.exists(edges, lambda e: (e["c1"] == m) & (e["c2"] == c))
        fits = F.filter(sets, lambda q: F.forall(q, linked))
        return F.concat(sets, F.array(F.array(c)), F.transform(fits, lambda q: F.concat(q, F.array(c))))

    sets = F.aggregate(channels, F.array().cast("array<array<int>>"), extend)
    return F.transform(F.filter(sets, lambda q: F.size(q) >= 2), lambda q: F.struct(
        q.alias("chans"), F.array_join(F.transform(q, lambda c: c.cast("string")), "_").alias("label"),
        F.size(q).alias("size"), F.exists(q, lambda c: c.isin(*WEAK_CHANNELS)).alias("weak")))


def edges_within(edges: Column, s: Column) -> Column:
    return F.filter(edges, lambda e: F.array_contains(s["chans"], e["c1"]) & F.array_contains(s["chans"], e["c2"]))


def mean_p(edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["p"]) / F.size(edges)


def with_edges(per_punctum: DataFrame, settings: ClassifySettings = ClassifySettings()) -> DataFrame:
    """Add ``edges``: pairs that reach their threshold and are not skipped.

    Needs ``pairs`` array<struct<c1,c2,p>> sorted by channel and the coverage
    columns ``axon_cov`` / ``dendrite_cov`` (null when not computed).
    """
    skip = F.coalesce((F.col("dendrite_cov") > DENDRITE_SKIP_ABOVE)
                      & (F.col("axon_cov") < AXON_SKIP_BELOW), F.lit(False))
    return per_punctum.withColumn("edges", F.filter("pairs", lambda e: (
        (e["p"] >= pair_threshold(e["c1"], e["c2"], settings)) & ~(skip & _touches(e, [2])))))


def with_best_clique(edged: DataFrame) -> DataFrame:
    """Add ``best``: struct<nsize, nprob, label, chans, avg>, null without an edge.

    Scoring all fully linked subsets instead of the maximal ones gives the
    same winner, because a superset keeps the bonus and is larger by one. Ties
    go to the smallest label.
    """
    def scored(s):
        avg = mean_p(edges_within(F.col("edges"), s))
        return F.struct(
            (-(s["size"] + F.when(s["weak"], F.lit(CLIQUE_SIZE_BONUS)).otherwise(F.lit(0.0)))).alias("nsize"),
            (-(avg + F.when(s["weak"], F.lit(CLIQUE_PROB_BONUS)).otherwise(F.lit(0.0)))).alias("nprob"),
            s["label"].alias("label"), s["chans"].alias("chans"), avg.alias("avg"))

    return edged.withColumn("best", F.array_min(F.transform(linked_sets(F.col("edges")), scored)))


def single_channel(c: Column) -> tuple[Column, Column]:
    rejected = c.isin(*REJECTED_SINGLE_CHANNELS)
    return (F.when(rejected, F.lit(LOW_CONFIDENCE)).otherwise(c.cast("string")),
            F.when(rejected, F.lit(0.0)).otherwise(F.lit(SINGLE_CHANNEL_CONFIDENCE)))


def with_prediction(scored: DataFrame, settings: ClassifySettings = ClassifySettings()) -> DataFrame:
    """Add final_prediction and final_confidence from ``chans``, ``pairs``, ``edges``, ``best``."""
    n = F.coalesce(F.size("chans"), F.lit(0))
    lone_label, lone_conf = single_channel(F.get("chans", F.lit(0)))
    weakest = F.aggregate("edges", F.lit(1.0), lambda m, e: F.least(m, e["p"]))
    conf = F.when(F.col("best.avg") > 0, F.col("best.avg")).otherwise(weakest)

    # a combination naming channel 4/5 loses it when nothing overlaps it and confidence is nil
    in_best = lambda c: F.array_contains(F.col("best.chans"), c)
    weak_p = F.aggregate("pairs", F.lit(0.0), lambda m, e: F.when(
        (e["c1"].isin(*WEAK_CHANNELS) & ~e["c2"].isin(*WEAK_CHANNELS) & in_best(e["c2"]))
        | (e["c2"].isin(*WEAK_CHANNELS) & ~e["c1"].isin(*WEAK_CHANNELS) & in_best(e["c1"])),
        F.greatest(m, e["p"])).otherwise(m))
    kept = F.filter(F.col("best.chans"), lambda c: ~c.isin(*WEAK_CHANNELS))
    has_weak = F.exists(F.col("best.chans"), lambda c: c.isin(*WEAK_CHANNELS))
    drop_weak = has_weak & (weak_p == 0) & (F.col("_conf") < 0.01)
    label = (F.when(drop_weak & (F.size(kept) == 0), F.lit(LOW_CONFIDENCE))
             .when(drop_weak, F.array_join(F.transform(kept, lambda c: c.cast("string")), "_"))
             .otherwise(F.col("best.label")))
    if settings.confidence_threshold is not None:
        label = F.when(F.col("_conf") < settings.confidence_threshold,
                       F.lit(LOW_CONFIDENCE)).otherwise(label)

    return (scored.withColumn("_conf", conf)
            .withColumn("final_prediction",
                        F.when(n == 0, F.lit(LOW_CONFIDENCE)).when(n == 1, lone_label)
                        .when(F.col("best").isNull(), lone_label).otherwise(label))
            .withColumn("final_confidence",
                        F.when(n == 0, F.lit(0.0)).when(n == 1, lone_conf)
                        .when(F.col("best").isNull(), lone_conf).otherwise(F.col("_conf")))
            .drop("_conf"))


def gather(scores: DataFrame) -> DataFrame:
    """(punctum_id, chans, pairs, axon_cov, dendrite_cov) from pair rows with a ``p`` column.

    The pair rows are already partitioned by punctum, so this adds no
    shuffle; a group holds one row per channel pair of a punctum.
    """
    pair = F.struct("c1", "c2", F.col("p").cast("double").alias("p"))
    return scores.groupBy("punctum_id").agg(
        F.first("chans").alias("chans"),
        F.array_sort(F.collect_list(F.when(F.col("c1").isNotNull(), pair))).alias("pairs"),
        F.first("axon_cov").alias("axon_cov"), F.first("dendrite_cov").alias("dendrite_cov"))


def classify(puncta: DataFrame, per_punctum: DataFrame,
             settings: ClassifySettings = ClassifySettings()) -> DataFrame:
    """Prediction rows for every punctum; undetected ones are low confidence."""
    return complete(puncta, predict(per_punctum, settings))


def predict(per_punctum: DataFrame, settings: ClassifySettings = ClassifySettings()) -> DataFrame:
    """(punctum_id, final_prediction, final_confidence) of the detected ones."""
    scored = with_best_clique(with_edges(per_punctum, settings))
    return with_prediction(scored, settings).select("punctum_id", "final_prediction", "final_confidence")


def complete(puncta: DataFrame, labelled: DataFrame) -> DataFrame:
    """Predictions with positions, and rows of low confidence for puncta without one."""
    return (puncta.select("punctum_id", *[F.col(a).cast("double").alias(a) for a in ("x", "y", "z")])
            .join(labelled, "punctum_id", "left")
            .select("punctum_id",
                    F.coalesce("final_prediction", F.lit(LOW_CONFIDENCE)).alias("final_prediction"),
                    F.coalesce("final_confidence", F.lit(0.0)).alias("final_confidence"),
                    "x", "y", "z"))


def label_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("final_prediction").agg(F.count(F.lit(1)).alias("n"))
