"""Classification, calibration and retrieval metrics."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .graph import written

# --- Fixed values ---
RESAMPLES = 2000
BINARY_TARGETS = {"clear_bias_precision_lcb": 0.90, "opinion_style_macro_f1_bootstrap_lcb": 0.65, "objective_style_recall_lcb": 0.50, "opinionated_style_recall_lcb": 0.50, "minimum_evaluable_support": 30}
THREE_CLASS_TARGETS = {"bias_precision_lcb": 0.90, "article_report_precision_lcb": 0.90, "opinion_macro_f1_lcb": 0.65, "middle_recall_lcb": 0.50, "locked_test_bias_positive_support": 500, "locked_test_middle_support": 300}
#: Where a Poisson variable of mean one steps up, in 65536ths.
POISSON = [24109, 48218, 60273, 64291, 65296, 65497, 65531]


def guard(rows: DataFrame, labels: list[int], *, truth: str = "truth", pred: str | None = None, score: str | None = None) -> DataFrame:
    """The rows, if their labels are known and their scores finite and within 0 and 1; else an error that counts what isn't. One pass."""
    if len(set(labels)) != len(labels):
        raise ValueError("labels must be unique")
    bad = {f"{c} not among {labels}": ~F.coalesce(F.col(c).isin(labels), F.lit(False)) for c in (truth, pred) if c}
    if score:
        bad[f"{score} not between 0 and 1"] = ~F.coalesce((F.col(score) >= 0) & (F.col(score) <= 1) & ~F.isnan(F.col(score).cast("double")), F.lit(False))
    found = rows.agg(*[F.count_if(c).alias(str(i)) for i, c in enumerate(bad.values())]).first()
    wrong = [f"{name}: {n} rows" for name, n in zip(bad, found, strict=True) if n]
    if wrong:
        raise ValueError("; ".join(wrong))
    return rows


def confusion(rows: DataFrame, labels: list[int], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row per (truth, pred) of the known labels, zeros included."""
    spine = rows.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth int, pred int")
    held = rows.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return spine.join(held, ["truth", "pred"], "left").fillna(0, ["n"])


def per_class(matrix: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 from a confusion table."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")))).alias("x")).select("x.*")
    s = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("label", (tp + fn).alias("support"), S.ratio(tp, tp + fp).alias("precision"), S.ratio(tp, tp + fn).alias("recall"), S.f1(tp, fp, fn).alias("f1"))


def overall(matrix: DataFrame) -> DataFrame:
    """accuracy, macro_f1, and balanced accuracy over the classes that occur."""
    each = per_class(matrix).agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    hit = matrix.agg(S.ratio(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return hit.crossJoin(each)  # one row each


def binary_bundle(rows: DataFrame, score: str = "p", truth: str = "truth", threshold: float = 0.5, confidence: float = 0.95) -> DataFrame:
    """One row for each of the two classes: label, support, predicted_support, tp, precision, recall, f1 and both Wilson bounds, beside the values of the whole: accuracy, macro_f1, balanced_accuracy, roc_auc, average_precision."""
    kept = written(rows.select(F.col(truth).cast("int").alias("truth"), F.col(score).cast("double").alias("p")))
    t, p = F.col("truth"), (F.col("p") >= threshold).cast("int")
    each = [F.struct(F.lit(x).alias("label"), F.count_if(t == x).alias("support"), F.count_if(p == x).alias("predicted_support"), F.count_if((t == x) & (p == x)).alias("tp")) for x in (0, 1)]
    tp, n, m = F.col("tp"), F.col("support"), F.col("predicted_support")
    classes = kept.agg(F.array(*each).alias("c")).select(F.inline("c")).withColumn("precision", S.ratio(tp, m)).withColumn("recall", S.ratio(tp, n)).withColumn("f1", S.ratio(2 * tp, n + m))
    classes = classes.withColumn("precision_lower", S.wilson_lower(tp, m, confidence)).withColumn("recall_lower", S.wilson_lower(tp, n, confidence))
    whole = classes.agg(S.ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.coalesce(F.avg(F.when(n > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"))
    areas = by_score(kept, [], "p", t == 1)
    wins = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos")) + F.col("pos") * F.col("neg") / 2.0)
    step = F.col("pos") / F.col("pos_all") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    areas = areas.agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), wins / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"), F.when(F.sum("pos") > 0, F.sum(F.when(F.col("pos") > 0, step))).alias("average_precision"))
    return classes.crossJoin(whole).crossJoin(areas)  # one row each


def decision(rows: DataFrame, truth: str = "truth", selected: str = "selected", confidence: float = 0.95) -> DataFrame:
    """tp, fp, fn, coverage, precision, recall and Wilson bounds of a selection."""
    t, s = F.col(truth) == 1, F.col(selected)
    a = rows.agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count("*").alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select("tp", "fp", "fn", S.ratio(tp + fp, F.col("n")).alias("coverage"), S.ratio(tp, tp + fp).alias("precision"), S.ratio(tp, tp + fn).alias("recall"), S.wilson_lower(tp, tp + fp, confidence).alias("precision_lower"), S.wilson_lower(tp, tp + fn, confidence).alias("recall_lower"))


def by_score(rows: DataFrame, keys: list[str], score: str, positive: Column, *, ascending: bool = False) -> DataFrame:
    """Distinct scores with their counts and running counts from the highest down (or the lowest up).

    Distinct scores are dealt to ranges of about equal numbers of them (by sampled bounds,
    so any distribution is even); running sums take place inside ranges and, with one row
    each, over ranges, so no task sees all scores. The dealt table is written once.
    """
    g = rows.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = written(g.repartitionByRange(ranges, *keys, "score").withColumn("cell", F.spark_partition_id()))
    cells = g.groupBy(*keys, "cell").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    order = lambda c: F.col(c).asc() if ascending else F.col(c).desc()
    before = Window.partitionBy(*keys).orderBy(order("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "cell", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("pos_before"), F.coalesce(F.sum("q").over(before), F.lit(0)).alias("neg_before"), F.sum("p").over(Window.partitionBy(*keys)).alias("pos_all"), F.sum("q").over(Window.partitionBy(*keys)).alias("neg_all"))
    inside = Window.partitionBy(*keys, "cell").orderBy(order("score")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(cells, [*keys, "cell"])
    return g.withColumn("cum_pos", F.col("pos_before") + F.sum("pos").over(inside)).withColumn("cum_neg", F.col("neg_before") + F.sum("neg").over(inside)).drop("pos_before", "neg_before", "cell")


def roc_auc(rows: DataFrame, score: str = "p", truth: str = "truth", keys: list[str] = ()) -> DataFrame:
    """Area by mean ranks, ties halved; null where a class is absent."""
    s = by_score(rows, list(keys), score, F.col(truth) == 1)
    wins = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos")) + F.col("pos") * F.col("neg") / 2.0)
    return s.groupBy(*keys).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), wins / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def average_precision(rows: DataFrame, score: str = "p", truth: str = "truth", keys: list[str] = ()) -> DataFrame:
    """Step area over distinct scores from the highest down; null without a positive."""
    s = by_score(rows, list(keys), score, F.col(truth) == 1)
    step = F.col("pos") / F.col("pos_all") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return s.groupBy(*keys).agg(F.when(F.sum("pos") > 0, F.sum(F.when(F.col("pos") > 0, step))).alias("average_precision"))


def confident_region(rows: DataFrame, *, upper: bool, target: float, min_support: int, score: str = "p", truth: str = "truth", confidence: float = 0.95) -> DataFrame:
    """The widest region of scores, from its threshold up (or down), whose precision's lower bound reaches the target.

    enabled, threshold (null if disabled), reason (why it is disabled), and support,
    correct, observed, lcb and coverage of the region, or of the best attempt, whose
    threshold is best_threshold.
    """
    s = by_score(rows, [], score, F.col(truth) == (1 if upper else 0), ascending=not upper)
    r = s.select(F.col("score").alias("threshold"), (F.col("cum_pos") + F.col("cum_neg")).alias("support"), F.col("cum_pos").alias("correct"), "pos_all", (F.col("pos_all") + F.col("neg_all")).alias("total"))
    r = r.withColumn("lcb", S.wilson_lower(F.col("correct"), F.col("support"), confidence))
    good = (F.col("support") >= min_support) & (F.col("lcb") >= target)
    pick = F.max_by(F.struct("threshold", "support", "correct", "lcb"), F.when(good, F.col("support")))
    tried = F.max(F.struct("lcb", "support", (-F.col("threshold") if upper else F.col("threshold")).alias("order"), "threshold", "correct"))
    a = r.agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("enabled"), pick.alias("best"), tried.alias("tried"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.coalesce(F.max("pos_all"), F.lit(0)).alias("reference"))
    at = lambda f: F.when(F.col("enabled"), F.col(f"best.{f}")).otherwise(F.col(f"tried.{f}"))
    none = "no_positive_reference_examples" if upper else "no_negative_reference_examples"
    reason = F.when(F.col("enabled"), F.lit(None)).when(F.col("total") == 0, "no_supervised_calibration_examples").when(F.col("reference") == 0, none)
    reason = reason.when(F.col("total") < min_support, "minimum_predicted_support_not_met").otherwise("target_wilson_lcb_not_met")
    support, correct = F.coalesce(at("support"), F.lit(0)), F.coalesce(at("correct"), F.lit(0))
    return a.select(
        "enabled", F.when(F.col("enabled"), F.col("best.threshold")).alias("threshold"), reason.alias("reason"), support.alias("support"), correct.alias("correct"), F.when(support > 0, correct / support).alias("observed"),
        F.coalesce(at("lcb"), F.lit(0.0)).alias("lcb"), S.ratio(support, F.col("total")).alias("coverage"), F.col("tried.threshold").alias("best_threshold"),
    )


def reliability(rows: DataFrame, bins: int = 10, p: str = "p", truth: str = "truth") -> DataFrame:
    """bin, n, mean_p, frequency for every bin."""
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    held = rows.groupBy(S.reliability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(truth).cast("double")).alias("frequency"))
    return spine.join(held, "bin", "left").fillna(0)


def calibration_error(rows: DataFrame, bins: int = 10, p: str = "p", truth: str = "truth") -> DataFrame:
    """ece and brier."""
    held = rows.groupBy(S.reliability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("m"), F.avg(F.col(truth).cast("double")).alias("f"), F.sum((F.col(p) - F.col(truth)) ** 2).alias("sq"))
    return held.agg((F.sum(F.col("n") * F.abs(F.col("m") - F.col("f"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def state_coverage(rows: DataFrame, states: list[str], column: str) -> DataFrame:
    """Count and share of every state in its order, zeros included."""
    spine = rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(states)], "position int, state string")
    held = rows.groupBy(F.col(column).alias("state")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return spine.join(held, "state", "left").fillna(0, ["n"]).crossJoin(F.broadcast(total)).select("position", "state", "n", S.ratio(F.col("n"), F.col("total")).alias("share"))  # one row


def macro_f1(counts: list[dict], labels: list[int]) -> float:
    """Mean over ``labels``, whether they occur or not, from {(truth, pred): n} tables added together."""
    total: dict = {}
    for c in counts:
        for k, n in c.items():
            total[k] = total.get(k, 0) + n
    f = []
    for x in labels:
        tp = total.get((x, x), 0)
        other = sum(n for (a, b), n in total.items() if (a == x) != (b == x))
        f.append(2 * tp / (2 * tp + other) if tp else 0.0)
    return sum(f) / len(f)


def bootstrap_lower(rows: DataFrame, group: str, labels: list[int], *, truth: str = "truth", pred: str = "pred", resamples: int = RESAMPLES, seed: int = 42, confidence: float = 0.95) -> float:
    """Lower bound of macro F1 under resampling of whole groups, with the standard generator's draws in the order of group names: for tables whose groups fit the driver. ``bootstrap_table`` draws in the cluster."""
    held: dict = {}
    for r in rows.groupBy(F.col(group).cast("string").alias(group), truth, pred).agg(F.count("*").alias("n")).orderBy(group).toLocalIterator():
        held.setdefault(r[0], {})[(r[1], r[2])] = r[3]
    if not held:
        return 0.0
    groups, rng = list(held.values()), random.Random(seed)
    draws = sorted(macro_f1([groups[rng.randrange(len(groups))] for _ in groups], labels) for _ in range(resamples))
    return draws[_order_statistic(resamples, confidence)]


def _order_statistic(resamples: int, confidence: float) -> int:
    """In floating point, as the fixed results have it: 100 for 2,000 resamples."""
    return max(0, math.ceil((1 - confidence) * resamples) - 1)


def bootstrap_table(rows: DataFrame, group: str, labels: list[int], *, truth: str = "truth", pred: str = "pred", resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(resample, macro_f1) under resampling of whole groups, in the cluster and the same for any partitioning.

    How often a resample draws a group is Poisson with mean one, from 16 bits of a hash
    of seed, block and group: a hash serves sixteen resamples. Counts are reduced before
    the shuffle; ``resamples`` rows come out.
    """
    t, p = F.col(truth), F.col(pred)
    cells = [(f"{k}{i}", cond) for i, x in enumerate(labels) for k, cond in (("tp", (t == x) & (p == x)), ("fp", (t != x) & (p == x)), ("fn", (t == x) & (p != x)))]
    g = rows.groupBy(F.col(group).cast("string").alias("g")).agg(*[F.count_if(c).alias(n) for n, c in cells])
    g = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 16) - 1))).alias("block"))
    g = g.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("block").cast("string"), F.lit(":"), F.col("g")), 256))
    for i in range(16):
        u = F.conv(F.substring("hash", 4 * i + 1, 4), 16, 10).cast("int")
        g = g.withColumn(f"k{i}", sum(((u >= edge).cast("int") for edge in POISSON), F.lit(0)))
    s = g.groupBy("block").agg(*[F.sum(F.col(f"k{i}") * F.col(n)).alias(f"{n}_{i}") for i in range(16) for n, _ in cells])
    each = lambda i: sum((S.f1(F.col(f"tp{x}_{i}"), F.col(f"fp{x}_{i}"), F.col(f"fn{x}_{i}")) for x in range(len(labels))), F.lit(0.0)) / len(labels)
    out = s.select(F.inline(F.array(*[F.struct((F.col("block") * 16 + i).alias("resample"), each(i).alias("macro_f1")) for i in range(16)])))
    return out.where(F.col("resample") < resamples)


def bootstrap_bound(table: DataFrame, resamples: int = RESAMPLES, confidence: float = 0.95) -> DataFrame:
    """The order statistic of ``bootstrap_table``'s rows: lower_bound, 0 without any."""
    return table.agg(F.coalesce(F.try_element_at(F.array_sort(F.collect_list("macro_f1")), F.lit(_order_statistic(resamples, confidence) + 1)), F.lit(0.0)).alias("lower_bound"))


def binary_gates(bias: DataFrame, style: DataFrame, group: str, *, targets: dict | None = None, resamples: int = RESAMPLES, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """One row: the measured values and ``failures`` of a frozen binary classifier. bias: truth, selected (state clear_bias); style: truth, pred, ``group``."""
    goal = BINARY_TARGETS | (targets or {})
    clear = decision(bias, confidence=confidence).select((F.col("tp") + F.col("fp")).alias("clear_selected"), F.col("precision_lower").alias("clear_precision"))
    t, hit = F.col("truth"), F.col("truth") == F.col("pred")
    sides = style.agg(*[F.count_if(t == i).alias(f"n{i}") for i in (0, 1)], *[F.count_if((t == i) & hit).alias(f"hit{i}") for i in (0, 1)])
    sides = sides.select(F.col("n0").alias("objective_support"), F.col("n1").alias("opinionated_support"), *[S.wilson_lower(F.col(f"hit{i}"), F.col(f"n{i}"), confidence).alias(n) for i, n in ((0, "objective_recall"), (1, "opinionated_recall"))])
    bound = bootstrap_bound(bootstrap_table(style, group, [0, 1], resamples=resamples, seed=seed), resamples, confidence).withColumnRenamed("lower_bound", "macro_f1_bound")
    least = goal["minimum_evaluable_support"]
    rules = [
        ("insufficient_clear_bias_selected_support", F.col("clear_selected") < least), ("insufficient_objective_style_support", F.col("objective_support") < least), ("insufficient_opinionated_style_support", F.col("opinionated_support") < least),
        ("clear_bias_precision_lcb_below_target", F.col("clear_precision") < goal["clear_bias_precision_lcb"]), ("opinion_style_macro_f1_bootstrap_lcb_below_target", F.col("macro_f1_bound") < goal["opinion_style_macro_f1_bootstrap_lcb"]),
        ("objective_style_recall_lcb_below_target", F.col("objective_recall") < goal["objective_style_recall_lcb"]), ("opinionated_style_recall_lcb_below_target", F.col("opinionated_recall") < goal["opinionated_style_recall_lcb"]),
    ]
    return _failing(clear.crossJoin(sides).crossJoin(bound), rules)  # one row each


def three_class_gates(bias: DataFrame, opinion: DataFrame, group: str, reports: DataFrame | None = None, *, targets: dict | None = None, resamples: int = RESAMPLES, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """One row: the measured values and ``failures`` of the three-class scorecard. bias: truth, selected; opinion: truth, pred (0 to 2), ``group``; reports: ``group``, gold (null: not judged), selected."""
    goal = THREE_CLASS_TARGETS | (targets or {})
    own = decision(bias, confidence=confidence).select((F.col("tp") + F.col("fn")).alias("bias_support"), F.col("precision_lower").alias("bias_precision"))
    middle = opinion.agg(F.count_if(F.col("truth") == 1).alias("middle_support"), F.count_if((F.col("truth") == 1) & (F.col("pred") == 1)).alias("hit"))
    middle = middle.select("middle_support", S.wilson_lower(F.col("hit"), F.col("middle_support"), confidence).alias("middle_recall"))
    bound = bootstrap_bound(bootstrap_table(opinion, group, [0, 1, 2], resamples=resamples, seed=seed), resamples, confidence).withColumnRenamed("lower_bound", "macro_f1_bound")
    judged = F.lit(None).cast("double").alias("report_precision")
    table = own.crossJoin(middle).crossJoin(bound)  # one row each
    if reports is not None:
        each = reports.where("gold is not null").groupBy(group).agg(F.bool_or("gold").cast("int").alias("truth"), F.bool_or("selected").alias("selected"))
        measured = each.agg(F.count("*").alias("n"), F.count_if((F.col("truth") == 1) & F.col("selected")).alias("tp"), F.count_if("selected").alias("picked"))
        table = table.crossJoin(measured.select(F.when(F.col("n") > 0, S.wilson_lower(F.col("tp"), F.col("picked"), confidence)).alias("report_precision")))  # one row
    else:
        table = table.select("*", judged)
    rules = [
        ("insufficient_locked_test_bias_positive_support", F.col("bias_support") < goal["locked_test_bias_positive_support"]), ("insufficient_locked_test_middle_support", F.col("middle_support") < goal["locked_test_middle_support"]),
        ("bias_positive_precision_lcb_below_target", F.col("bias_precision") < goal["bias_precision_lcb"]), ("article_report_precision_gate_not_evaluable", F.col("report_precision").isNull()),
        ("article_report_precision_lcb_below_target", F.col("report_precision") < goal["article_report_precision_lcb"]), ("opinion_macro_f1_lcb_below_target", F.col("macro_f1_bound") < goal["opinion_macro_f1_lcb"]),
        ("middle_recall_lcb_below_target", F.col("middle_recall") < goal["middle_recall_lcb"]),
    ]
    return _failing(table, rules)


def _failing(table: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    failures = F.filter(F.array(*[F.when(rule, name) for name, rule in rules]), lambda x: x.isNotNull())
    return table.withColumn("failures", failures).withColumn("promotion_state", F.when(F.size("failures") == 0, "eligible").otherwise("rejected"))


# --- retrieval ---


def recall_at(cases: DataFrame, hits: DataFrame, ks: list[int] = (1, 3, 5, 10)) -> DataFrame:
    """cases (case_id, answerable), hits (case_id, rank, relevant) -> share of answerable cases with a relevant hit in the first k."""
    first = hits.where("relevant").groupBy("case_id").agg(F.min("rank").alias("first"))
    joined = cases.where("answerable").join(first, "case_id", "left")
    return joined.agg(*[F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks])


def irrelevant_rate(hits: DataFrame, k: int = 5) -> DataFrame:
    """hits (case_id, rank, judgment: relevant, irrelevant or null); null where nothing is judged."""
    top = hits.where(F.col("rank") <= k)
    judged, bad = F.count("judgment"), F.count_if(F.col("judgment") == "irrelevant")
    return top.agg(judged.alias("judged"), F.count_if(F.col("judgment").isNull()).alias("unjudged"), F.when(judged > 0, bad / judged).alias("irrelevant_rate"))


def scenario_coverage(scenarios: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """scenarios (scenario_id, claim_ids) -> mean over scenarios of the share of claims with a relevant hit."""
    found = hits.where((F.col("rank") <= k) & F.col("relevant")).select(F.col("case_id").alias("claim_id")).distinct().withColumn("hit", F.lit(1.0))
    each = scenarios.select("scenario_id", F.explode("claim_ids").alias("claim_id")).join(found, "claim_id", "left").groupBy("scenario_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("covered"))
    return each.agg(F.avg("covered").alias("coverage"))


def latencies(rows: DataFrame, order: str, value: str, key: str) -> DataFrame:
    """Per key the first (cold) value, and median and 95th percentile of the others."""
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("_n", F.row_number().over(w))
    warm = F.when(F.col("_n") > 1, F.col(value))
    return r.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("cold"), F.percentile(warm, F.lit(0.5)).alias("warm_p50"), F.percentile(warm, F.lit(0.95)).alias("warm_p95"))
