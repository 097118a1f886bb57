"""Score, probability and metric arithmetic as Column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---
BIAS_WEIGHT, OPINION_WEIGHT = 0.65, 0.35
COVERAGE_WEIGHT, PEAK_WEIGHT, PEAK_FRACTION = 0.5, 0.5, 0.15
BUCKETS = [(20, "Low"), (45, "Moderate"), (70, "High")]
TOP_BUCKET = "Severe"


def surrogate_probability(c: Column) -> Column:
    """Stands in for a model: a uniform hash of the text in [0, 1). Says nothing about quality."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % 10_000 / F.lit(10_000.0)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def round_even(c: Column, digits: int = 0) -> Column:
    """Half to even on the scaled double, as SQL's round_even does it; ``bround`` goes by the shortest decimal form, which may lie on the other side of a tie."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def signal(p_bias: Column, p_opinion: Column) -> Column:
    return clamp(F.coalesce(p_bias, F.lit(0.0)) * BIAS_WEIGHT + F.coalesce(p_opinion, F.lit(0.0)) * OPINION_WEIGHT)


def signal_from_labels(bias: Column, opinion: Column, positive: str = "Biased", factual: str = "Entirely factual") -> Column:
    """The older form: two label -> probability maps."""
    return clamp(F.coalesce(F.try_element_at(bias, F.lit(positive)), F.lit(0.0)) * BIAS_WEIGHT + F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_element_at(opinion, F.lit(factual)), F.lit(0.0))) * OPINION_WEIGHT)


def bucket(score: Column) -> Column:
    out = F
    for limit, name in BUCKETS:
        out = out.when(score < limit, name)
    return out.otherwise(TOP_BUCKET)


def caption(score: Column, selected: Column, total: Column) -> Column:
    return F.format_string("%s bias — %d of %d relevant sentence(s) flagged for review.", bucket(score), selected, total)


def sigmoid(logit: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def binary_loss(label: Column, logit: Column, temperature: float = 1.0) -> Column:
    """Cross entropy of one row, stable for large logits."""
    x = logit / temperature
    return F.greatest(x, F.lit(0.0)) - x * label + F.log1p(F.exp(-F.abs(x)))


def three_tiers(q: Column, w: Column) -> Column:
    """Tier probabilities from the two binary heads."""
    return F.array(1 - q, q * (1 - w), q * w)


def wilson_lower(successes: Column, trials: Column, confidence: float = 0.95) -> Column:
    """One-sided Wilson lower bound; 0 without trials."""
    z = NormalDist().inv_cdf(confidence)
    n, p = trials.cast("double"), successes / trials
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(trials > 0, F.greatest(F.lit(0.0), bound)).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; unequal lengths are an error."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(value)


def warmup_decay(step: Column, warmup: int, total: int) -> Column:
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(F.greatest(F.lit(0.0), 1 - (step - warmup) / F.lit(float(max(1, total - warmup)))))


def reliability_bin(p: Column, bins: int) -> Column:
    """Equal-width bin, the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
