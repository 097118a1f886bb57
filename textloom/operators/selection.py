"""Which sentences are flagged: by the labels alone, or by thresholds of two heads and of a report trigger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---
BIASED, FACTUAL = "Biased", "Entirely factual"


@dataclass(frozen=True)
class Gate:
    """A head's threshold; one without is enabled but can't be met."""

    enabled: bool = False
    threshold: float | None = None

    def failure(self, score: Column, name: str) -> Column:
        """Null where the score passes."""
        if not self.enabled:
            return F.lit(f"{name}_head_disabled")
        if self.threshold is None:
            return F.lit(f"{name}_missing_threshold")
        return F.when(~F.coalesce(score >= self.threshold, F.lit(False)), f"{name}_below_threshold")


def _listed(*reasons: Column) -> Column:
    return F.filter(F.array(*reasons), lambda x: x.isNotNull())


def by_labels(bias_label: Column, opinion_label: Column) -> Column:
    """Struct selected, reasons, abstained, score, status: any positive label selects."""
    reasons = _listed(F.when(bias_label == BIASED, "bias_argmax"), F.when(opinion_label != FACTUAL, "opinion_argmax"))
    abstained = _listed(F.when(F.size(reasons) == 0, "no_positive_label"))
    return F.struct((F.size(reasons) > 0).alias("selected"), reasons.alias("reasons"), abstained.alias("abstained"), F.lit(None).cast("double").alias("score"), F.lit("uncertain").alias("status"))


def by_thresholds(bias_label: Column, opinion_label: Column, p_biased: Column, p_factual: Column, *, bias: Gate = Gate(), opinion: Gate = Gate(), report: Gate = Gate(), compatible: bool = False) -> Column:
    """The same struct: a positive label counts if its head's gate passes its score; an enabled report gate decides alone, on the larger score of the two.

    ``abstained`` holds every gate that failed, and is empty where the sentence is selected.
    """
    biased, tinted, p_opinion = bias_label == BIASED, opinion_label != FACTUAL, 1 - p_factual
    positive, score = biased | tinted, F.greatest(p_biased, p_opinion)
    failures = [F.when(biased, bias.failure(p_biased, "bias")), F.when(tinted, opinion.failure(p_opinion, "opinion")), F.when(~positive, "no_positive_label")]
    if report.enabled:
        failed = report.failure(score, "report_trigger")
        failures.append(failed if report.threshold is None else F.when(positive, failed))
        reasons = _listed(F.when(positive & failed.isNull(), "report_trigger_threshold_met"))
    else:
        reasons = _listed(F.when(biased & failures[0].isNull(), "bias_threshold_met"), F.when(tinted & failures[1].isNull(), "opinion_threshold_met"))
    selected = F.size(reasons) > 0
    status = F.lit("uncertain") if compatible else F.when(selected, "confident").otherwise("abstained")
    none = F.array().cast("array<string>")
    return F.struct(selected.alias("selected"), reasons.alias("reasons"), F.when(selected, none).otherwise(_listed(*failures)).alias("abstained"), score.alias("score"), status.alias("status"))
