"""Which form of a payload a reader gets: route by ratio, thresholds that follow retrievals, the gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import text


def ratio_route(n_in: Column, n_out: Column, keep: Column | float, soft: Column | float) -> Column:
    share = F.when(n_in > 0, 1 - n_out / n_in).otherwise(F.lit(-1.0))
    return F.when(share >= keep, "Keep").when(share >= soft, "Soft").otherwise("Passthrough")


def routed(history: DataFrame, mode: str = "balanced") -> DataFrame:
    """history with ratio_route, beats_guardrail, gains and meaningful."""
    keep, soft = K.ROUTE_MODES[mode]
    a, b = F.col("input_bytes"), F.col("output_bytes")
    return history.withColumns({
        "ratio_route": ratio_route(a, b, F.lit(keep), F.lit(soft)), "beats_guardrail": text.beats_guardrail(a, b), "gains": text.gains(a, b), "meaningful": text.is_meaningful(a, b),
    })


def adapted(rates: DataFrame, mode: str = "balanced") -> DataFrame:
    """rates (with a column `rate`) and the thresholds that follow: what is retrieved often is reduced less."""
    keep, soft = K.ROUTE_MODES[mode]
    rate = F.col("rate")
    return rates.withColumns({
        "keep": F.when(rate > 0.25, F.least(F.lit(keep + 0.15), F.lit(0.95))).when(rate > 0.05, F.least(F.lit(keep + 0.05), F.lit(0.90))).otherwise(keep),
        "soft": F.when(rate > 0.25, F.least(F.lit(soft + 0.10), F.lit(0.85))).when(rate > 0.05, F.least(F.lit(soft + 0.03), F.lit(0.80))).otherwise(soft),
    })


def passthrough_reason(recovery: Column, structured: Column, capped: Column, guardrail: Column, fidelity: Column) -> Column:
    """Why a payload is left as it is; the first that holds. structured: a kind or null; the others boolean."""
    return (
        F.when(recovery, "own recovery command").when(structured.isNotNull(), F.concat(F.lit("structured:"), structured)).when(capped, "host output cap")
        .when(~guardrail, "below guardrail").when(~fidelity, "would have dropped the failure")
    )
