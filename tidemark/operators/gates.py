"""Out-of-sample gates: ordered checks over a table with a row for each hypothesis.

Columns read: data_is_real, oos_events, oos_samples, oos_mean, val_events,
val_mean, cohen_d, controls (array of struct kind, n, mean, jaccard, p), years,
positive_ratio, sign_consistency, top1, loo_flips, fit_max, fit_scope, fit_hash,
and for the second version q, ci_lower, ci_upper, perm_p, perm_n, raw_effect,
style_neutral, segment_neutral, is_gated, problems (array of strings).  Any of
them may be null; a check that cannot be judged fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The registered thresholds.
MIN_EVENTS, MIN_VALIDATION, MAX_JACCARD, MIN_COHEN_D, MIN_EFFECT, ALPHA = 100, 60, 0.9, 0.02, 0.02, 0.05
MIN_YEARS, MIN_RATIO, MAX_TOP1, MIN_DECISIVE, MIN_SAMPLES, MIN_DRAWS, MIN_RETENTION = 3, 0.6, 0.5, 20, 8, 1000, 0.5
SEVERE = ("SYNTHETIC", "DEGRADED", "LEAKAGE", "SURVIVORSHIP_BIAS_CONFIRMED")


def sure(check: Column) -> Column:
    return F.coalesce(check, F.lit(False))


def _controls() -> dict[str, Column]:
    """Decisive controls, how many of them are beaten, and whether any overlaps the events too much."""
    decisive = F.filter("controls", lambda c: c["n"] >= MIN_DECISIVE)
    beaten = F.size(F.filter(decisive, lambda c: sure(F.col("oos_mean") > c["mean"])))
    return {"decisive": F.size(decisive), "beaten": beaten, "invalid": F.exists("controls", lambda c: sure(c["jaccard"] > MAX_JACCARD)), "best_p": F.array_min(F.transform(decisive, lambda c: c["p"]))}


def shared_checks(train_end: str) -> dict[str, Column]:
    c = _controls()
    stable = (F.col("years") >= MIN_YEARS) & (F.col("positive_ratio") >= MIN_RATIO) & (F.col("sign_consistency") >= MIN_RATIO)
    same_sign = (F.signum("oos_mean") == F.signum("val_mean")) & (F.col("oos_mean") != 0) & (F.col("val_events") >= MIN_VALIDATION)
    return {
        "events": (F.col("oos_events") >= MIN_EVENTS) & (F.col("oos_samples") > 0),
        "validation": F.col("val_events") >= MIN_VALIDATION,
        "control_valid": ~c["invalid"] & (c["decisive"] > 0),
        "direction": same_sign,
        "beats_controls": (c["decisive"] > 0) & (c["beaten"] == c["decisive"]),
        "significance": c["best_p"] < ALPHA,
        "stable": stable,
        "not_single_name": (F.col("top1") <= MAX_TOP1) & (F.col("loo_flips") == 0),
        "calibration": (F.col("fit_scope") == "TRAIN_ONLY") & (F.length("fit_hash") > 0) & (F.col("fit_max") <= F.to_date(F.lit(train_end))),
        "invalid": c["invalid"],
        "no_decisive": c["decisive"] == 0,
        "none_beaten": c["beaten"] == 0,
    }


def oos_gate(hypotheses: DataFrame, key: str, train_end: str) -> DataFrame:
    """``key``, the ten checks g1 .. g10 (g2b does not block) and ``status``, the first that applies."""
    k = {name: sure(check) for name, check in shared_checks(train_end).items()}
    checks = {
        "g1": sure(F.col("data_is_real")), "g2": k["events"], "g2b": k["validation"], "g3": k["control_valid"], "g4": k["direction"], "g5": k["beats_controls"],
        "g6": sure(F.abs("cohen_d") >= MIN_COHEN_D), "g7": k["significance"], "g8": k["stable"], "g9": k["not_single_name"], "g10": k["calibration"],
    }
    judged = hypotheses.select("*", *[c.alias(n) for n, c in checks.items()], *[k[n].alias(n) for n in ("invalid", "no_decisive", "none_beaten")])
    is_not = lambda name: ~F.col(name)
    status = (
        F.when(is_not("g1"), "NO_REAL_DATA")
        .when((F.coalesce("oos_events", F.lit(0)) == 0) | (F.coalesce("oos_samples", F.lit(0)) == 0), "NOT_RUN")
        .when((F.col("oos_samples") < MIN_SAMPLES) | is_not("g2"), "INSUFFICIENT_SAMPLE")
        .when(F.col("invalid"), "INVALID_CONTROL")
        .when(F.col("no_decisive"), "INCONCLUSIVE")
        .when(is_not("g5"), F.when(F.col("none_beaten"), "NO_SIGNAL").otherwise("INCONCLUSIVE"))
        .when(is_not("g4") | is_not("g10"), "INCONCLUSIVE")
        .when(is_not("g6") | is_not("g7") | is_not("g8") | is_not("g9"), "WEAK_EVIDENCE")
        .otherwise("OOS_CANDIDATE_SUPPORTED")
    )
    return judged.select(key, *checks, status.alias("status"))


def gate_v2(hypotheses: DataFrame, key: str, train_end: str) -> DataFrame:
    """``key``, the twelve checks a .. l (a2 does not block) and ``status``; only all twelve together give the last one."""
    k = {name: sure(check) for name, check in shared_checks(train_end).items()}
    severe = F.exists("problems", lambda w: F.upper(w).rlike("|".join(SEVERE)))
    kept = F.when(F.col("raw_effect") != 0, F.col("style_neutral") / F.col("raw_effect"))
    style = (F.col("style_neutral") > 0) & (kept >= MIN_RETENTION)
    checks = {
        "a": k["events"], "a2": k["validation"], "b": k["control_valid"], "c": k["direction"], "d": k["beats_controls"],
        "e": sure((F.abs("cohen_d") >= MIN_COHEN_D) & (F.abs("oos_mean") >= MIN_EFFECT)), "f": sure(F.col("q") <= ALPHA),
        "g": sure((F.col("ci_lower") > 0) & F.col("ci_upper").isNotNull()), "h": sure((F.col("perm_n") >= MIN_DRAWS) & (F.col("perm_p") <= ALPHA)),
        "i": k["stable"], "j": k["not_single_name"], "k": sure(style) & F.coalesce(F.col("segment_neutral") > 0, F.lit(True)),
        "l": sure(F.col("data_is_real") & ~severe),
    }
    judged = hypotheses.select("*", *[c.alias(n) for n, c in checks.items()], *[k[n].alias(n) for n in ("invalid", "no_decisive", "none_beaten")])
    is_not = lambda name: ~F.col(name)
    blocking = [is_not(n) for n in "efghijkl"]
    failed = blocking[0]
    for check in blocking[1:]:
        failed = failed | check
    status = (
        F.when(~sure(F.col("is_gated")), "EXPLORATORY_NOT_GATED")
        .when(~sure(F.col("data_is_real")), "NO_REAL_DATA")
        .when((F.coalesce("oos_events", F.lit(0)) == 0) | (F.coalesce("oos_samples", F.lit(0)) == 0), "NOT_RUN")
        .when((F.col("oos_samples") < MIN_SAMPLES) | is_not("a"), "INSUFFICIENT_SAMPLE")
        .when(F.col("invalid"), "INVALID_CONTROL")
        .when(F.col("no_decisive"), "INCONCLUSIVE")
        .when(is_not("d"), F.when(F.col("none_beaten"), "NO_SIGNAL").otherwise("INCONCLUSIVE"))
        .when(is_not("c"), "INCONCLUSIVE")
        .when(failed, "WEAK_EVIDENCE")
        .otherwise("SUPPORTED_OUT_OF_SAMPLE")
    )
    return judged.select(key, *checks, status.alias("status"))
