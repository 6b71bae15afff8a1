"""Anomalies of a series: rolling or exponentially weighted baselines, z-scores, severities, merged events.

Records are aggregated before they get here. A filled series is limited by its grid, one without gap filling isn't, so all order is by
blocks of neighbouring buckets (see ``order``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import fading_sum, numbered, with_neighbours

SENSITIVITY = {"low": 4.0, "medium": 3.0, "high": 2.0}
NOISE = 1e-11  # relative; scans are exact to some 1e-14
SEVERITY = ((6.0, "critical"), (4.5, "high"), (3.5, "medium"))


@dataclass(frozen=True)
class Detector:
    window: int = 30
    threshold: float | None = None  # wins over the sensitivity
    sensitivity: str = "medium"
    min_history: int = 10
    mode: str = "spikes"
    method: str = "rolling"
    alpha: float = 0.3

    def __post_init__(self):
        for ok, what in (
            (self.window >= 2, f"window {self.window}"), (self.threshold is None or self.threshold > 0, f"threshold {self.threshold}"),
            (self.sensitivity in SENSITIVITY, f"sensitivity '{self.sensitivity}'"), (self.mode in ("spikes", "dips", "both"), f"mode '{self.mode}'"),
            (self.method in ("rolling", "ewma"), f"method '{self.method}'"), (0 < self.alpha <= 1, f"alpha {self.alpha}"),
        ):
            if not ok:
                raise ValueError(f"invalid {what}")

    @property
    def limit(self) -> float:
        return SENSITIVITY[self.sensitivity] if self.threshold is None else self.threshold


def severity(z: Column) -> Column:
    out = F.when(F.abs(z) >= SEVERITY[0][0], SEVERITY[0][1])
    for least, name in SEVERITY[1:]:
        out = out.when(F.abs(z) >= least, name)
    return out.otherwise("low")


def scores(buckets: DataFrame, d: Detector = Detector()) -> DataFrame:
    """epoch, label, value, idx, mean, sd, z and direction (null if not flagged) of every bucket with enough history.

    The buckets are written and numbered first; no window then spans all of them. The exponentially weighted mean and variance are scans of one
    linear recurrence each: of the values, and of the squared distances to the mean.
    """
    rows = numbered(buckets.select("epoch", "label", F.col("value").cast("double").alias("value")), "epoch")
    if d.method == "rolling":

        def made(order):
            frame = order.rowsBetween(-d.window, -1)
            return {"history": F.count("value").over(frame), "mean": F.avg("value").over(frame), "sd": F.coalesce(F.stddev_samp("value").over(frame), F.lit(0.0))}

        rows = with_neighbours(rows, d.window, made).withColumn("off", F.col("value") - F.col("mean"))
    else:
        rows = fading_sum(rows.withColumn("history", F.col("place")), F.lit(d.alpha) * F.col("value"), 1 - d.alpha, F.col("value"), "mean")
        off = F.col("value") - F.col("mean")
        none = F.abs(off) <= NOISE * F.greatest(F.abs("value"), F.abs("mean"))  # sums of a scan round otherwise than steps: a flat series has no distances
        rows = rows.withColumn("off", F.when(none, 0.0).otherwise(off))
        rows = fading_sum(rows, F.lit(d.alpha) * F.col("off") * F.col("off"), 1 - d.alpha, F.lit(0.0), "var").withColumn("sd", F.sqrt("var"))
    rows = rows.withColumn("idx", (F.col("place") + 1).cast("int")).filter(F.col("history") >= d.min_history)
    rows = rows.withColumn("z", F.col("off") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    up, down = F.lit(d.mode != "dips") & (F.col("z") >= d.limit), F.lit(d.mode != "spikes") & (F.col("z") <= -d.limit)
    return rows.withColumn("direction", F.when(up, "up").when(down, "down")).select("epoch", "label", "value", "idx", "mean", "sd", "z", "direction")


def points(scored: DataFrame) -> DataFrame:
    """Flagged buckets; figures rounded to two places, severity from the exact score."""
    two = lambda c, n: F.round(c, 2).alias(n)
    return scored.filter("direction is not null").select("epoch", "label", "value", "idx", two("mean", "baseline_mean"), two("sd", "baseline_sd"), two("z", "zscore"), "direction", severity(F.col("z")).alias("severity"))


def risk(scored: DataFrame) -> DataFrame:
    """One row: the greatest absolute score, flagged or not."""
    return scored.agg(F.coalesce(F.round(F.max(F.abs("z")), 2), F.lit(0.0)).alias("risk"))


def events(flagged: DataFrame) -> DataFrame:
    """Runs of neighbouring points as one event each: bounds, number of buckets, peak value, peak score and its severity."""
    first = F.max_by("zscore", F.struct(F.abs("zscore"), -F.col("idx"))).alias("peak_z")
    rows = numbered(flagged, "idx").withColumn("island", F.col("idx") - F.col("place")).groupBy("island").agg(
        F.min("epoch").alias("start_epoch"), F.max("epoch").alias("end_epoch"), F.min_by("label", "epoch").alias("start_label"), F.max_by("label", "epoch").alias("end_label"),
        F.count("*").alias("buckets"), F.greatest(F.max("value"), F.lit(0.0)).alias("peak_value"), first,
    )
    return rows.drop("island").withColumn("severity", severity(F.col("peak_z")))


def detect(buckets: DataFrame, d: Detector = Detector()) -> dict:
    """points, events, risk and the settings, as plain values."""
    scored = scores(buckets, d).persist()
    flagged = points(scored)
    out = {"points": [r.asDict() for r in flagged.orderBy("epoch").collect()], "events": [r.asDict() for r in events(flagged).orderBy("start_epoch").collect()], "risk": risk(scored).first()["risk"]}
    scored.unpersist()
    return out | {"config": {"window": d.window, "threshold": d.limit, "min_history": d.min_history, "mode": d.mode, "method": d.method, "alpha": d.alpha}}


def risk_score(buckets: DataFrame, d: Detector = Detector()) -> float:
    return risk(scores(buckets, d)).first()["risk"]


def sensitivity_threshold(name: str) -> float | None:
    return SENSITIVITY.get(name)


def describe_point(p: dict) -> str:
    return f"{p['label']}  value {int(p['value'])} vs baseline {p['baseline_mean']:.2f} (z={p['zscore']:.2f}, {p.get('direction') or '?'}, {p['severity']})"


def describe_event(e: dict) -> str:
    span = e["start_label"] or "?"
    span += f" .. {e['end_label']}" if e["end_label"] and e["end_label"] != span else ""
    return f"{span}  {e['buckets']} bucket(s), peak {int(e['peak_value'])} (z={e['peak_z']:.2f}, {e['severity']})"


def event_text() -> Column:
    """``describe_event`` as a column of ``events``."""
    span = F.concat(F.coalesce("start_label", F.lit("?")), F.when(F.col("end_label") != F.coalesce("start_label", F.lit("?")), F.concat(F.lit(" .. "), "end_label")).otherwise(""))
    return F.concat(span, F.lit("  "), F.col("buckets"), F.lit(" bucket(s), peak "), F.col("peak_value").cast("long"), F.lit(" (z="), F.format_string("%.2f", "peak_z"), F.lit(", "), "severity", F.lit(")"))
