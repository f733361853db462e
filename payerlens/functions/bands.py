"""Piecewise maps from a number to a label or a score.

A band table lists (edge, result) pairs in rising order plus the result above
the last edge. ``closed='upper'`` keeps a value equal to an edge in the band
below the edge, ``closed='lower'`` moves it to the band above.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from payerlens.functions.clean import _col


@dataclass(frozen=True)
class Bands:
    steps: tuple
    top: object
    closed: str = "lower"
    missing: object = None

    def __call__(self, c: Column | str) -> Column:
        c = _col(c)
        out = F.when(c.isNull(), F.lit(self.missing))
        for edge, result in self.steps:
            inside = c <= edge if self.closed == "upper" else c < edge
            out = out.when(inside, F.lit(result))
        return out.otherwise(F.lit(self.top))


# Edges and results of every band table.
VOLUME_DEVIATION_RISK = Bands(((5, 0.0), (10, 0.2), (20, 0.5), (30, 0.8)), 1.0, "upper")
VOLUME_RISK_LEVELS = {0.0: "LOW", 0.2: "MODERATE", 0.5: "MEDIUM", 0.8: "HIGH", 1.0: "CRITICAL"}
ZSCORE_RISK = Bands(((1, 0.0), (2, 40.0), (3, 70.0)), 100.0)
PERCENTILE_RISK = Bands(((75, 0.0), (90, 40.0), (95, 70.0)), 100.0)
PHARMACY_RISK_LEVEL = Bands(
    ((25, "Low"), (50, "Medium"), (75, "High")), "Critical", missing="Insufficient History"
)
AUTH_RISK_LEVEL = Bands(
    ((0.25, "LOW"), (0.5, "MODERATE"), (0.75, "HIGH")), "CRITICAL", missing="INSUFFICIENT_HISTORY"
)
QUALITY_STATUS = Bands(
    ((2.5, "critical"), (5, "poor"), (7.5, "moderate"), (9, "good")), "excellent"
)
AUTH_CATEGORY = Bands(
    ((50, "Critical"), (70, "Poor"), (85, "Warning"), (95, "Good")), "Excellent"
)
PSI_LABEL = Bands(
    ((0.1, "NORMAL"), (0.25, "MODERATE DRIFT")), "SIGNIFICANT DRIFT", missing="NOT_AVAILABLE"
)
PSI_STATUS = Bands(
    ((0.1, "NORMAL"), (0.25, "MODERATE_DRIFT")), "SIGNIFICANT_DRIFT", missing="NO_DATA"
)
DRUG_SEVERITY = Bands(((3, "LOW"), (5, "MEDIUM")), "HIGH")
YEARLY_SEVERITY = Bands(((4, "LOW"), (5, "MEDIUM")), "HIGH")
CLAIM_RISK_LEVEL = Bands(
    ((0.24, "LOW"), (0.49, "MEDIUM"), (0.74, "HIGH")), "CRITICAL", "upper", "UNKNOWN"
)
PROVIDER_RISK_LEVEL = Bands(
    ((0.25, "Low"), (0.5, "Moderate"), (0.75, "High")), "Critical", "upper"
)
GAUGE = Bands(
    ((0.1, "Excellent"), (0.25, "Very Good"), (0.5, "Good"), (0.75, "Fair")), "Poor"
)


def volume_risk_level(risk: Column | str) -> Column:
    """Level of one of the five deviation risks; anything else is UNKNOWN."""
    risk = _col(risk)
    out = F.when(risk.isNull(), "INSUFFICIENT_HISTORY")
    for value, label in VOLUME_RISK_LEVELS.items():
        out = out.when(risk == value, label)
    return out.otherwise("UNKNOWN")


def severity_from_pct(pct: Column | str) -> Column:
    """Above 15 critical, from 1 high, above 0 warning, else info."""
    pct = _col(pct)
    return F.when(pct > 15, "critical").when(pct >= 1, "high").when(pct > 0, "warning").otherwise("info")


def claims_severity(count, max_z, max_psi) -> Column:
    """Severity of a provider month from its signal count and strongest signals."""
    count, max_z, max_psi = _col(count), _col(max_z), _col(max_psi)
    strong = F.coalesce(max_z >= 7, F.lit(False)) | F.coalesce(max_psi >= 0.75, F.lit(False))
    return (
        F.when(count <= 0, "NORMAL")
        .when((count >= 4) | strong, "HIGH")
        .when(count >= 2, "MEDIUM")
        .otherwise("LOW")
    )


def health_score(risk: Column | str) -> Column:
    """Gauge reading: (1 - risk) as a percentage."""
    return (F.lit(1.0) - _col(risk)) * 100.0
