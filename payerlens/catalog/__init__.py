"""Ready-to-run queries over the given star-schema tables, with matching SQL."""

from importlib import import_module

SECTIONS = (
    "volume",
    "sla",
    "pharmacy",
    "quality_claims",
    "quality_other",
    "anomaly",
    "risk",
    "results",
    "reports",
    "basics",
)


def load():
    """Import every section once and return the filled registry."""
    for name in SECTIONS:
        import_module(f"payerlens.catalog.{name}")
    return import_module("payerlens.catalog.registry")
