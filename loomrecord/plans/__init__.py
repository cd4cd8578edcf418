"""All registered queries. Importing this package fills the registry."""

from loomrecord.plans import catalogs, core, datasets, physical, lineage, relations, telemetry, transcripts  # noqa: F401
from loomrecord.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
