"""Point-in-time feature data on Spark DataFrames."""

from tidemark.model import Feature, FeatureViewSpec
from tidemark.operators.asof import asof_join
from tidemark.operators.latest import latest_per_entity
from tidemark.operators.merge import merge_fields
from tidemark.plans.store import FeatureTables

__all__ = [
    "Feature",
    "FeatureTables",
    "FeatureViewSpec",
    "asof_join",
    "latest_per_entity",
    "merge_fields",
]
