"""All registered queries."""

from chartloom.plans import evaluation, external, extraction, feature, modelling, relational, texts  # noqa: F401
from chartloom.plans.registry import ORACLES, QUERIES  # noqa: F401
