"""All registered queries (importing the modules registers them)."""

from textmine.plans import queries  # noqa: F401
from textmine.plans import text_queries  # noqa: F401
from textmine.plans import model_queries  # noqa: F401
from textmine.plans import feature_set_queries  # noqa: F401
from textmine.plans import variant_queries  # noqa: F401
from textmine.plans.queries import ORACLE, QUERIES  # noqa: F401
