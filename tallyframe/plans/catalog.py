"""All queries of the library; importing a module of plans registers its queries."""

from . import basics, disclosures, entities, failures, forms, funds, holdings, ledgers, pages, parts, pipelines, records, scalars, series  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
