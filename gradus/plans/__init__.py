"""The registered queries: adapters onto the driver's tables, plans and their SQL."""

from gradus.plans import queries, records, reports

__all__ = ["queries", "records", "reports"]
