"""Queries by topic; each module has QUERIES and, where SQL can express them, SQL."""

CORE_MODULES = ["meshwright.plans.records", "meshwright.plans.scalar_queries", "meshwright.plans.network_queries", "meshwright.plans.raster_queries", "meshwright.plans.evaluation_queries", "meshwright.plans.pipeline_queries", "meshwright.plans.source_queries"]
