"""Market time-series lakehouse on PySpark.

Every operator is a function from DataFrame to DataFrame; only ``sinks``,
``streaming`` and ``plans.medallion`` start jobs of their own, next to the small
bounded statistics that ``session.stage`` writes to the shared scratch folder.
"""
