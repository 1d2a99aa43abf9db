"""Every operator as a query over the driver tables, with SQL where SQL can express it."""

from importlib import import_module

from dustspark.plans.catalog.base import CATALOG

for _part in ("scans", "cleaning", "joins", "aggregates", "windows", "folds", "scalars", "retrieval",
              "evaluation", "reports", "models", "streams"):
    import_module(f"{__name__}.{_part}")

__all__ = ["CATALOG"]
