"""All queries of the engine: importing this module fills the registry."""

from __future__ import annotations

import importlib

from foliomill.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401

for _name in ("pages", "regions", "scans", "projections", "filters", "joins", "aggregates", "windows", "sets", "strings", "geometry", "clusters", "gates", "tables", "rules", "layout", "assembly", "details", "rasters"):
    importlib.import_module(f"foliomill.operators.{_name}")
