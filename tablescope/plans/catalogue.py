"""Imports every plan module so that its queries register."""

import importlib

from tablescope.plans.registry import QUERIES

AREAS = (
    "profiling",
    "usage",
    "presentation",
    "chats",
    "feedback",
    "assets",
    "mining",
    "io",
    "sqlsurface",
    "streams",
)

for _area in AREAS:
    importlib.import_module(f"tablescope.plans.{_area}")

__all__ = ["QUERIES"]
