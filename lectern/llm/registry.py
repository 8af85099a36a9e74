"""The modules of this subpackage that hold queries."""

import importlib

NAMES = ["p01_formatting", "p03_markup", "p05_scans", "p06_survivors", "p07_neighbours", "p08_tokens", "p09_packing", "p10_stuffing"]


def modules() -> list:
    return [importlib.import_module(f"lectern.llm.{n}") for n in NAMES]
