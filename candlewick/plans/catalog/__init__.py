"""Registered queries by family."""

from importlib import import_module

FAMILIES = ("bars", "analytics", "trades", "texts", "streams")


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
