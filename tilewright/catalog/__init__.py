"""Every registered query with the SQL that checks it."""

from importlib import import_module

MODULES = ("partition", "geodesy", "text", "layers", "lines", "tiles", "joins", "shapes", "files")


def load():
    from tilewright.catalog import registry

    for name in MODULES:
        import_module(f"tilewright.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
