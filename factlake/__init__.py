"""Static analysis of contract sources and preparation of training text on Spark.

The public names: `audit` (ranked findings of source files), `rule` and `constraint` (register a rule or a constraint), the modules
`rules`, `candidates` (second and third generation), `graphs`, `evaluate`, `reports` and `rollups`, and sources and sinks. They are
imported when they are first used, so that a Python worker that needs one module doesn't load the others."""

from importlib import import_module

_PLACES = {
    **{name: f".plans.{name}" for name in ("candidates", "evaluate", "graphs", "reports", "rollups", "rules")}, **{name: ".plans.rules" for name in ("audit", "constraint", "rule")},
    **{name: ".sources.tables" for name in ("ParquetStore", "Store", "append", "latest", "put_objects", "source_files", "table")},
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module = import_module(_PLACES[name], __name__)
    return module if _PLACES[name].endswith(f".{name}") else getattr(module, name)
