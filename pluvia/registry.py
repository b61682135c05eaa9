"""Plain registries by name: sources, formatters, models, metrics, outputs. Unknown names raise."""
from collections.abc import Callable


class Registry(dict):
    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def add(self, name: str, f: Callable | None = None):
        """Registers f, or what it decorates."""
        if f is None:
            return lambda g: self.add(name, g)
        self[name] = f
        return f

    def __missing__(self, name):
        raise ValueError(f"unknown {self.kind} {name!r}: {sorted(self)}")


SOURCES = Registry("source")        # (spark, spec) -> DataFrame
FORMATTERS = Registry("formatter")  # DataFrame -> DataFrame
MODELS = Registry("model")          # DataFrame -> fitted transformer
METRICS = Registry("metric")        # (pred, label, threshold) -> aggregate Column
PYTHON_METRICS: set = set()         # names of metrics that are aggregates in Python, which Spark computes apart from its own
OUTPUTS = Registry("output")        # DataFrame -> DataFrame of report rows
