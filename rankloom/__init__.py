"""rankloom: a PySpark-native engine that ranks text retrievers without relevance labels."""

__version__ = "0.1.0"


def __getattr__(name: str):
    """The public names, loaded when asked for."""
    import importlib

    where = {
        "run": "plans.pipeline", "predict": "plans.pipeline", "cache_layout": "ident", "prepare": "operators.publish", "HttpClient": "chat", "MockClient": "chat",
        "Result": "operators.results", "Results": "operators.results", "load_results": "operators.results", "session": "runtime",
    }
    if name in where:
        return getattr(importlib.import_module(f"rankloom.{where[name]}"), name)
    raise AttributeError(name)
