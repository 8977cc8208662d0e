from .pipeline import aggregate, facets, find

__all__ = ["aggregate", "facets", "find"]
