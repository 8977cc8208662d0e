from .tides import Tide, Step, tide_documents, tide_statistics, tide_ticks

__all__ = ["Step", "Tide", "tide_documents", "tide_statistics", "tide_ticks"]
