from tidemark.sources.tables import Warehouse

__all__ = ["Warehouse"]
