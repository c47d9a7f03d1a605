"""threadloom: a PySpark-native analytics engine for threaded discussions."""

from threadloom.session import session

__all__ = ["session"]
