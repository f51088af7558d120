"""Security-event normalization on PySpark DataFrames."""

from siemloom.session import get_session

__all__ = ["get_session"]
