"""Audit operators for large text corpora and catalogs, as Spark DataFrame functions."""

from corpuswarden.session import get_session

__all__ = ["get_session"]
