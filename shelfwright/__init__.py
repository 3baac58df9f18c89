"""Product-catalogue analytics as Spark DataFrame operators."""

from shelfwright.session import build_session, configure

__all__ = ["build_session", "configure"]
