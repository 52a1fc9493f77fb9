"""All checks, collected by importing the modules that define them."""

from checks import core_checks, measure_checks, page_checks, response_checks, route_checks, scalar_checks  # noqa: F401
from checks.registry import CHECKS, FRAGMENTS

__all__ = ["CHECKS", "FRAGMENTS"]
