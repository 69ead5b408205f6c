"""Queries over the driver's tables; importing any of its modules registers them all."""

from tideline.plans import registry  # noqa: F401
