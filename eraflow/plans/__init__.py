"""Registered queries; importing the package fills the registry."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import calendars, cleaning, core, crosses, eras, joins, learning, profiles, streams, weighted, windows  # noqa: F401
from . import features  # noqa: F401  (its SQL joins that of the others)
