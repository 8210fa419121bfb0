"""All registered queries."""

from . import batch, given, grids, models, panels, profiles  # noqa: F401
from .fixtures import COVERS, ORACLES, QUERIES  # noqa: F401
