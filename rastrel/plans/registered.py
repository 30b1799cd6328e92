"""All registered queries of the raster operators, and their SQL."""

from . import containers, cycles, diagnostics, discovery, elastic, features, markers, nearest, propagation, pyramids, stitching  # noqa: F401  (they register their queries)
from .catalog import ORACLES, QUERIES  # noqa: F401
