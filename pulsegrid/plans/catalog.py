"""All registered queries (importing a catalog module registers its queries)."""
from . import detect_catalog, filters_catalog, fusion_catalog, jobs_catalog, movers_catalog, raster_catalog, signal_catalog, sources_catalog, spectra_catalog, tracks_catalog  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
