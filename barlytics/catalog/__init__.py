"""All registered queries; importing this package fills the registry."""

from barlytics.catalog import series, scalars, market, paths, checks, learn, live, storage  # noqa: F401
from barlytics.catalog.base import ORACLES, QUERIES  # noqa: F401
