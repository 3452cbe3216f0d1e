"""All registered queries; importing this module registers them."""

from . import queries_fit, queries_labels, queries_neighbors, queries_orbits
from .registry import QUERIES, SQL  # noqa: F401

flagship = queries_labels.label_statistics
