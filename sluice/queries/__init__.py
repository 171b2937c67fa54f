"""One query per operator id, over the test tables, with its SQL twin. Importing the package registers them all."""

from . import analysis, flow, maps, metrics, pairs, sources, windows  # noqa: F401
