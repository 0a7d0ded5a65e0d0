"""Registered queries over the driver's tables."""

from supplylens.plans import advisories, catalogue, files

QUERIES = {**catalogue.QUERIES, **advisories.QUERIES, **files.QUERIES}
ORACLES = {**catalogue.ORACLES, **advisories.ORACLES, **files.ORACLES}
