"""Named queries of the library and their SQL."""

from hanmaru.plans import corpus, detection, evaluation, generation, normalisation, screening

PARTS = (normalisation, detection, screening, evaluation, corpus, generation)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
