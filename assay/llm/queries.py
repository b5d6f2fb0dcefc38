"""All queries of this package; importing it registers them."""

from assay.llm import classlm, collocations, dedup, idfiles, jaccard, licences, manifest, mixing, pieces, privacy, quality, toxicity, winnowing  # noqa: F401
from assay.llm.common import ORACLE, QUERIES  # noqa: F401
