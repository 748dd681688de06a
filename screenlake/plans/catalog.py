"""All queries of the package, without those of the ``llm`` subpackage."""

from . import documents, entities, exports, labels, runs  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES  # noqa: F401
