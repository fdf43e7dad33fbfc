"""Importing this module fills the registry."""

from quillgraph.plans import explore  # noqa: F401
from quillgraph.plans import centrality  # noqa: F401
from quillgraph.plans import clusters  # noqa: F401
from quillgraph.plans import text  # noqa: F401
from quillgraph.plans import files  # noqa: F401
from quillgraph.plans import measures  # noqa: F401
