"""A PySpark engine for code retrieval and for the preparation of training data."""

from .engine import Engine, IndexStats, Pack
from .operators.graph import Walk, impact, walk
from .operators.packs import Compressed, compress, render
from .operators.rank import Ranking, pagerank
from .operators.search import bm25, search, search_debug
from .sources.files import ingest
from .sources.parse import parse_files, supported_languages
from .sources.scip import import_index, read_index
from .sources.store import Store

__all__ = ["Compressed", "Engine", "IndexStats", "Pack", "Ranking", "Store", "Walk", "bm25", "compress", "impact", "import_index", "ingest", "pagerank", "parse_files", "read_index", "render", "search", "search_debug", "supported_languages", "walk"]
