"""Tables of the index, enumerations and the limits that are part of the semantics."""

from __future__ import annotations

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_byte int, end_byte int, signature string, docstring string, visibility string, pagerank double, updated_at timestamp"
EDGES = "edge_id bigint, source string, target string, kind string, line int, col int, provenance string"
CHUNKS = "id string, file_path string, language string, start_line int, end_line int, body string, token_count int"
FILES = "path string, git_blob_hash string, content_hash string, language string, size bigint, node_count int, indexed_at timestamp, parse_status string"
REFS = "ref_id bigint, from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string"
META = "key string, value string"
TABLES = {"nodes": NODES, "edges": EDGES, "chunks": CHUNKS, "files": FILES, "unresolved_refs": REFS, "meta": META}
SCHEMA_VERSION = "1"

LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx",
    "py": "python", "pyw": "python", "go": "go", "rs": "rust", "java": "java",
}
PROSE = ("md", "mdx", "markdown", "txt", "text", "rst", "adoc", "asciidoc", "tex", "org", "csv", "tsv")
STATUSES = ("ok", "degraded", "failed", "skipped")
LAYERS = ("full", "skeleton", "outline", "omit")
CONTAINERS = ("class", "interface", "struct", "enum", "trait", "module")

TOKEN_BUDGET = 128_000
CHUNK_CAPACITY = 512
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_LINE, MAX_AVERAGE_LINE, MIN_ALNUM, MAX_LINES, MAX_DIGITS = 300, 150, 0.25, 100_000, 0.5

SEED_NODES, MAX_DEPTH, LAYER_CAP, DRILL_CAP = 40, 3, 200, 50
RRF_K = 60
