"""Names and numbers that results depend on."""

# File extensions and their languages.
LANGUAGE_OF_EXTENSION = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c",
    ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}

# Languages whose files are cut along their syntax; files of the others are packed by lines.
SYNTAX_LANGUAGES = frozenset("javascript typescript python java cpp go rust csharp scala".split())

# Patterns that are ignored everywhere.
DEFAULT_IGNORE = """
node_modules/** bin/** venv/** dist/** build/** out/** target/** coverage/** .nyc_output/**
.vscode/** .idea/** *.swp *.swo
.git/** .svn/** .hg/**
.cache/** __pycache__/** .pytest_cache/**
logs/** tmp/** temp/** *.log
.env .env.* *.local
*.min.js *.min.css *.min.map *.bundle.js *.bundle.css *.chunk.js *.vendor.js *.polyfills.js *.runtime.js *.map
node_modules venv bin .git .svn .hg build dist out target .vscode .idea __pycache__ .pytest_cache coverage .nyc_output logs tmp temp
*.bin *.exe *.out
""".split()

# Defaults of chunking, embedding and search.
CHUNK_SIZE = 2500
CHUNK_OVERLAP = 300
VECTOR_SIZE = 768
UPSERT_BATCH = 128
EMBED_BATCH = 32
RRF_K = 2
BM25_K1, BM25_B, BM25_AVERAGE_LENGTH = 1.2, 0.75, 256.0
GRAPH_LIMIT = 30
MAX_RESULTS = 50
NO_DOC = "unknown"

# Kinds of graph edges.
PARENT_OF, CONTINUES, CALLS, USES = EDGE_TYPES = ("PARENT_OF", "CONTINUES", "CALLS", "USES")
