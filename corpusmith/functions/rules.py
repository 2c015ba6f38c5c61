"""Word lists, patterns and constants that results depend on, in one place."""

from __future__ import annotations

import re

# --- queries -----------------------------------------------------------------------------------
QUERY_STOP_WORDS = "a an and are as at be by for from how in into is it of on or the to with where".split()
FTS_STOP_WORDS = [*QUERY_STOP_WORDS, "out"]
CAPITALIZED_PROSE = "explain find given how locate show the this what when where which why".split()
GENERIC_LEADING_TERMS = "create find implement locate show".split()
SYMBOL_STOP_WORDS = "build create find handle handles implement implementation install manage manages return returns show using value values".split()
COMPOUND_SUFFIXES = "controller provider scheduler handler manager resolver runtime server service client cache store".split()
LANGUAGE_QUALIFIERS = "csharp golang java javascript kotlin php python ruby rust swift typescript".split()
IDENTIFIER = re.compile(
    r"\b[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\b|\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b|\b[a-z]+[A-Z][A-Za-z0-9]*\b"
    r"|\b[A-Z][A-Z0-9_]{1,}\b|\b[A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)+\b|\b[A-Z][a-z][A-Za-z0-9]{1,}\b",
    re.ASCII,
)
PATH_HINT = re.compile(r"(?:[\w.-]+\/)+[\w.-]+|\b[\w-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|md)\b", re.ASCII)
HISTORY_WORDS = re.compile(r"\b(?:commit|history|why|when|blame|lineage|changelog|introduced|regression)\b", re.ASCII | re.IGNORECASE)
CLAUSE_BREAK = re.compile(r"(?<=[.;!?])\s+|\bso that\b|\bwhile keeping\b|\bwithout\b|,\s+(?:and|then)\s+|\band then\b", re.ASCII | re.IGNORECASE)

# --- limits ------------------------------------------------------------------------------------
BM25_K1, BM25_B = 1.4, 0.75
RRF_K = 60
FTS_TERMS, FTS_SUPPORT = 4, 6
MAX_IDENTIFIERS, MAX_NATURAL_SYMBOLS, MAX_PATH_HINTS = 12, 4, 24
SUBQUERIES, SUBQUERY_CHARS, PLAN_CHARS = 4, 120, 360
TASK_TOKENS, TASK_CHARS = 8, 60

# --- files -------------------------------------------------------------------------------------
_I = re.ASCII | re.IGNORECASE
IMPLEMENTATION = re.compile(r"\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|kts|rb|php|c|cc|cpp|h|hpp|cs|swift|vue|svelte)$", _I)
ASKS_DOCS = re.compile(r"\b(?:doc|docs|documentation|readme|guide|tutorial|usage|example|examples|install|setup|configure|configuration)\b", _I)
ASKS_TESTS = re.compile(r"\b(?:test|tests|spec|fixture|fixtures|mock|mocks|benchmark|bench|example|examples|demo)\b", _I)
ASKS_DEPRECATED = re.compile(r"\b(?:deprecat\w*|legacy|obsolete|old|outdated|superseded|removed)\b", _I)
TEST_FOLDER = re.compile(r"^(?:tests?|__tests__|spec|fixtures?|benchmarks?|test[-_][^/]*)$", _I)
CAMEL_TEST_FOLDER = re.compile(r"^test[A-Z][^/]*$")
TEST_NAME = re.compile(r"(?:^|[._-])(?:test|spec)(?:[._-]|$)|Tests?\.java$|_test\.(?:go|py|rb)$", _I)
PROJECT_DOCUMENT = re.compile(r"^(?:readme|changelog|contributing|license|roadmap|architecture|comparison|evaluation|agents)(?:\.|$)", _I)
DEPRECATED_PATH = re.compile(r"(?:^|/)(?:legacy|deprecated|deprecate|obsolete|vendor|third[_-]?party)(?:/|$)|\.(?:old|bak|orig|deprecated)\.[cm]?[jt]sx?$|[._-]old(?:\.|/|$)", _I)
DEPRECATED_MARK = re.compile(r"@deprecated\b|#\s*\[deprecated|\bDEPRECATED\b|std::deprecated|\bObsolete\b", re.ASCII)

#: Paths that lower a score: pattern, when tests are asked for, else.
TEST_PATHS = [
    (re.compile(r"(?:^|/)(?:examples?|demo|samples?|fixtures?|benchmarks?|fuzzing|testdata|test-data)(?:/|$)", _I), 0.35, 1.65),
    (re.compile(r"(?:^|/)(?:test|tests|__tests__|spec|jvmTest|androidHostTest|androidTest|commonTest|hostTest|androidMain)(?:/|$)", _I), 0.30, 1.75),
    (re.compile(r"\.(?:test|spec)\.[cm]?[jt]sx?$", _I), 0.25, 1.55),
    (re.compile(r"_test\.(?:c|cc|cpp|cxx|go|rs|java|kt|kts|py)$", _I), 0.25, 1.60),
    (re.compile(r"(?:_test|Test|Tests)\.(?:java|kt|kts|go|rs|py|c|cc|cpp)$", _I), 0.25, 1.60),
    (re.compile(r"\b(?:test|spec|mock|fixture|bench)\b", _I), 0.10, 0.55),
]
HEADER_FILE = re.compile(r"\.(?:h|hpp|hxx|hh)$", _I)
JSON_FILE = re.compile(r"\.json$", _I)
DOCUMENT_PATH = re.compile(r"(?:^|/)(?:docs?|documentation|guide|guides|website|bench|benchmark|examples)(?:/|$)", _I)
MARKDOWN_FILE = re.compile(r"\.mdx?$", _I)
TYPINGS_PATH = re.compile(r"\.d\.ts$|(?:^|/)typings?(?:/|$)", _I)
SOURCE_PATH = re.compile(r"(?:^|/)(?:lib|src|source|app|pkg|internal|core|db|table|util|commonJvmAndroid|jvmMain|main)(?:/|$)", _I)
CORE_FILE = re.compile(r"\.(?:c|cc|cpp|go|java|kt|rs|py|ts|js)$", _I)
#: Weights of rank fusion, features and meaning by intent.
WEIGHTS = {"none": (0.45, 0.55, 0.0), "symbol": (0.24, 0.48, 0.28), "path": (0.24, 0.48, 0.28), "concept": (0.20, 0.40, 0.40), "history": (0.32, 0.50, 0.18), "mixed": (0.22, 0.40, 0.38)}

# --- files and languages (fixed values) --------------------------------------------------------
#: Rules that hold before a tree's own ignore files.
DEFAULT_IGNORES = (
    # dependencies and version control
    "node_modules/ bower_components/ jspm_packages/ vendor/ Pods/ Carthage/ .bundle/ .git/ .svn/ .hg/ "
    # output
    "dist/ build/ out/ output/ bin/ obj/ target/ Debug/ Release/ cmake-build-*/ coverage/ .coverage/ htmlcov/ .nyc_output/ .next/ .nuxt/ .turbo/ .cache/ .parcel-cache/ .svelte-kit/ .vercel/ .netlify/ storybook-static/ "
    "__pycache__/ .venv/ venv/ .tox/ .mypy_cache/ .pytest_cache/ .ruff_cache/ *.egg-info/ .eggs/ "
    # minified files and locks
    "*.min.js *.min.css *.map *.lock package-lock.json pnpm-lock.yaml yarn.lock bun.lockb Cargo.lock poetry.lock Pipfile.lock composer.lock Gemfile.lock go.sum "
    # secrets
    ".env .env.* !.env.example !.env.sample *.pem *.key *.p12 *.pfx id_rsa id_dsa id_ecdsa id_ed25519 credentials.json service-account*.json "
    # editors and systems
    ".idea/ .vscode/ *.swp *.swo *~ .DS_Store Thumbs.db desktop.ini "
    # binaries and media
    "*.png *.jpg *.jpeg *.gif *.webp *.ico *.svg *.pdf *.zip *.tar *.gz *.7z *.rar *.woff *.woff2 *.ttf *.eot *.mp4 *.mp3 *.wav *.wasm *.bin *.exe *.dll *.so *.dylib *.class *.jar *.war *.ear *.o *.a *.lib *.obj *.pyc *.pyo *.pdb *.ilk "
    # made by tools
    "*.generated.* *_generated.* *.g.dart *.freezed.dart generated/ gen/ third_party/ third-party/ "
    # heavy trees of tests
    "**/androidHostTest/ **/androidTest/ **/jvmTest/ **/commonTest/ **/hostTest/ **/benchmarks/ **/fuzzing/ **/testdata/ **/test-data/"
).split()
#: Extensions of files that are read.
TEXT_EXTENSIONS = (
    "ts tsx js jsx mjs cjs mts cts py pyi go rs java kt kts scala groovy c cc cpp cxx c++ h hh hpp hxx h++ inl ipp cs fs fsx vb swift m mm vue svelte astro "
    "rb php pl pm lua r jl ex exs erl hrl hs lhs clj cljs cljc edn zig nim dart sol md mdx rst txt json jsonc json5 yaml yml toml ini cfg conf xml html htm css scss less sass "
    "sql graphql gql proto thrift avsc cmake gradle tf hcl bicep nix sh bash zsh fish ps1 bat cmd dockerfile"
).split()
#: Names of files that are read and have a language whatever their extension; ``dockerfile.*`` counts as a dockerfile.
LANGUAGE_BY_NAME = {"dockerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile", "cmakelists.txt": "cmake", "build.gradle": "gradle", "build.gradle.kts": "gradle", "pom.xml": "xml"}
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "tsx": "tsx", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python",
    "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "groovy": "groovy", "rb": "ruby", "php": "php",
    "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "h": "c", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "h++": "cpp", "inl": "cpp", "ipp": "cpp", "cs": "csharp", "fs": "fsharp",
    "swift": "swift", "m": "objective-c", "mm": "objective-cpp", "vue": "vue", "svelte": "svelte", "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "css": "css", "scss": "scss", "html": "html", "dart": "dart", "sol": "solidity", "proto": "protobuf", "tf": "terraform", "hcl": "hcl",
}
