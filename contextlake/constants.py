"""Values that the semantics depend on, in one place."""

from __future__ import annotations

# Limits and defaults.
MAX_FILE_SIZE = 10 * 1024 * 1024
SIZE_GATE = 256 * 1024
MAX_TOTAL_SIZE = 100 * 1024 * 1024
MAX_FILE_COUNT = 10_000
MAX_BASE64_SIZE = 1024 * 1024
CHAR_LIMIT = 2_000_000
SNIFF_BYTES = 8192
NON_PRINTABLE_RATIO = 0.30
TRUSTED_CONTROL_RATIO = 0.05
TRUSTED_CONTROL_FLOOR = 8
LEDGER_TOP = 50
LEDGER_MAX_ENTRIES = 100_000
CHARS_PER_TOKEN = 4
SECRET_MAX_FILE_BYTES = 5_000_000
STRUCTURE_ONLY_BODY = "[Content skipped for AI context optimization]"
BINARY_PLACEHOLDER = "[Binary file not included]"
BINARY_COMMENT = "<!-- {TYPE} File Excluded: {PATH} ({SIZE}) -->"
LINE_NUMBER_FORMAT = "%4d: "
TREE_MIDDLE, TREE_LAST, TREE_VERTICAL, TREE_EMPTY = "├── ", "└── ", "│   ", "    "

# Neutral names of our own formats and files.
FORMAT_IDS = {"xml": "ctx-xml@1", "json": "ctx-json@1", "ndjson": "ctx-ndjson@1", "markdown": "ctx-md@1", "sarif": "2.1.0", "tree": "ctx-tree@1"}
XML_NAMESPACE = "urn:ctx"
IGNORE_FILE, INCLUDE_FILE = ".ctxignore", ".ctxinclude"
TOOL_NAME = "contextlake"
PROFILE_FILE = ".ctxprofile"
DEFAULT_INSTRUCTIONS = "Each file below is shown whole unless it is marked as truncated. Paths are relative to the root."

# Limits of path lists in reports.
REPORT_PATHS, REPORT_ALL_PATHS = 2_000, 50_000

# Reasons of the exclusion ledger.
REASONS = (
    "gitignore", "toolignore", "globalGitignore", "gitInfoExclude", "configExclude", "optionExclude", "filterPattern", "testExclude",
    "binaryExtension", "binaryPolicy", "sizeGate", "totalSizeBudget", "fileCountBudget", "charBudget", "scopeFilter", "gitFilter",
    "duplicate", "unreadable", "secretFile", "secretUnscannable", "secretDetected", "symlinkEscape",
)
LAYER_REASONS = {
    "gitignore": "gitignore", "toolignore": "toolignore", "global-gitignore": "globalGitignore", "git-info-exclude": "gitInfoExclude",
    "option-exclude": "optionExclude", "test-exclude": "testExclude", "config-exclude": "configExclude", "profile-exclude": "configExclude",
}

# Characters that the serializers add around a file and around a document.
FILE_OVERHEAD = {"xml": 160, "markdown": 220, "json": 180, "ndjson": 140, "sarif": 260, "tree": 0}
DOCUMENT_OVERHEAD = {"xml": 400, "markdown": 600, "json": 300, "ndjson": 120, "sarif": 800, "tree": 80}

# Names that always go.
EXCLUDED_DIRECTORIES = (
    ".git", ".svn", ".hg", ".bzr", "CVS", "_darcs", ".idea", ".vscode", ".eclipse", ".settings", "node_modules", "bower_components",
    "jspm_packages", "vendor", "dist", "build", "out", "target", ".next", ".nuxt", ".output", "coverage", ".nyc_output", "__pycache__",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".sass-cache", ".cache", ".vagrant", ".serverless",
)
EXCLUDED_FILES = (
    IGNORE_FILE, ".gitignore", INCLUDE_FILE, ".env", ".env.local", ".env.*.local", ".DS_Store", "Thumbs.db", "desktop.ini", ".directory",
    "$RECYCLE.BIN", "ehthumbs.db", "ehthumbs_vista.db", "*.log", "*.pid", "*.seed", "*.pid.lock", "npm-debug.log*", "yarn-debug.log*",
    "yarn-error.log*", "lerna-debug.log*", "pnpm-debug.log*", "*.map", "*.css.map", "*.js.map", "*.min.js", "*.min.css", "*~", "*.swp",
    "*.swo", "*.bak", "*.tmp", "*.orig", "*.sublime-workspace", "*.sublime-project", "*.pyc", "*.pyo", "*.pyd", "*.class", "*.jar", "*.war",
    "*.ear", "*.o", "*.obj", "*.exe", "*.dll", "*.so", "*.dylib", "*.ncb", "*.sdf", "*.suo", "*.pdb", "*.idb", "*.7z", "*.dmg", "*.gz",
    "*.iso", "*.rar", "*.tar", "*.zip", "*.jpg", "*.jpeg", "*.png", "*.gif", "*.bmp", "*.ico", "*.mp3", "*.mp4", "*.avi", "*.mov", "*.wmv",
    "*.flv", "*.webm", "*.wav", "*.flac", "*.aac", "*.ogg", "*.wma",
)
TEST_PATTERNS = (
    "test", "tests", "__tests__", "spec", "specs", "test/**", "tests/**", "__tests__/**", "spec/**", "specs/**",
    "*.test.js", "*.test.ts", "*.test.jsx", "*.test.tsx", "*.spec.js", "*.spec.ts", "*.spec.jsx", "*.spec.tsx", "*.test.mjs", "*.spec.mjs",
    "jest.config.js", "jest.config.ts", "jest.setup.js", "vitest.config.js", "vitest.config.ts",
)
FORCE_INCLUDE_DOTFILES = (".env.example", ".editorconfig", ".eslintrc*", ".prettierrc*", ".babelrc*", ".dockerignore", ".github/**", ".gitlab-ci.yml", ".travis.yml", "circle.yml")
STRUCTURE_ONLY = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "shrinkwrap.yaml", "composer.lock", "Gemfile.lock", "Pipfile.lock",
    "poetry.lock", "uv.lock", "pdm.lock", "requirements.lock", "Cargo.lock", "go.sum", "mix.lock", "flake.lock", "pubspec.lock",
    "Podfile.lock", "Cartfile.resolved", "Package.resolved", "deno.lock", "*.svg",
)

# Extensions of binary files by category: the common ones; callers add or replace groups.
BINARY_EXTENSIONS = {
    "video": ("mp4", "m4v", "mov", "avi", "mkv", "webm", "wmv", "flv", "mpg", "mpeg"),
    "audio": ("mp3", "wav", "flac", "aac", "ogg", "opus", "m4a", "wma", "mid"),
    "image": ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "avif", "heic", "ico"),
    "design": ("psd", "ai", "xcf", "sketch", "fig"),
    "model3d": ("blend", "fbx", "glb", "gltf", "stl"),
    "font": ("ttf", "otf", "woff", "woff2", "eot"),
    "archive": ("zip", "tar", "gz", "tgz", "bz2", "xz", "zst", "7z", "rar", "lz4"),
    "diskImage": ("dmg", "iso", "img", "vmdk", "qcow2"),
    "package": ("pkg", "deb", "rpm", "apk", "msi", "whl", "egg", "gem", "jar", "war"),
    "executable": ("exe", "dll", "so", "dylib", "a", "lib", "o", "obj", "wasm", "class", "pyc"),
    "debug": ("pdb", "trace", "dump", "core"),
    "database": ("sqlite", "sqlite3", "db", "mdb", "dbf"),
    "mlWeights": ("pt", "pth", "ckpt", "safetensors", "gguf", "onnx", "pb", "h5", "npz", "npy", "pkl"),
    "dataBlob": ("parquet", "orc", "avro", "arrow", "feather", "msgpack"),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "rtf", "key", "epub"),
    "cert": ("pem", "der", "crt", "cer", "p12", "pfx", "jks", "gpg"),
    "other": ("dat", "bin", "blob", "cache"),
}
# Extensions that are text whatever a group says.
NEVER_BINARY = (
    "ts", "tsx", "m", "mm", "h", "hh", "hpp", "hxx", "r", "d", "pl", "pm", "cs", "rs", "go", "swift", "kt", "kts", "scala", "lua", "sql",
    "sh", "bash", "zsh", "fish", "ps1", "bat", "cmd", "vue", "svelte", "astro", "html", "htm", "svg", "md", "mdx", "yml", "yaml", "toml", "ini",
)
BINARY_POLICY_DEFAULT, BINARY_POLICY_EXCEPTIONS = "comment", {"document": "placeholder"}
# Leading bytes of binary formats, in the order of the test: (category, name, hex).
MAGIC = (
    ("image", "PNG", "89504E470D0A1A0A"), ("image", "JPEG", "FFD8FF"), ("image", "GIF", "47494638"), ("image", "BMP", "424D"), ("image", "ICO", "00000100"),
    ("document", "PDF", "255044462D"), ("document", "MS Office", "D0CF11E0A1B11AE1"),
    ("archive", "ZIP", "504B0304"), ("archive", "ZIP (empty)", "504B0506"), ("archive", "ZIP (spanned)", "504B0708"), ("archive", "GZIP", "1F8B08"),
    ("archive", "7-Zip", "377ABCAF271C"), ("archive", "RAR", "526172211A07"),
    ("executable", "ELF", "7F454C46"), ("executable", "PE/MZ", "4D5A"), ("executable", "Mach-O (32-bit BE)", "FEEDFACE"), ("executable", "Mach-O (64-bit BE)", "FEEDFACF"),
    ("executable", "Mach-O (32-bit LE)", "CEFAEDFE"), ("executable", "Mach-O (64-bit LE)", "CFFAEDFE"), ("executable", "Mach-O Fat Binary", "CAFEBABE"),
    ("database", "SQLite", "53514C69746520666F726D6174203300"),
)

# What directory names and file names say about a path's role.
DIRECTORY_ROLES = {
    "documentation": ("docs", "doc", "documentation", "website", "site"),
    "tests": ("test", "tests", "__tests__", "spec", "specs", "e2e", "integration"),
    "fixtures": ("fixture", "fixtures", "__fixtures__", "testdata", "golden", "goldens", "snapshots", "__snapshots__"),
    "examples": ("example", "examples", "demo", "demos", "sample", "samples", "playground"),
    "benchmarks": ("bench", "benchmark", "benchmarks", "perf"),
    "generated": ("dist", "build", "out", "target", "coverage", "reports", "generated", "__generated__"),
    "source": ("src", "lib", "app", "source", "sources", "internal", "pkg", "cmd"),
    "scripts": ("script", "scripts", "tools", "tooling"),
    "assets": ("asset", "assets", "static", "public", "images", "img", "media", "fonts"),
    "project-config": (".github", ".gitlab", "ci", ".circleci"),
    "schema": ("migration", "migrations", "schema", "schemas"),
    "localization": ("locale", "locales", "i18n", "translations"),
    "vendored": ("vendor", "third_party", "thirdparty", "node_modules"),
}
ROOT_CONFIG_FILES = (
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "tsconfig.json", "jsconfig.json", "cargo.toml", "cargo.lock", "go.mod",
    "go.sum", "pyproject.toml", "setup.py", "requirements.txt", "pom.xml", "build.gradle", "gemfile", "composer.json", "makefile", "dockerfile",
)
GENERATED_NAMES = r"(?i)(\.min\.(js|css)$|\.map$|\.lock$|(^|[.\-_])generated([.\-_]|$)|\.pb\.(go|js|ts)$|_pb2\.py$|\.d\.ts$)"
FENCE_LANGUAGES = {
    "js": "js", "cjs": "js", "mjs": "js", "jsx": "jsx", "ts": "ts", "tsx": "tsx", "json": "json", "yml": "yaml", "yaml": "yaml", "md": "markdown",
    "htm": "html", "html": "html", "css": "css", "scss": "scss", "sass": "scss", "py": "python", "rb": "ruby", "java": "java", "go": "go", "rs": "rust",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "hh": "cpp", "sh": "bash", "csv": "csv", "txt": "text",
}
GIT_STATUS_ORDER = ("modified", "staged", "not_added", "created", "deleted", "renamed", "conflicted")
# Root files and extensions whose removal a rule check warns about.
CRITICAL_ROOT_FILES = ("package.json", "tsconfig.json", "cargo.toml", "go.mod", "pyproject.toml", "composer.json", "pom.xml")
SOURCE_EXTENSIONS = (
    "js", "mjs", "cjs", "jsx", "ts", "tsx", "py", "rb", "go", "rs", "java", "kt", "swift", "c", "h", "cc", "cpp", "hpp", "cs", "php",
    "scala", "ex", "exs", "erl", "clj", "hs", "ml", "zig", "dart", "vue", "svelte",
)
# Roles of directories that are left out on purpose, so their source files need no warning.
DELIBERATE_ROLES = ("tests", "fixtures", "examples", "benchmarks", "generated", "vendored")
