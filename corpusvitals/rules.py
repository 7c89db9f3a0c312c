"""Rule data: word lists, thresholds, weights and patterns.

Everything here is a fixed value that decides results; operators take these
as defaults and accept replacements as parameters.
"""

# --- fixed values: extensions and languages -------------------------------
LANGUAGE_BY_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".jsx": "JavaScript",
    ".java": "Java",
    ".cpp": "C++",
    ".c": "C",
    ".h": "C/C++ Header",
    ".html": "HTML",
    ".css": "CSS",
    ".kt": "Kotlin",
    ".go": "Go",
    ".rs": "Rust",
    ".php": "PHP",
}

FILE_TYPE_BY_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".css": "CSS",
    ".scss": "SCSS",
    ".sass": "Sass",
    ".less": "LESS",
    ".html": "HTML",
    ".htm": "HTML",
}

JS_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]

# --- fixed values: what a scan skips --------------------------------------
IGNORED_DIRECTORIES = [
    ".git", ".github", "node_modules", "venv", ".venv", "env", ".env",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox",
    ".gradle", ".idea", ".vscode", ".next", ".nuxt", ".cache", "dist",
    "build", "target", "out", "coverage", "vendor", "Pods",
]

IGNORED_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock",
    "Cargo.lock", "Gemfile.lock",
]

MAX_SOURCE_BYTES = 10 * 1024 * 1024

MANIFEST_ECOSYSTEM = {
    "requirements.txt": "PyPI",
    "package.json": "npm",
    "pom.xml": "Maven",
    "build.gradle": "Maven",
}

README_NAMES = ["readme", "readme.md", "readme.txt"]

# --- fixed values: file categories ----------------------------------------
TEST_PARTS = ["test", "tests", "__tests__", "__test__"]
GENERATED_PARTS = ["dist", "build", "coverage", ".next", ".nuxt", "generated"]

SECURITY_CONFIG_NAMES = [
    "vite.config.js", "vite.config.ts",
    "webpack.config.js", "webpack.config.ts",
    "jest.config.js", "jest.config.ts",
    "eslint.config.js", "eslint.config.mjs",
    "prettier.config.js", "prettier.config.cjs",
    "tailwind.config.js", "tailwind.config.ts",
]
QUALITY_CONFIG_NAMES = SECURITY_CONFIG_NAMES + ["vite.config.mjs"]

# --- fixed values: size rules ---------------------------------------------
THRESHOLD_DEFAULTS = {"python": 500, "javascript": 800, "css": 1200, "html": 1000}

THRESHOLD_KEY_BY_TYPE = {
    "Python": "python",
    "JavaScript": "javascript",
    "TypeScript": "javascript",
    "CSS": "css",
    "SCSS": "css",
    "Sass": "css",
    "LESS": "css",
    "HTML": "html",
}

DEFAULT_MAX_LINES = 1000
LONG_FUNCTION_LINES = 80
COMPLEXITY_THRESHOLD = 10
COMPLEXITY_HIGH = 20
DUPLICATE_WINDOW = 8
DUPLICATE_ANCHOR = 3

# --- fixed values: secrets -------------------------------------------------
SECRET_KEYWORDS = {
    "API Key": "api[_-]?key",
    "Secret Key": "secret[_-]?key",
    "Password": "password|passwd|pwd",
    "Token": "token|auth[_-]?token",
}

# every keyword above has one of these in it; no letter of theirs has a foreign
# form that a pattern without case would take for it and lower-casing would not
SECRET_STEMS = ["key", "word", "wd", "token"]
# the signs that a keyword begins with, in either case, and the foreign form of one
SECRET_INITIALS = {"API Key": "aA", "Secret Key": "sS\u017f", "Password": "pP", "Token": "tTaA"}
SECRET_STEMS_BY_TYPE = {"API Key": ["key"], "Secret Key": ["ecret"], "Password": ["word", "wd"], "Token": ["token"]}

STRUCTURED_SECRET_TYPES = ["API Key", "Secret Key", "Token"]
SCORED_SECRET_TYPES = ["API Key", "Password", "Token"]

INPUT_CALLS = ["input(", "getpass(", "prompt(", "askpassword("]

PLACEHOLDER_WORDS = [
    "example", "test", "demo", "dummy", "fake", "sample", "changeme",
    "placeholder", "null", "none", "undefined",
    "your_api_key", "your-api-key", "your_password", "your-password",
    "your_secret", "your-secret", "your_token", "your-token",
    "test-token", "test_token", "demo-token", "demo_token",
    "example-token", "example_token", "dummy-token", "dummy_token",
    "xxxxxxxx", "xxxx",
]

PLACEHOLDER_PREFIXES = [
    "your", "example", "test", "demo", "dummy", "fake", "sample", "placeholder",
]

# --- fixed values: work markers and script branches ------------------------
MARKERS = ["TODO", "FIXME", "XXX", "HACK"]
# every marker has one of these in it, chosen as those of the secrets are
MARKER_STEMS = ["todo", "xme", "xxx", "hac"]

JS_BRANCHES = {
    "if": r"\bif\s*\(",
    "for": r"\bfor\s*\(",
    "while": r"\bwhile\s*\(",
    "catch": r"\bcatch\s*\(",
    "switch": r"\bswitch\s*\(",
    "case": r"\bcase\s+",
    "ternary": r"\?(?![?.])",
}

JS_NOT_METHODS = ["if", "for", "while", "switch", "catch", "with"]

# --- fixed values: manifests ------------------------------------------------
UNSPECIFIED = "unspecified"

PACKAGE_JSON_SECTIONS = [
    "dependencies", "devDependencies", "optionalDependencies", "peerDependencies",
]

GRADLE_CONFIGURATIONS = [
    "implementation", "api", "compileOnly", "runtimeOnly",
    "testImplementation", "testCompileOnly", "testRuntimeOnly",
    "annotationProcessor",
]

# --- fixed values: scoring ---------------------------------------------------
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
FINDING_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "INFO": 3}
DIAGNOSIS_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

QUALITY_WEIGHTS = {"HIGH": 7, "MEDIUM": 4, "LOW": 2}
LARGE_FILE_WEIGHTS = {"HIGH": 6, "MEDIUM": 4, "LOW": 2}
LIGHT_LOW_WEIGHTS = {"Duplicate Code": 1, "Unused Python Import": 1}
MAX_QUALITY_DEDUCTION = 50

OVERALL_WEIGHTS = {"security": 0.5, "quality": 0.3, "documentation": 0.2}

# --- wording: finding type (and category) -> why / what to do ---------------
EXPLANATIONS = {
    "secret": (
        "A credential written into source travels with every clone, log and build.",
        "Read it from the environment or a secret store, and rotate it.",
    ),
    "secret/test": (
        "The value sits in a test file, so it may be fake, but that needs checking.",
        "Confirm it opens nothing; prefer values that are plainly fake.",
    ),
    "Large File": (
        "A file this long is hard to read, test and review.",
        "Split it along its responsibilities.",
    ),
    "High Python Complexity": (
        "Many branches in one function mean many paths to understand and test.",
        "Extract helpers and flatten the nesting.",
    ),
    "High JavaScript Complexity": (
        "Many branches in one function mean many paths to understand and test.",
        "Extract helpers and flatten the nesting.",
    ),
    "Long Function": (
        "A long function tends to do several jobs at once.",
        "Give each job a function of its own.",
    ),
    "Unused Python Import": (
        "The imported name is never read in this module.",
        "Delete the import.",
    ),
    "Unused JavaScript Import": (
        "The imported name is never read in this module.",
        "Delete the import; bundles get smaller too.",
    ),
    "Duplicate Code": (
        "A fix made in one copy is easily missed in the other.",
        "Move the shared lines to one place.",
    ),
    "marker": (
        "An open marker points at unfinished work.",
        "Finish it, or track it as an issue.",
    ),
    "Vulnerable Dependency": (
        "The declared version has published advisories.",
        "Move to a fixed release.",
    ),
}

# finding type -> text of its details
DETAILS = {
    "secret": "Looks like a hard-coded %s, certainty %d of 100.",
    "marker": "Unfinished work: %s.",
    "python_complexity": "Complexity %d is above the limit of %d.",
    "script_complexity": "Complexity of %s is about %d, above the limit of %d.",
    "long_function": "%d lines long, the limit is %d.",
    "unused_import": "%s is imported but never used.",
    "large_file": "%s with %d lines, the limit is %d (%.1f%% more).",
    "duplicate": "%d lines are repeated, %d%% of them equal.",
}

ACTIONS = {
    "critical": "Resolve critical vulnerabilities first.",
    "dependency": "Upgrade vulnerable dependencies after reading their advisories.",
    "complexity": "Break up the most complex functions.",
    "large_file": "Split oversized files into focused modules.",
    "duplicate": "Factor repeated blocks into shared code.",
    "default": "Nothing urgent: keep watching and keep current standards.",
}
