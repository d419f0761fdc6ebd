"""Lists, patterns, tables and message texts whose exact content decides the results.

Nothing in this module is logic. Patterns are written in Python ``re`` notation;
``functions.text.java_pattern`` turns them into the notation Spark uses.
"""

# --- Fixed values: file collection -------------------------------------------------------

CODE_SUFFIXES = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java", ".rb",
    ".c", ".cpp", ".h", ".hpp", ".cs", ".swift", ".kt",
    ".html", ".css", ".scss", ".json", ".yaml", ".yml", ".toml",
    ".sh", ".bash", ".bat", ".cmd", ".ps1",
    ".md", ".txt", ".cfg", ".ini", ".env",
]

SKIP_DIRS = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "env",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "dist", "build", ".egg-info", ".eggs",
    ".idea", ".vscode", ".vs",
]

MAX_FILE_BYTES = 500_000

# --- Fixed values: the characters Python's str.strip() removes ---------------------------

WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: analyzers in emission order -------------------------------------------
# (name, category, points per critical / high / medium / low finding, points otherwise)

ANALYZERS = [
    ("Structure", "structure", "3.0", "2.0", "1.0", "0.5", "0.5"),
    ("Reusability", "reusability", "3.0", "2.0", "1.0", "0.5", "0.5"),
    ("Clarity", "clarity", "3.0", "2.0", "1.0", "0.3", "0.3"),
    ("Functionality", "functionality", "3.0", "2.0", "1.0", "0.3", "0.3"),
    ("Security", "security", "4.0", "2.5", "1.0", "0.5", "0.5"),
    ("Automation", "automation", "3.0", "2.0", "1.0", "0.3", "0.3"),
    ("AST Analysis", "ast_analysis", "3.0", "2.0", "1.0", "0.3", "0.3"),
    ("AI Deep Review", "ai_review", "3.0", "2.0", "1.0", "0.3", "0.5"),
]

SEVERITIES = ["critical", "high", "medium", "low"]
UNKNOWN_SEVERITY_RANK = 99
SEVERITY_ICONS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵"}
UNKNOWN_SEVERITY_ICON = "⚪"

# --- Fixed values: security --------------------------------------------------------------

SECRET_PATTERNS = [
    (r"""(?i)(api[_-]?key|secret[_-]?key|password|token|auth)\s*=\s*["'][^"']{8,}["']""",
     "Hardcoded secret/credential"),
    (r"""(?i)(aws_access_key_id|aws_secret_access_key)\s*=\s*["'][^"']+["']""", "AWS credential"),
    (r"sk-[a-zA-Z0-9]{20,}", "OpenAI-style API key"),
    (r"ghp_[a-zA-Z0-9]{36}", "GitHub personal access token"),
    (r"(?i)mongodb(\+srv)?://\w+:\w+@", "Database connection string with credentials"),
    (r"(?i)(mysql|postgres|postgresql)://\w+:\w+@", "Database connection string with credentials"),
]
SECRET_SKIP_SUFFIXES = [".pyc", ".pyo", ".so", ".dll"]

UNSAFE_PATTERNS = [
    (r"\beval\s*\(", "eval() usage — code injection risk"),
    (r"\bexec\s*\(", "exec() usage — code injection risk"),
    (r"subprocess\..*shell\s*=\s*True", "Shell=True in subprocess — command injection risk"),
    (r"os\.system\s*\(", "os.system() — prefer subprocess with shell=False"),
    (r"pickle\.loads?\s*\(", "pickle.load — deserialization attack risk"),
    (r"yaml\.load\s*\([^)]*\)(?!.*Loader)", "yaml.load without safe Loader"),
]

IGNORE_ENTRIES = [".env", "__pycache__", "*.pyc", "venv/", "node_modules/"]

# --- Fixed values: functionality ---------------------------------------------------------

TODO_MARKERS = ["TODO", "FIXME", "HACK", "XXX", "BUG"]
TODO_MEDIUM_MARKERS = ["FIXME", "BUG"]
STUB_BODIES = ["pass", "...", "raise NotImplementedError"]
BARE_EXCEPTS = ["except:", "except Exception:"]
JUMP_STATEMENTS = ["return", "break", "continue"]
REACHABLE_STARTS = ["def ", "class ", "except", "elif", "else"]
DEF_PATTERN = r"^\s*def (\w+)"
IMPORT_PATTERN = r"^import (\w+)"
FROM_IMPORT_PATTERN = r"^from \S+ import (.+)"

# --- Fixed values: clarity ---------------------------------------------------------------

SINGLE_LETTER_PATTERN = r"\b([a-z])\s*="
ALLOWED_SINGLE_LETTERS = "ijkxynmfe_"
DEF_OR_CLASS_PATTERN = r"^\s*(def|class) (\w+)"
NUMBER_PATTERN = r'(?<!["\w])(\d+\.?\d*)(?!["\w])'
MAGIC_NUMBER_WHITELIST = [0, 1, 2, 100, 255]

# --- Fixed values: structure -------------------------------------------------------------

ROOT_CODE_SUFFIXES = [".py", ".js", ".ts", ".go", ".rs", ".java"]
CONCERNS = ["config", "test", "ui", "script", "logic"]
CONFIG_NAMES = ["settings.py", ".env", "constants.py"]
SCRIPT_SUFFIXES = [".bat", ".sh", ".cmd"]
PACKAGING_NAMES = ["setup.py", "pyproject.toml", "setup.cfg"]

# --- Fixed values: automation ------------------------------------------------------------

CI_INDICATORS = [".github/workflows", ".gitlab-ci.yml", "Jenkinsfile", ".circleci",
                 "azure-pipelines.yml", "Makefile"]
LINT_INDICATORS = ["pyproject.toml", "setup.cfg", ".flake8", ".pylintrc",
                   ".pre-commit-config.yaml", "ruff.toml", ".prettierrc", "eslint", "tox.ini"]
MAIN_GUARDS = ['__name__ == "__main__"', "__name__ == '__main__'"]
CLI_LIBRARIES = ["argparse", "click", "typer"]
API_LIBRARIES = ["flask", "fastapi"]
TOP_LEVEL_DEF_PATTERN = r"(?m)^def \w+"

# --- Fixed values: tags, recommendation, cost --------------------------------------------

TAG_KEYWORDS = {
    "biz": ["customer", "invoice", "payment", "order", "checkout", "cart",
            "user", "login", "auth", "dashboard", "analytics", "revenue"],
    "ops": ["deploy", "ci", "cd", "docker", "kubernetes", "terraform",
            "ansible", "pipeline", "monitoring", "alerting", "cron", "schedule"],
    "lab": ["experiment", "test", "prototype", "demo", "example", "sandbox",
            "scratch", "try", "poc", "proof"],
    "util": ["util", "helper", "tool", "script", "automation", "cli",
             "agent", "bot", "scraper", "converter", "parser"],
}
DEFAULT_TAG = "util"

COST_MODES = ["smart", "auto-fix"]
CHARS_PER_TOKEN = 4
SMART_INPUT_SHARE = 4
SMART_OUTPUT_TOKENS = 2000
AUTO_FIX_OUTPUT_SHARE = 2
USD_PER_MILLION_INPUT = 3
USD_PER_MILLION_OUTPUT = 15

# --- Fixed values: report ----------------------------------------------------------------

README_NAMES = ["README.md", "readme.md", "README.rst", "README.txt"]
README_SKIP_STARTS = ["![", "<!--", "```", "---"]
DESCRIPTION_LENGTH = 300
NO_DESCRIPTION = "(Could not determine — no README or module docstrings found)"
RECOMMENDATION_LABELS = {
    "promote": "PROMOTE to core system",
    "maintain": "MAINTAIN — keep improving",
    "archive": "Consider ARCHIVING",
}
DEFAULT_AUTOMATION_STEPS = ["Add CI/CD pipeline", "Add pre-commit hooks"]
AUTOMATABLE_STEPS = [
    "Linting and formatting (ruff/black) — fully automatable",
    "Import sorting (isort/ruff) — fully automatable",
    "Type checking (mypy/pyright) — can be added incrementally",
    "Test generation — partially automatable with AI agents",
    "Dependency updates — automatable with dependabot/renovate",
]
SCORE_CATEGORIES = ["quality", "structure", "security", "usefulness", "overall"]
PATCHES_TITLE = "## Auto-Fix Patches"
PATCHES_TOTAL = "**{n} patches generated**"
NO_PATCHES = "No patches generated."
PATCH_STATUS_LABELS = {"applied": "done", "would_apply": "ready", "generated": "pending"}

# --- Fixed values: prompt budgets --------------------------------------------------------

VALIDATION_CONTEXT_CHARS = 8000
REVIEW_SNIPPET_CHARS = 6000
REVIEW_TOTAL_CHARS = 80000
REVIEW_SKIP_SUFFIXES = [".json", ".lock", ".css", ".md", ".txt", ".log"]

# --- Fixed values: project types in detection order --------------------------------------
# (type, install command, launch command, port)

PROJECT_TYPES = [
    ("nextjs", "npm install", "npm run dev", "localhost:3000"),
    ("vite-react", "npm install", "npm run dev", "localhost:5173"),
    ("node-monorepo", "npm install", None, None),
    ("python-package", "pip install -e .", None, None),
    ("streamlit", "pip install -r requirements.txt", "streamlit run app.py", "localhost:8501"),
    ("fastapi", "pip install -r requirements.txt", "uvicorn main:app --reload", "localhost:8000"),
    ("flask", "pip install -r requirements.txt", "python app.py", "localhost:5000"),
    ("python-script", "pip install -r requirements.txt", None, None),
    ("docker", None, "docker-compose up", None),
    ("static-site", None, "python -m http.server 8080", "localhost:8080"),
    ("powershell-scripts", None, None, None),
]
PROJECT_SKIP_NAMES = ["node_modules", "__pycache__"]
PROBE_MAX_BYTES = 100_000

# --- Fixed values: finding texts ---------------------------------------------------------
# check id -> (severity, title, description, suggestion); None = decided per finding.

MESSAGES = {
    "STR1": ("high", "Flat project structure",
             "{n} code files at root level with no subdirectory organization.",
             "Group related files into packages/directories: e.g., src/, core/, utils/, tests/."),
    "STR2": ("medium", "Mixed concerns at root level",
             "Found {kinds} files all at root level.",
             "Separate into directories: src/ (logic), ui/ (GUI), tests/, scripts/, etc."),
    "STR3": ("low", "No Python packaging config",
             "No setup.py or pyproject.toml found.",
             "Add pyproject.toml for installable packaging, dependency management, and tool config."),
    "STR4": ("medium", "Hardcoded constants in logic file",
             "Found {n} potential hardcoded constants.",
             "Move constants to a config file or environment variables."),
    "REU1": ("medium", "Duplicated code block",
             "A {block_size}-line block appears in {n} files.",
             "Extract into a shared utility function."),
    "REU2": ("low", "Repeated import pattern",
             "Same imports appear in {n} files.",
             "Consider a shared module that re-exports common dependencies."),
    "REU3": ("low", "Complex inline expression",
             "Line {line}: {n} chars with nested calls.",
             "Extract intermediate steps into named variables for readability."),
    "CLA1": ("low", "Single-letter variable: '{names}'",
             "Line {line}: unclear variable name(s).",
             "Use descriptive names that explain the variable's purpose."),
    "CLA2": ("medium", "Long function: {name}() ({n} lines)",
             "Functions over {limit} lines are harder to understand and test.",
             "Break into smaller, focused helper functions."),
    "CLA3": ("low", "{n} functions/classes missing docstrings",
             "Including: {names}",
             "Add brief docstrings to public functions describing what they do and return."),
    "CLA4": ("low", "{n} magic numbers detected",
             "Hardcoded numeric values without explanation.",
             "Extract to named constants in config or at module top."),
    "CLA5": ("medium", "Deep nesting ({n} levels)",
             "Deepest nesting at line {line}.",
             "Use early returns, guard clauses, or extract nested logic into functions."),
    "FUN1": (None, "{marker} at line {line}", "{text}",
             "Address the TODO or create a tracked issue for it."),
    "FUN2": ("medium", "Stub function: {name}()",
             "Line {line}: function body is just '{body}'.",
             "Implement the function or remove it if unnecessary."),
    "FUN3": ("high", "Silent exception swallowing",
             "Line {line}: bare except with pass — errors will be invisible.",
             "Log the exception or handle specific exception types."),
    "FUN4": ("low", "Potentially unused imports: {names}",
             "{n} imported names not found in file body.",
             "Remove unused imports to reduce clutter."),
    "FUN5": ("medium", "Unreachable code after return/break",
             "Line {line}: code after '{text}' at line {from_line}.",
             "Remove dead code or restructure control flow."),
    "SEC1": ("critical", None, "Line {line}: potential secret detected.",
             "Move to environment variable (.env) and load with os.environ or python-dotenv."),
    "SEC2": ("high", None, "Line {line}",
             "Use safer alternatives or validate/sanitize all inputs."),
    "SEC3": ("critical", ".env file is tracked in repository",
             "Environment file with potential secrets is part of the repo.",
             "Add .env to .gitignore and remove from tracking with git rm --cached .env"),
    "SEC4": ("high", "No .gitignore file",
             "Repository has no .gitignore — sensitive files could be committed.",
             "Add a .gitignore covering .env, __pycache__, *.pyc, venv/, etc."),
    "AUT1": ("medium", "No CI/CD pipeline detected",
             "No GitHub Actions, GitLab CI, or other CI config found.",
             "Add .github/workflows/ci.yml for automated testing and linting on push."),
    "AUT2": ("high", "No tests found", "{n} code files but no test files.",
             "Add tests for core logic. Start with the most critical/complex functions."),
    "AUT2_LOW": ("medium", "Low test coverage: {tests} tests for {n} modules",
                 "Test-to-code ratio is below 30%.",
                 "Prioritize testing core business logic and edge cases."),
    "AUT3": ("low", "No linter/formatter configuration",
             "No ruff, flake8, black, or pre-commit config found.",
             "Add ruff (or flake8 + black) config for consistent code style."),
    "AUT4": ("low", "Automation hook opportunities identified",
             "{n} places where agents/APIs could plug in.",
             "See notes for specific hook point suggestions."),
    "AST1": ("low", "Unused import: {name}",
             "Line {line}: '{name}' is imported but never used.",
             "Remove the unused import of '{name}'."),
    "AST2": (None, "High cyclomatic complexity: {name}() = {n}",
             "Line {line}: function '{name}' has a cyclomatic complexity of {n} (threshold: 10).",
             "Break this function into smaller, focused helper functions."),
    "AST3": (None, "Long function: {name}() is {n} lines",
             "Lines {line}-{end}: function '{name}' spans {n} lines (threshold: 50).",
             "Extract logical sections into smaller helper functions."),
    "AST4": ("low", "Missing return type hint: {name}()",
             "Line {line}: public function '{name}' has no return type annotation.",
             "Add a return type: def {name}(...) -> ReturnType:"),
    "AST5": ("high", "Mutable default argument in {name}()",
             "Line {line}: function '{name}' uses a mutable {kind} as a default argument. "
             "This default is shared across all calls and mutations persist.",
             "Use None as the default and create the {kind} inside the function body: "
             "def {name}(..., arg=None): arg = arg or {kind}()"),
}

REPO_ROOT = "(repo root)"

NOTE_GITIGNORE = ".gitignore could also cover: {entries}"
NOTE_CLI = "{path}: add CLI argument parsing (argparse/click/typer)"
NOTE_API = "{path}: {n} functions — consider exposing key ones via API"
NOTE_SYNTAX = "Skipped {path}: syntax error"
NOTE_TOO_DEEP = "Skipped {path}: nested too deeply to be parsed"
