"""Lookup tables. FIXED VALUES: these must equal the scanner being replaced."""

from __future__ import annotations

# FIXED VALUES: file extension -> language.
EXTENSION_LANGUAGE = {
    ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript",
    ".py": "Python", ".pyw": "Python",
    ".rb": "Ruby", ".go": "Go", ".cs": "C#", ".php": "PHP",
    ".swift": "Swift", ".dart": "Dart",
    ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hrl": "Erlang",
    ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".fish": "Shell",
    ".c": "C", ".cpp": "C", ".cc": "C", ".h": "C", ".hpp": "C",
    ".html": "HTML", ".htm": "HTML",
    ".tf": "Terraform", ".tfvars": "Terraform", ".hcl": "Terraform",
}

# Optional extension map for infrastructure scans (not in the default map,
# so Kubernetes rules can fire on manifests).
IAC_EXTENSION_LANGUAGE = {**EXTENSION_LANGUAGE, ".yaml": "Kubernetes", ".yml": "Kubernetes"}

# FIXED VALUES: path segments that are never scanned.
DEFAULT_IGNORE_PATHS = (
    ".git", "node_modules", "vendor", ".cache", "dist", "build", ".next", ".nuxt",
    "out", "target", "__pycache__", ".pytest_cache", ".tox", "venv", ".venv", "env",
    ".mypy_cache", ".gradle", ".m2", "testdata", "fixtures", "test_fixtures",
)

# FIXED VALUES: extra extensions admitted only for secret scanning.
LEAK_ONLY_EXTENSIONS = (
    ".env", ".yaml", ".yml", ".json", ".xml", ".conf", ".config", ".ini",
    ".properties", ".toml", ".txt",
)

# FIXED VALUES: media / archive / binary extensions skipped by the history scan.
MEDIA_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg",
    ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".wav",
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".exe", ".dll", ".so", ".dylib",
    ".class", ".jar", ".war",
    ".lock",
)

# FIXED VALUES: ecosystem -> advisory database ecosystem. "pypi" and
# "packagist" (what the manifest jobs emit) are mapped as well.
ECOSYSTEM_DB_NAME = {
    "npm": "npm", "pip": "PyPI", "maven": "Maven", "go": "Go", "composer": "Packagist",
    "rubygems": "RubyGems", "pub": "Pub", "cargo": "crates.io", "nuget": "NuGet",
    "pypi": "PyPI", "packagist": "Packagist",
}

# FIXED VALUES: manifest base names per format.
MANIFEST_NAMES = {
    "npm": ("package.json",),
    "maven": ("pom.xml",),
    "requirements": ("requirements.txt", "requirements-dev.txt"),
    "gemfile": ("Gemfile.lock",),
    "gomod": ("go.mod",),
    "composer": ("composer.json",),
    "pubspec": ("pubspec.yaml", "pubspec.yml"),
}

# FIXED VALUES: language aliases accepted in rule files (lower-cased key).
LANGUAGE_ALIASES = {
    "java": "Java", "kotlin": "Kotlin", "javascript": "JavaScript", "js": "JavaScript",
    "typescript": "TypeScript", "ts": "TypeScript", "python": "Python", "py": "Python",
    "ruby": "Ruby", "rb": "Ruby", "go": "Go", "golang": "Go", "csharp": "C#", "c#": "C#",
    "cs": "C#", "php": "PHP", "swift": "Swift", "dart": "Dart", "elixir": "Elixir",
    "ex": "Elixir", "erlang": "Erlang", "erl": "Erlang", "shell": "Shell", "bash": "Shell",
    "sh": "Shell", "c": "C", "cpp": "C", "c++": "C", "html": "HTML", "terraform": "Terraform",
    "tf": "Terraform", "hcl": "Terraform", "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "nginx": "Nginx",
}

# FIXED VALUES: private, loopback and link-local address blocks.
PRIVATE_CIDRS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
    "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10",
)

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

# FIXED VALUES: limits of the original tool. They are opt-in arguments here; no operator applies one by default.
LEAK_FILE_CAP = 5 * 1024 * 1024
HISTORY_FILE_CAP = 1024 * 1024
MANIFEST_FILE_CAP = 10 * 1024 * 1024
RULE_FILE_CAP = 5 * 1024 * 1024
LEAK_LINE_CAP = 10000
SCANNER_TOKEN_LIMIT = 64 * 1024
HISTORY_COMMIT_CAP = 10000
ENTROPY_MIN = 3.5
CACHE_TTL_HOURS = 168
