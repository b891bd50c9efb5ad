"""Word lists and lookup tables that results depend on."""
import mimetypes

# --- Fixed values: names never scanned -------------------------------------------------
EXCLUDED_NAMES = ["__pycache__", ".git", ".svn", ".hg"]
EXCLUDED_NAMES_ANY_CASE = ["thumbs.db", "desktop.ini", ".ds_store"]

# --- Fixed values: extensions read as text by the scan ---------------------------------
TEXT_EXTENSIONS = [
    ".asm", ".asp", ".aspx", ".avdl", ".bash", ".bat", ".bazel", ".bzl", ".c", ".cc", ".cfg", ".cjs", ".cl",
    ".clj", ".cljc", ".cljs", ".cmd", ".conf", ".cpp", ".cs", ".csh", ".css", ".csv", ".cxx", ".dart",
    ".dockerfile", ".editorconfig", ".ejs", ".el", ".env", ".erb", ".erl", ".ex", ".exs", ".fs", ".fsi",
    ".fsx", ".gitattributes", ".gitignore", ".go", ".gradle", ".groovy", ".h", ".hbs", ".hh", ".hpp",
    ".hrl", ".hs", ".htm", ".html", ".hxx", ".ini", ".ipynb", ".java", ".jinja", ".jinja2", ".jl", ".js",
    ".json", ".jsp", ".jsx", ".ksh", ".kt", ".kts", ".less", ".lhs", ".lisp", ".log", ".lsp", ".lua", ".m",
    ".make", ".makefile", ".markdown", ".md", ".mjs", ".mk", ".ml", ".mli", ".mm", ".mod", ".mustache",
    ".php", ".phtml", ".pl", ".pm", ".properties", ".proto", ".ps1", ".psd1", ".psm1", ".psql", ".py",
    ".pyw", ".r", ".rb", ".rs", ".rst", ".s", ".sass", ".sc", ".scala", ".scm", ".scss", ".sh", ".spec",
    ".sql", ".sum", ".swift", ".t", ".tex", ".thrift", ".tmpl", ".toml", ".tpl", ".ts", ".tsx", ".twig",
    ".txt", ".xhtml", ".xml", ".xsd", ".xslt", ".yaml", ".yml", ".zsh",
]
TEXT_NAMES = ["changelog", "dockerfile", "license", "makefile", "readme"]

# --- Fixed values: extensions the capsule treats as text -------------------------------
CAPSULE_TEXT_EXTENSIONS = [
    ".cfg", ".css", ".html", ".ini", ".js", ".json", ".md", ".py", ".toml", ".ts", ".txt", ".yaml", ".yml",
]

# --- Fixed values: size limits in bytes ------------------------------------------------
DROP_ABOVE = 100 * 1024 * 1024
READ_LIMIT = 5 * 1024 * 1024
CAPSULE_LIMIT = 1024 * 1024
COMPACT_LIMIT = 512 * 1024

# --- Fixed values: language by extension, per dialect, with the dialect's default ------
LANGUAGES = {
    "engine": {
        ".cfg": "config", ".css": "css", ".html": "html", ".ini": "ini", ".js": "javascript",
        ".json": "json", ".md": "markdown", ".py": "python", ".toml": "toml",
        ".ts": "typescript", ".txt": "text", ".yaml": "yaml", ".yml": "yaml",
    },
    "deep": {
        ".avi": "Video", ".cfg": "Config", ".conf": "Config", ".css": "CSS", ".flac": "Audio",
        ".gif": "Image", ".htm": "HTML", ".html": "HTML", ".ini": "Config", ".jpeg": "Image",
        ".jpg": "Image", ".js": "JavaScript/TypeScript", ".json": "JSON",
        ".markdown": "Markdown", ".md": "Markdown", ".mov": "Video", ".mp3": "Audio",
        ".mp4": "Video", ".png": "Image", ".py": "Python", ".svg": "Image",
        ".ts": "JavaScript/TypeScript", ".wav": "Audio", ".yaml": "YAML", ".yml": "YAML",
    },
    "capsule": {
        ".cfg": "ini", ".css": "css", ".html": "html", ".ini": "ini", ".js": "javascript",
        ".json": "json", ".md": "markdown", ".py": "python", ".toml": "toml",
        ".ts": "typescript", ".txt": "text", ".yaml": "yaml", ".yml": "yaml",
    },
    "content": {
        ".c": "c", ".cpp": "cpp", ".css": "css", ".go": "go", ".html": "html",
        ".java": "java", ".js": "javascript", ".json": "json", ".md": "markdown",
        ".php": "php", ".py": "python", ".rb": "ruby", ".rs": "rust", ".sh": "bash",
        ".sql": "sql", ".ts": "typescript", ".txt": "text", ".xml": "xml",
        ".yaml": "yaml", ".yml": "yaml",
    },
}
MEDIA_LANGUAGES = ["Image", "Audio", "Video"]

# --- Fixed values: section kinds -------------------------------------------------------
CONFIG_EXTENSIONS = [".cfg", ".env", ".ini", ".json", ".toml", ".yaml", ".yml"]
CONFIG_NAMES = ["dockerfile", "makefile"]
DOC_EXTENSIONS = [".md", ".rst", ".txt"]
CODE_EXTENSIONS = [".bat", ".css", ".html", ".js", ".py", ".sh", ".sql", ".ts"]
DATA_EXTENSIONS = [".csv", ".log"]

# --- Fixed values: config files whose keys are listed ----------------------------------
KEYED_EXTENSIONS = [".cfg", ".ini", ".json", ".toml", ".yaml", ".yml"]

# --- Fixed values: user-interface base classes and call suffixes -----------------------
UI_BASES = [
    "Application", "Builder", "Button", "CTk", "CTkButton", "CTkEntry", "CTkFrame", "CTkLabel",
    "Canvas", "Entry", "Frame", "Gtk.Button", "Gtk.Entry", "Gtk.Label", "Gtk.Window", "Label",
    "QLabel", "QLineEdit", "QMainWindow", "QPushButton", "QWidget", "Text", "Tk", "Toplevel",
]
UI_CALL_SUFFIXES = ["Button", "CTk", "Frame", "Label", "Tk"]

# --- Fixed values: default capsule globs -----------------------------------------------
INCLUDE_GLOBS = ["**"]
EXCLUDE_GLOBS = ["**/.venv/**", "**/__pycache__/**", "**/.git/**"]

# --- Fixed values: token patterns ------------------------------------------------------
CAPSULE_WORD = r"[A-Za-z_][A-Za-z0-9_]{3,}"
CORPUS_WORD = r"[A-Za-z_][A-Za-z0-9_]{2,}"

# MIME types come from the standard library's own table; host files are not consulted.
_MIME = mimetypes.MimeTypes(filenames=())
MIME_TYPES = dict(_MIME.types_map[True])
MIME_ALIASES = dict(_MIME.suffix_map)
MIME_ENCODINGS = dict(_MIME.encodings_map)
