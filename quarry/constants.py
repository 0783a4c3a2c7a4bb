"""Fixed values that must equal the indexer's behaviour for identical results.

Everything in this module is data, not logic: lists, maps, patterns and limits
stated once, in natural order.
"""

# --- fixed values: language by lower-cased file extension ---------------------------------
LANGUAGE_BY_EXTENSION = {
    ".go": "go",
    ".py": "python",
    ".rs": "rust",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".jsx": "jsx",
    ".sh": "shell",
    ".bash": "shell",
    ".ps1": "powershell",
    ".md": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
}
LANGUAGE_NO_EXTENSION = "text"

# --- fixed values: directory names pruned from a scan (compared lower-cased) --------------
SKIP_DIR_NAMES = (".git", ".hg", ".svn", "node_modules", ".idea", ".vscode")

# --- fixed values: Unicode white space (the set trimmed by the text tools) ----------------
# tab, LF, VT, FF, CR, space, NEL, NBSP, OGHAM SPACE MARK, EN QUAD..HAIR SPACE,
# LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATH SPACE, IDEOGRAPHIC SPACE.
UNICODE_SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# the same set as a character class, with \x{..} escapes that Java and RE2 expressions share
UNICODE_SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in UNICODE_SPACE_CHARS) + "]"

# --- fixed values: terminal escape sequences, removed in this order ----------------------
ANSI_OSC = r"\x1b\][^\x07]*(\x07|\x1b\\)"
ANSI_CSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
ANSI_CSI_8BIT = r"\x{9b}[0-9;?]*[ -/]*[@-~]"
ANSI_SS3 = r"\x1bO[^\n]"

# --- fixed values: chunk size, batch sizes, markers ------------------------------------------------------------------
MAX_TOKENS_PER_CHUNK = 768
EMBED_BATCH_SIZE = 16
PCA_EMBED_BATCH_SIZE = 128
PCA_PADDED_WIDTH = 1024
TOPK_DEFAULT = 5
SNIPPET_ELLIPSIS = "…"
EOF_MARKER = "<|EOF|>"
TRUNCATED_MARKER = ". . .truncated"
MODEL_RECORD_PREFIX = "vector_model:"
CHUNK_GRANULARITY = "file_chunk"
CHUNK_ID_LABEL = "chunk"
CENTROID_KIND = "centroid@file"
ID_HEX_CHARS = 20
RUN_ID_HEX_CHARS = 8

# --- default tokenizer: lossless white-space tokens (a word and its trailing blanks) ------
TOKEN_PATTERN = "[^ \t\r\n]+[ \t\r\n]*|[ \t\r\n]+"
# --- hash embedder: words are maximal runs of non-blank characters ------------------------
WORD_PATTERN = "[^ \t\r\n]+"

