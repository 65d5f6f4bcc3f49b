"""Fixed values that decide results: word lists, thresholds, patterns and message texts."""

# --- file rules (fixed values) -------------------------------------------------------------
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".pptx", ".epub", ".txt", ".text", ".md"]
MAX_FILE_SIZE = 100 * 1024 * 1024
SUSPICIOUS_PATTERNS = ["<script", "javascript:", "eval(", "exec(", "__import__"]
EXPECTED_MIME = {
    ".pdf": ["application/pdf"],
    ".docx": [
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/msword",
    ],
    ".pptx": [
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "application/vnd.ms-powerpoint",
    ],
    ".epub": ["application/epub+zip"],
    ".txt": ["text/plain"],
    ".text": ["text/plain"],
    ".md": ["text/plain", "text/markdown"],
}
DEFAULT_MIME = "application/octet-stream"

# --- OCR rules (fixed values) --------------------------------------------------------------
OCR_MAX_BYTES = 50 * 1024 * 1024
OCR_MAX_PAGES = 500
OCR_LOW_CONFIDENCE = 70.0
OCR_CORRECT_BELOW = 50.0
SCANNED_CHARS_PER_PAGE = 50

# --- ranking (fixed values) ----------------------------------------------------------------
CODE_FENCES = ["```", "~~~"]
CODE_KEYWORDS = [
    "def ", "function ", "class ", "const ", "let ", "var ",
    "import ", "from ", "return ", "if __name__",
    "public ", "private ", "protected ",
    "=>", "->", "::", "//", "/*", "*/",
]
CONCEPT_KEYWORDS = [
    "theory", "concept", "principle", "framework",
    "why", "because", "reason", "explanation",
    "understand", "meaning", "significance",
    "abstract", "fundamental", "underlying",
    "philosophy", "approach", "methodology",
    "perspective", "viewpoint", "interpretation",
]
MODE_BOOST = {"files": 1.0, "coding": 1.2, "thinking": 1.15}
# mode -> (top_k, temperature, context strategy)
MODE_SETTINGS = {
    "files": (10, 0.3, "detailed"),
    "coding": (8, 0.5, "concise"),
    "thinking": (6, 0.7, "exploratory"),
}
DEFAULT_THRESHOLD = 0.15
NEAR_DUPLICATE_THRESHOLD = 0.92
MEMO_TTL_SECONDS = 300

# --- conversations (fixed values) ----------------------------------------------------------
REFERENCE_TERMS = [
    "it", "this", "that", "these", "those", "them", "they", "their", "he", "she",
    "above", "previous", "earlier", "mentioned", "said", "explain more", "elaborate",
    "continue", "what about", "how about", "also",
]
STOP_WORDS = [
    "the", "a", "an", "in", "on", "at", "to", "for", "and", "or", "but", "of", "is", "are",
    "was", "were", "that", "this", "these", "those", "with", "by", "about", "as", "it", "be",
    "from", "we", "you", "i", "my", "your", "our",
]
GENERIC_TITLE = "(untitled|new chat|question|chat|conversation)"
NEW_CHAT = "New Chat"
MAX_TITLE_CHARS = 60
MAX_TITLE_WORDS = 6
CHAT_NAME_PATTERN = r"^[a-zA-Z0-9\s\-_.,!?()]+$"
RESPONSE_CHAR_LIMIT = 100000
TRUNCATED_NOTE = "\n\n[Response was truncated due to length limit]"
TIMEOUT_NOTE = "\n\n[Response was cut off due to timeout]"

# --- telemetry (fixed values) --------------------------------------------------------------
# declared order matters: the first key contained in the operation name wins
SLOW_THRESHOLDS_MS = {
    "contextualization": 1000,
    "documentSearch": 500,
    "llmFirstToken": 5000,
    "llmStreaming": 120000,
    "searchQuery": 200,
    "messageProcessing": 3000,
    "fileUpload": 60000,
}
# import stages in order, with the progress a new document starts at
IMPORT_STAGES = [
    ("Initialize", "Finished"),
    ("Parse", "Not Started"),
    ("Split", "Not Started"),
    ("Embed", "Not Started"),
    ("Save Excerpts", "Not Started"),
]
# first matching row wins; needles are compared with the lower-cased message
ERROR_TYPES = [
    (["spawn", "enoent"], "PROCESS_SPAWN"),
    (["timeout"], "TIMEOUT"),
    (["eacces", "eperm", "permission"], "FILE_SYSTEM"),
    (["econnrefused", "network", "fetch"], "NETWORK"),
    (["validation", "invalid"], "VALIDATION"),
]
UNRECOVERABLE = ["eacces", "eperm", "out of memory"]
RETRYABLE = ["timeout", "econnrefused", "network", "unavailable"]
NOT_RETRYABLE = ["validation", "invalid", "not found", "permission"]
# first matching row wins; needles are case-sensitive
UPLOAD_ERRORS = [
    (["ENOENT", "not found"], "File not found. The file may have been moved or deleted."),
    (["EACCES", "permission"], "Permission denied. Please check file permissions."),
    (
        ["timeout", "timed out", "504"],
        "Processing timed out. The file may be too large or complex. "
        "Try splitting it into smaller parts.",
    ),
    (
        ["ECONNREFUSED", "ECONNRESET"],
        "Backend server is not running. Please start the Python backend server.",
    ),
    (["network"], "Network error. Please check your connection."),
    (["unsupported", "format"], "Unsupported file format."),
    (
        ["too large", "size", "50MB", "500 pages"],
        "File is too large for OCR processing. Maximum: 50MB or 500 pages. "
        "Try splitting the PDF.",
    ),
    (["parse", "parsing"], "Failed to parse document. The file may be corrupted."),
    (["embed", "embedding"], "Failed to process document. Please try again."),
    (
        ["status code 500", "Internal Server Error"],
        "Server error while processing document. The file may be too large or complex. "
        "Check backend logs for details.",
    ),
    (
        ["OCR", "scanned"],
        "OCR processing failed. The scanned document may be too large or low quality.",
    ),
]
UPLOAD_ERROR_FALLBACK = "Upload failed. Please try again or check if the file is too large."
# (needle in message, needle in exception type, category, status, user message)
HTTP_NEEDLES = [
    ("chroma", "chromadb", "ChromaDB Error", 503,
     "Database service is temporarily unavailable. Please try again."),
    ("embedding", "sentencetransformer", "Embedding Error", 500,
     "Failed to generate embeddings. Please check if the embedding model is available."),
    ("ollama", None, "Ollama Error", 503,
     "LLM service is unavailable. Please ensure Ollama is running."),
]
# exception type -> (category, status, message; {} is the original message)
HTTP_TYPES = {
    "FileNotFoundError": ("File Not Found", 404, "File not found: {}"),
    "PermissionError": ("Permission Error", 403,
                        "Permission denied accessing the requested resource."),
    "ValueError": ("Validation Error", 400, "Invalid input: {}"),
    "TimeoutError": ("Timeout Error", 504, "Operation timed out. Please try again."),
}
HTTP_FALLBACK = ("Internal Server Error", 500, "An unexpected error occurred. Please try again.")
