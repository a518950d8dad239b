"""Fixed values that results depend on."""

# fixed values: documents and jobs
HIDDEN_STATUSES = ("disabled", "deleting")
STATUS_ALIASES = {"parsing": "embedding", "indexing": "vector_indexing"}
TERMINAL_DOCUMENT = ("ready", "failed", "disabled", "deleting")
TERMINAL_JOB = ("succeeded", "dead", "failed", "cancelled")
DOC_KINDS = ("plan", "spec", "drawing", "quantity", "other")

# fixed values: ingest steps in order, with the percentage and the phase each stands for
INGEST_STEPS = (
    ("upload_to_ocr", 15, "ocr"),
    ("poll_and_fetch_ocr", 35, "ocr"),
    ("parse_outline", 45, "embedding"),
    ("section_aware_chunk", 55, "embedding"),
    ("embed_batch", 70, "embedding"),
    ("track_a_write", 82, "vector_indexing"),
    ("track_b_write", 90, "vector_indexing"),
    ("asset_register", 96, "vector_indexing"),
    ("finalize", 100, "ready"),
)
PHASES = ("pending", "ocr", "embedding", "vector_indexing", "ready")
PHASE_FLOORS = {"ocr": 8, "embedding": 40, "vector_indexing": 75}

# fixed values: entities that pages hold most, the ampersand last; any other beginning of an entity
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|copy|middot|nbsp|amp);)[#A-Za-z]"

# fixed values: text patterns
HTML_TAG = r"</?[A-Za-z][^>]*>"
ASCII_TOKEN = r"[a-z0-9_]+"
CJK_RUN = r"[\x{4e00}-\x{9fff}]+"
HASH_HEADING = r"^(#{1,4})(?U:\s+)(.+?)(?U:\s*)$"
CHAPTER_HEADING = r"^(第[一二三四五六七八九十百千万0-9]+[章节篇部])(?U:\s*)(.*)$"
NUMBER_HEADING = r"^(\d+(?:\.\d+){0,4})(?U:[、.\s]+)(.+)$"
SENTENCE_END = r"(?U)(?<=[。！？；.!?;])\s+"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
PAGE_SPLIT = "<--- Page Split --->"
UNTITLED = "未分章节"
NO_EVIDENCE = ("无法在知识库中找到依据", "未在知识库中找到依据", "没有在知识库中找到依据")
UNIT_SEPARATORS = "，,。；;！？\n"

# fixed values: LaTeX fragments and what stands for them, in order
PLAIN_MATH = (
    (r"\\text\{([^}]*)\}", "$1"), (r"(?i)\^\{\\circ\}\s*([CF])?", "°$1"), (r"(?i)\\circ\s*([CF])?", "°$1"), (r"\\sim", " 至 "),
    (r"\\leq?", "≤"), (r"\\geq?", "≥"), (r"\\times", "×"), (r"\\cdot", "·"), (r"\\pm", "±"), (r"\\%", "%"),
    (r"\^\{([^}]*)\}", "^$1"), (r"_\{([^}]*)\}", "_$1"), (r"[{}]", ""), (r"\\([a-zA-Z]+)", "$1"), (r"(?U)\s+", " "),
)
# fixed values: delimiters of formulas in order, and lines that begin the references of an answer
FORMULAS = (r"\$\$([\s\S]*?)\$\$", r"\$([^$\n]+)\$", r"\\\(([\s\S]*?)\\\)", r"\\\[([\s\S]*?)\\\]")
REFERENCE_LINE = r"(?i)^(#{1,6}\s*)?(\*\*)?\s*(引用依据|引用内容|参考文档|参考资料|参考来源|References)\s*[:：]?\s*(\*\*)?\s*$"
# fixed values: marks of recognised pages
END_MARK = "<｜end▁of▁sentence｜>"
GROUNDING = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"

# fixed values: numbers
SPARSE_DIMENSIONS = 500_000
FUSION_OFFSET = 60
CHUNK_TOKENS, CHUNK_OVERLAP, PARAGRAPH_TOKENS = 512, 64, 256
EMBED_BATCH = 25
SCAN_CHUNKS = 5_000
DEBUG_DEPTH, DEBUG_CHARACTERS = (1, 50), 1024
LOGIN_LIMIT, LOGIN_WINDOW = 5, 900
BUCKET_SIZE, BUCKET_REFILL = 10.0, 10.0
