"""Values that decide results and therefore stay exactly as they are.

Nothing in this module is logic. Query-string keys, media types, link scopes and
patterns are listed in their natural order; other modules only read them.
"""

# --- fixed values: query keys that only track the visitor -----------------------
TRACKING_KEYS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "ref",
    "source",
    "mc_cid",
    "mc_eid",
)

# --- fixed values: schemes that always print "//" ------------------------------
NETLOC_SCHEMES = ("http", "https", "ftp", "file", "ws", "wss", "sftp")

# --- fixed values: link patterns in free text ----------------------------------
MARKDOWN_LINK = r"(?<!!)\[([^\]]*)\]\(([^)]+)\)"
MARKDOWN_BARE = r"""(?iU)(?<![(\[])https?://[^\s<>"')]+(?![)\]])"""
BOARD_BARE = r"""(?iU)https?://[^\s<>"')\]]+"""
MARKDOWN_TRAIL = ".,;:!?"
BOARD_TRAIL = ".,;:!?|"
BOARD_HOSTS = ("trello.com", "www.trello.com")

# --- fixed values: where article links live on a page --------------------------
SCOPE_TAGS = ("article", "main")
SCOPE_CLASSES = ("post", "entry", "article", "content")
SCOPE_PATHS = ("/post/", "/article/", "/blog/", "/news/")

# --- fixed values: links that never are articles -------------------------------
EXCLUDED_LINKS = (
    r"^#",
    r"^javascript:",
    r"^mailto:",
    r"\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot)$",
    r"/(tag|category|author|page|wp-content|wp-includes)/",
    r"/(login|logout|register|signup|signin)/",
    r"/(search|feed|rss|atom)/",
)
SITEMAP_NAMES = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml")
MAX_SITE_LINKS = 100

# --- fixed values: video urls --------------------------------------------------
VIDEO_URLS = (
    r"^https?://(www\.)?youtube\.com/watch\?v=[\w-]+",
    r"^https?://youtu\.be/[\w-]+",
    r"^https?://(www\.)?youtube\.com/shorts/[\w-]+",
)
VIDEO_ID_PATTERNS = (
    r"[?&]v=([\w-]+)",
    r"youtu\.be/([\w-]+)",
    r"shorts/([\w-]+)",
)
VIDEO_TAGS = ("video", "youtube")
VIDEO_TITLE_SUFFIX = " - YouTube"
THUMBNAIL_PREFIX = "https://img.youtube.com/vi/"
THUMBNAIL_SUFFIX = "/maxresdefault.jpg"
THUMBNAIL_TYPE = "image/jpeg"

# --- fixed values: media suffixes and their types, first match wins -------------
MEDIA_TYPES = (
    (".mp3", "audio/mpeg"),
    (".m4a", "audio/mp4"),
    (".ogg", "audio/ogg"),
    (".wav", "audio/wav"),
    (".flac", "audio/flac"),
    (".aac", "audio/aac"),
    (".mp4", "video/mp4"),
    (".webm", "video/webm"),
    (".mkv", "video/x-matroska"),
    (".avi", "video/x-msvideo"),
    (".mov", "video/quicktime"),
    (".pdf", "application/pdf"),
)
# A response header is trusted only for these types (no x-msvideo).
HEADER_TYPES = (
    "audio/mpeg",
    "audio/mp4",
    "audio/ogg",
    "audio/wav",
    "audio/flac",
    "audio/aac",
    "video/mp4",
    "video/webm",
    "video/x-matroska",
    "video/quicktime",
    "application/pdf",
)
UNKNOWN_TYPE = "application/octet-stream"

# --- fixed values: lengths -----------------------------------------------------
SUMMARY_CHARS = 500
SUMMARY_BLOCKS = 4
SUMMARY_MIN_CHARS = 100
TAG_MIN_CHARS = 2
TAG_MAX_CHARS = 30
MAX_TAGS = 5
BYLINE_PREFIX = r"^(By|by|BY) "

# --- fixed values: feed documents ----------------------------------------------
JSON_FEED_VERSION = "https://jsonfeed.org/version/1.1"
UNTITLED_FEED = "Untitled Feed"
UNNAMED_FEED = "unnamed"
PLACEHOLDER_LINK = "https://example.com"
XML_INVALID = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SITE_TITLE = "Feed Index"
SITE_DESCRIPTION = "A collection of RSS and JSON feeds"
NO_DESCRIPTION = "No description"
NO_DATE = "Unknown"
NO_FEEDS = "<dd>No feeds found</dd>"

# --- fixed values: elements without an end tag ---------------------------------
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
)

# --- fixed values: entity names that the check SQL decodes (amp stays last) -----
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&trade;", "™"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&bull;", "•"),
    ("&middot;", "·"),
    ("&euro;", "€"),
    ("&pound;", "£"),
    ("&amp;", "&"),
)

# --- fixed values: words that never become a topic tag -------------------------
STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "are", "was",
    "les", "des", "une", "est", "que", "qui", "dans", "pour",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine",
    "los", "las", "una", "por", "con", "para",
)
