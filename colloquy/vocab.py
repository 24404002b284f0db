"""Word lists, lookup tables, constants and patterns the results depend on."""

# ---- fixed values: seed predicates (name, description) ------------------------------------
SEED_PREDICATES = [
    ("announced", "Entity made an announcement about something"),
    ("released", "Entity released a product, version, or artifact"),
    ("is-better-than", "Comparative claim of superiority"),
    ("is-faster-than", "Performance comparison"),
    ("is-safer-than", "Safety/security comparison"),
    ("acquired", "Entity acquired another entity"),
    ("deprecated", "Entity deprecated a feature or product"),
    ("supports", "Entity expresses support for something"),
    ("opposes", "Entity expresses opposition to something"),
    ("claims", "Entity makes a general claim"),
    ("uses", "Entity uses a technology or approach"),
    ("migrated-to", "Entity migrated from one thing to another"),
    ("has", "Entity has a feature or property"),
    ("lacks", "Entity lacks a feature or property"),
]

# ---- fixed values: opposite predicates, read in both directions ----------------------------
PREDICATE_OPPOSITES = {
    "supports": ["opposes", "rejects", "criticizes"],
    "opposes": ["supports", "endorses", "promotes"],
    "endorses": ["opposes", "rejects", "criticizes"],
    "rejects": ["supports", "endorses", "accepts"],
    "is-better-than": ["is-worse-than"],
    "is-worse-than": ["is-better-than"],
    "is-faster-than": ["is-slower-than"],
    "is-slower-than": ["is-faster-than"],
    "is-safer-than": ["is-less-safe-than", "is-more-dangerous-than"],
    "is-less-safe-than": ["is-safer-than"],
    "is-more-popular-than": ["is-less-popular-than"],
    "is-less-popular-than": ["is-more-popular-than"],
    "outperforms": ["underperforms"],
    "underperforms": ["outperforms"],
    "has": ["lacks", "missing"],
    "lacks": ["has", "includes", "contains"],
    "includes": ["excludes", "lacks"],
    "excludes": ["includes", "has"],
    "released": ["cancelled", "discontinued"],
    "cancelled": ["released", "launched"],
    "deprecated": ["introduced", "released"],
    "introduced": ["deprecated", "removed"],
    "uses": ["abandoned", "dropped"],
    "abandoned": ["uses", "adopted"],
    "adopted": ["rejected", "abandoned"],
    "migrated-to": ["migrated-from"],
    "migrated-from": ["migrated-to"],
}

# ---- fixed values: comparative predicates ---------------------------------------------------
COMPARATIVE_PREDICATES = [
    "is-better-than",
    "is-worse-than",
    "is-faster-than",
    "is-slower-than",
    "is-safer-than",
    "is-less-safe-than",
    "is-more-popular-than",
    "is-less-popular-than",
    "outperforms",
    "underperforms",
]

# ---- fixed values: negation prefixes of objects (positive, negative) -------------------------
NEGATION_PATTERNS = [
    (r"^has[-\s]", r"^lacks[-\s]|^missing[-\s]"),
    (r"^is[-\s]", r"^is[-\s]not[-\s]|^isnt[-\s]"),
    (r"^can[-\s]", r"^cannot[-\s]|^cant[-\s]"),
    (r"^supports[-\s]", r"^does[-\s]not[-\s]support"),
]

# ---- fixed values: confidence by structural contradiction type ------------------------------
CONTRADICTION_CONFIDENCE = {"direct": 0.95, "comparative": 0.9, "negation": 0.85}
CONTRADICTION_TYPES = ["direct", "semantic", "negation", "comparative"]

# ---- fixed values: controversy keywords ------------------------------------------------------
CONTROVERSY_KEYWORDS = [
    "disagree",
    "wrong",
    "incorrect",
    "actually,",
    "no,",
    "but ",
    "however",
    "false",
    "misleading",
    "unpopular opinion",
    "devil's advocate",
    "not true",
    "that's not",
    "i'd argue",
    "counterpoint",
    "on the other hand",
    "to be fair",
    "while i agree",
    "playing devil",
    "hot take",
    "controversial",
    "overrated",
    "underrated",
]
# The comment flag uses the first fifteen of them.
COMMENT_FLAG_KEYWORDS = CONTROVERSY_KEYWORDS[:15]

# ---- fixed values: camp patterns (case-insensitive) ------------------------------------------
CAMP_PATTERNS = [
    (r"rust\s*(is|vs)", "Rust advocates"),
    (r"go(lang)?\s*(is|vs)", "Go advocates"),
    (r"typescript\s*(is|vs)", "TypeScript supporters"),
    (r"javascript\s*(is|vs)", "JavaScript purists"),
    (r"oop\s*(is|vs)", "OOP proponents"),
    (r"functional\s*(is|vs)", "FP proponents"),
    (r"microservices?\s*(is|vs|are)", "Microservices advocates"),
    (r"monolith\s*(is|vs)", "Monolith defenders"),
    (r"vim\s*(is|vs)", "Vim users"),
    (r"emacs\s*(is|vs)", "Emacs users"),
    (r"linux\s*(is|vs)", "Linux users"),
    (r"mac(os)?\s*(is|vs)", "macOS users"),
    (r"windows\s*(is|vs)", "Windows users"),
]

# ---- fixed values: sentiment words -------------------------------------------------------------
POSITIVE_WORDS = ["love", "great", "amazing", "excellent"]
NEGATIVE_WORDS = ["hate", "terrible", "awful", "worst"]

# ---- fixed values: enumerations ------------------------------------------------------------------
SENTIMENTS = ["positive", "negative", "mixed", "neutral"]
CONTROVERSY_LEVELS = ["none", "low", "medium", "high"]
INFORMATION_DENSITIES = ["sparse", "moderate", "rich"]
SOURCE_STANCES = ["agrees", "disagrees", "neutral", "uncertain"]
PRIORITIES = ["urgent", "developing", "informational"]
NOTABLE_THREAD_TYPES = ["debate", "insight", "experience", "correction", "alternative", "deep-dive"]

# ---- fixed values: display symbols ------------------------------------------------------------------
PRIORITY_ICONS = {"urgent": "🔴", "developing": "🟡", "informational": "🟢"}
NOTABLE_THREAD_ICONS = {
    "debate": "⚔️",
    "insight": "💡",
    "experience": "📖",
    "correction": "✋",
    "alternative": "🔀",
    "deep-dive": "🔬",
}
DISCUSSION_THREAD_ICONS = {
    "debate": "⚔️",
    "insight": "💡",
    "story": "📖",
    "warning": "✋",
    "tangent": "🔀",
    "technical": "🔬",
}
STANCE_INDICATORS = {
    "agrees": ("✓", "agreed"),
    "disagrees": ("✗", "disagreed"),
    "neutral": ("~", "neutral"),
    "uncertain": ("?", "uncertain"),
}
UNRATED_INDICATOR = ("○", "unrated")

# ---- fixed values: model prices in USD per million tokens ---------------------------------------
INPUT_USD_PER_MILLION = 3.0
OUTPUT_USD_PER_MILLION = 15.0

# ---- fixed values: link policy -------------------------------------------------------------------
BLOCKED_DOMAINS = ["twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com"]
CUSTOM_DOMAINS = ["github.com", "medium.com", "dev.to", "hashnode.dev", "substack.com"]
INTERNAL_HOST_PREFIXES = [
    "169.254.169.254",
    "metadata.google.internal",
    "metadata.goog",
    "localhost",
    "127.0.0.1",
    "0.0.0.0",
    "[::1]",
    "169.254.",
]
INTERNAL_HOST_PATTERNS = [
    r"^10\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    r"^172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}$",
    r"^192\.168\.\d{1,3}\.\d{1,3}$",
    r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    r"^0\.0\.0\.0$",
    r"^::1$",
    r"^fc00:",
    r"^fe80:",
]
INTERNAL_HOST_SUFFIXES = [".local", ".internal"]

# ---- fixed values: page extraction -----------------------------------------------------------------
NON_CONTENT_SELECTORS = [
    "script", "style", "noscript", "nav", "header", "footer", "aside", "iframe", "form", "button",
    "[role='navigation']", "[role='banner']", "[role='contentinfo']", "[role='complementary']",
    ".nav", ".navbar", ".navigation", ".menu", ".sidebar", ".footer", ".header", ".advertisement",
    ".ad", ".ads", ".social-share", ".comments", ".related-posts",
]
CONTENT_SELECTORS = [
    "article", "[role='main']", "main", ".post-content", ".article-content", ".entry-content",
    ".content", ".post-body", ".article-body", ".markdown-body", "#content", "#main",
]
DOMAIN_CONTENT_SELECTORS = {
    "github.com": ([".markdown-body", ".readme"], [".octicon", ".anchor"]),
    "medium.com": (["article"], [".metabar", ".postActions"]),
    "dev.to": (["#article-body", ".crayons-article__body"], []),
    "substack.com": ([".body", ".post-content"], []),
}
HTML_ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©",
    "reg": "®", "trade": "™", "mdash": "—", "ndash": "–", "lsquo": "'", "rsquo": "'",
    "ldquo": "“", "rdquo": "”", "hellip": "…", "bull": "•", "middot": "·", "deg": "°",
    "plusmn": "±", "times": "×", "divide": "÷", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
    "sect": "§", "para": "¶", "dagger": "†", "Dagger": "‡", "laquo": "«", "raquo": "»",
}

# ---- fixed values: phrases masked before a claim text enters a prompt ---------------------------------
INJECTION_PATTERNS = [
    r"\bignore\s+(previous|above|all)\b",
    r"\bforget\s+(previous|above|all)\b",
    r"\bsystem\s*:",
    r"\binstruction\s*:",
]

# ---- fixed values: headings, table heads and notes of the rendered documents ---------------------------
WHAT_MATTERS_HEAD = "## What Matters\n\n| Topic | Impact | Status |\n|-------|--------|--------|\n"
WHAT_MATTERS_TAIL = "\n**Note:** 🔴 Urgent • 🟡 Developing • 🟢 Informational\n\n---\n\n"
TOP_DISCUSSIONS = "## Top Discussions\n\n"
THE_STORY = "**The Story:**"
NOTABLE_THREADS = "**Notable Threads:**"
HIGH_CONFIDENCE_CLAIMS = "**High-Confidence Claims:**\n"
MISSING_CONTEXT = "> ⚠️ **Missing context:** "
CONTROVERSIAL_MARK = " • ⚠️ **Controversial**"
DEBATE_MARK = " • ⚡ Debate"
LOW_ACTIVITY_HEAD = "## Low-Activity Posts\n\n<details>\n<summary>"
LOW_ACTIVITY_TAIL = "</details>\n\n"
TODAYS_THEMES = "## Today's Themes\n\n"
DISCUSSED_IN = "**Discussed in:**\n"
CONFLICTING_VIEWPOINTS = "## Conflicting Viewpoints\n\n*Opposing stances on the same topics, sourced from different posts:*\n\n"
VIEWPOINT_TABLE = "| Topic | View A | View B |\n|-------|--------|--------|\n"
VIEWPOINT_SOURCES = "\n**Sources:**\n"
EMERGING_PATTERNS = "## Emerging Patterns\n\n"
MAIN_CLAIM = "**Main Claim:** "
COMMUNITY_SPLIT = "**Community Split:**\n"
NUANCES = "**Nuances:**\n"
MATTERS_TODAY_HEAD = "## What Matters Today\n\n| Priority | Topic | Impact | Status |\n|:--------:|-------|--------|--------|\n"
MATTERS_TODAY_TAIL = "\n**Priority**: 🔴 Urgent · 🟡 Developing · 🟢 Informational\n"
KEY_THREADS = "**Key Discussion Threads:**\n"

# ---- fixed values: what stands for a link that gives no text ----------------------------------------------
LINK_NOT_FETCHED = "(Link post - external content could not be fetched)"
LINK_ERROR = ("(Link post - ", ")")
LINK_NOT_EXTRACTED = ("(Link post to ", " - content extraction failed)")
