"""Rule tables and thresholds as one immutable object; every operator takes it as a parameter and has these as defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Rule tables that decide results. ------------------------------------------------------------------------

STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does",
    "for", "from", "had", "has", "have", "he", "her", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it",
    "its", "may", "more", "new", "news", "not", "of", "on", "or", "our", "out", "over", "says", "say", "said", "she",
    "that", "the", "their", "them", "there", "they", "this", "to", "up", "was", "we", "were", "what", "when", "where",
    "which", "who", "why", "will", "with", "would", "you", "your", "after", "before", "amid", "about", "across",
    "near", "latest", "update", "updates", "story", "stories", "local", "ontario", "london", "government", "police",
    "city", "council", "mayor", "mayoral", "candidate", "announces", "announced", "investigate", "investigates",
    "investigating", "approves", "approved", "project", "plan", "plans", "report", "reports", "reported", "official",
    "officials", "former", "downtown", "area", "charge", "charged", "charges", "charging", "investigation",
    "investigations", "officer", "officers", "suspect", "suspects", "person", "people",
)

LOCAL_TERMS = (
    (35, "London, Ontario", ("london ontario", "london ont", "london on", "london-area", "london area", "londoner", "londoners")),
    (30, "City of London", ("city of london", "london city council", "london city hall", "london mayor")),
    (28, "London Police", ("london police", "london police service", "lps media")),
    (28, "London Fire", ("london fire department", "london fire", "ldnontfire")),
    (26, "Western University", ("western university", "western mustangs")),
    (26, "Fanshawe College", ("fanshawe college", "fanshawe")),
    (26, "London health", ("london health sciences centre", "lhsc", "middlesex-london health unit", "mlhu")),
    (24, "London schools", ("thames valley district school board", "tvdsb", "london district catholic school board", "ldcsb")),
    (24, "London Transit", ("london transit", "ltc", "ltc bus", "london transit commission")),
    (24, "London Knights", ("london knights", "budweiser gardens", "canada life place")),
    (22, "Middlesex", ("middlesex county", "middlesex centre", "middlesex-london", "middlesex county opp")),
    (18, "St. Thomas", ("st thomas", "st. thomas", "st-thomas")),
    (18, "Strathroy", ("strathroy", "strathroy-caradoc")),
    (16, "Thames Centre", ("thames centre", "dorchester", "thorndale")),
    (14, "Nearby community", ("lucan", "ilderton", "komoka", "mount brydges", "glencoe", "parkhill", "grand bend", "lambton shores", "ausable river")),
    (10, "London neighbourhood", ("old east village", "wortley village", "byron", "masonville", "white oaks", "hyde park", "lambeth", "westmount", "oakridge", "argyle", "soho", "pond mills", "river bend", "sunningdale")),
    (10, "London street", ("richmond street", "dundas street", "oxford street", "wellington road", "commissioners road", "highbury avenue", "wonderland road", "adelaide street", "wharncliffe road", "fanshawe park road", "hamilton road", "springbank drive", "baseline road", "base line road")),
    (8, "London landmark", ("covent garden market", "victoria park", "thames river", "springbank park", "storybook gardens")),
    (5, "Southwestern Ontario", ("southwestern ontario", "southwest ontario")),
    (26, "London airport", ("london international airport", "london airport", "yxu airport", "fly yxu")),
)

CORE_LABELS = ("London, Ontario", "City of London", "London Police", "London Fire")

NEGATIVE_TERMS = (
    (-90, "London, UK", ("london england", "london uk", "greater london", "westminster uk", "downing street", "british prime minister")),
    (-45, "United Kingdom", ("united kingdom", "uk government", "british government", "england")),
)

#: Score that a source's rows start from.
SOURCE_PRIORS = {
    "London Police Service": 55,
    "London Fire Department": 55,
    "City of London Newsroom": 55,
    "106.9 The X": 35,
    "London Free Press": 30,
    "CBC News London": 30,
    "Global News London": 20,
    "CTV News": 15,
    "104.7 Heart FM": 10,
}

#: Sources of public notices: a low local score is no fault of theirs.
OFFICIAL_SOURCES = ("City of London Newsroom", "London Police Service", "London Fire Department")

#: Sources whose short bodies mean a failed extraction.
PUBLISHERS = ("CBC News London", "CTV News", "Global News London", "London Free Press", "104.7 Heart FM", "106.9 The X")

#: Local score that a source's rows need, sources no longer shown, titles that are no stories.
GATE = {"Global News London": 30, "CTV News": 25, "104.7 Heart FM": 25, "London Free Press": 35}
RETIRED_SOURCES = ("London Fire Department",)
JUNK_TITLES = {"London Police Service": ("positions", "recruiting events", "caught on camera", "general releases", "london police service", "news post - no banner (1)")}

#: What is put out of a text before its locality is judged: a company named like a place.
LOCALITY_SCRUB = (r"\blondon\s+bridge\b", "child care provider")

#: Words that don't make a name on their own, beside the stopwords.
GENERIC_NAME_WORDS = ("service", "section", "major", "crime", "canada", "canadian", "press", "public", "safety", "const", "officer")

ACRONYMS = ("CBC", "CTV", "LPS", "OPP", "RCMP", "SIU", "EMS", "LHSC", "MLHU", "TVDSB", "LDCSB", "NHL", "OHL", "CFL", "NBA", "MLB", "COVID", "DNA", "CEO", "CFO", "MPP", "MP", "CA", "USA")
PROPER_WORDS = (
    "London", "Ontario", "Canada", "Thames", "Western", "Fanshawe", "Middlesex", "Sarnia", "Strathroy",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)

#: Decides before the other rules.
SPORTS_TERMS = (
    "western mustangs", "mustangs quarterback", "quarterback", "running back", "wide receiver", "football", "hockey", "basketball",
    "baseball", "soccer", "london knights", "london majors", "ohl", "oua", "playoffs", "training camp",
)

CATEGORY_RULES = (
    ("Public Safety", ("police", "arrest", "charged", "shooting", "collision", "fire", "fraud", "missing", "court", "crime")),
    ("City Hall", ("council", "mayor", "city hall", "municipal", "zoning", "budget", "ward", "election", "city of london")),
    ("Traffic", ("road", "closure", "traffic", "transit", "construction", "highway", "street", "lane")),
    ("Business", ("business", "jobs", "employer", "economy", "development", "retail", "housing", "market")),
    ("Education", ("western", "fanshawe", "school", "student", "university", "college", "tvdsb", "ldcsb")),
    ("Health", ("hospital", "health", "lhsc", "outbreak", "doctor", "nurse", "clinic")),
    ("Sports", ("knights", "sports", "hockey", "soccer", "baseball", "basketball", "football", "game")),
    ("Community", ("festival", "community", "event", "arts", "music", "theatre", "restaurant", "park", "recreation")),
)

MODULE_HEADINGS = (
    ("inline_related_content", r"^(?:read more|more from(?: local news)?|related(?: stories| coverage)?|recommended(?: for you)?|you may also like|most read|trending(?: now)?|top stories)$"),
    ("publisher_furniture", r"^(?:sponsored content|report an error|journalistic standards|stick to the facts|comments?)$"),
    ("video_module", r"^(?:watch(?: more)?|previous video|next video|recommended video)$"),
)

TAIL_FURNITURE = (
    ("publisher_furniture", r"\b(?:sponsored content|report an error|journalistic standards|add .{0,40} as a preferred source on google|stick to the facts)\b"),
    ("newsletter_leak", r"\b(?:sign up for (?:our|the)|get daily .{0,35} news|newsletter signup|subscribe to (?:our|the) newsletter)\b"),
    ("inline_related_content", r"\bmore from local news\b"),
)

#: Short labels that are no prose, and how modules begin.
BOILERPLATE_LABELS = ("sign in", "log in", "create an account", "subscribe", "subscribe now", "register", "comment", "comments", "share", "advertisement", "recommended", "most popular", "latest news")
BOILERPLATE_PREFIXES = ("newsletter", "recommended from editorial", "top stories", "read next", "more on this topic", "you might also like", "related content", "most read", "trending now")

#: What furniture says, anywhere in a text: every publisher's, and those of the publishers whose names hold a word.
BOILERPLATE_PHRASES = (
    "sign up for", "subscribe to", "sign in to continue", "create an account to continue", "sign in or create an account", "already a subscriber",
    "manage your subscription", "subscribe now to read", "subscribe to continue reading", "register to continue reading", "thanks for signing up",
    "join the conversation in the comments", "share this article", "get email updates from your favourite authors",
    "get email updates from your favorite authors", "this advertisement has not loaded yet", "advertisement has not loaded yet",
    "story continues below", "continue reading", "download our app", "follow us on", "recommended video", "related stories", "related story", "more from",
    "you may also like", "read more from", "all rights reserved", "back to news search subscribe", "back to news search", "trending stories", "trending now",
    "most popular", "top stories", "watch more", "sponsored content",
)
PUBLISHER_PHRASES = (
    ("free press", (
        "london free press epaper", "electronic replica of the print edition", "daily puzzles, including the new york times crossword",
        "daily puzzles including the new york times crossword", "support local journalism",
        "create an account or sign in to continue with your reading experience", "access articles from across canada with one account",
        "share your thoughts and join the conversation in the comments", "enjoy additional articles per month",
        "get email updates from your favourite authors", "get email updates from your favorite authors", "sign in or create an account",
        "unlock more articles", "manage print subscription", "trending", "most read", "exclusive articles from", "noon news roundup newsletter", "lfp weekender newsletter",
    )),
    ("global news", (
        "if you get global news from instagram or facebook", "find out how you can still connect with us", "hide message bar", "leave a comment share this item",
        "share this item on facebook", "share this item via whatsapp", "send this page to someone via email", "see more sharing options",
        "decrease article font size", "descrease article font size", "increase article font size", "get daily national news",
        "get daily canada news delivered to your inbox", "get daily national news delivered to your inbox",
        "add global news as a preferred source on google", "previous video", "next video", "click to play video", "recommended video",
    )),
    ("ctv", (
        "ctv news app", "download the ctv news app", "contact us", "newsletters", "sign up for our newsletters", "more from ctv news", "related stories",
        "recommended for you", "watch more", "latest videos", "advertisement", "bell media", "privacy policy", "terms and conditions", "team",
    )),
)

#: Interface texts of publishers: exact, by their beginning, anywhere; and what ends an article.
UTILITY_EXACT = (
    "advertisement", "advertising", "sponsored content", "promoted", "share", "share this story", "share this article", "share close",
    "newsletter", "newsletters", "sign up", "subscribe", "follow us", "recommended video", "previous video", "next video",
    "hide message bar", "stick to the facts",
)
UTILITY_PREFIXES = (
    "story continues below advertisement", "if you get global news from instagram or facebook", "find out how you can still connect with us",
    "leave a comment", "share this item on", "send this page to someone via email", "see more sharing options", "copy article link",
    "get daily ", "get breaking ", "get the latest ", "sign up for ", "subscribe to ", "download our app", "download the app", "get the app",
    "follow us on ", "add global news as a preferred source on google", "add global news as a preferred source",
    "add as a preferred source on google", "add citynews as a preferred source on google", "add ctv news as a preferred source on google",
    "by providing your email address", "read more:", "read more :",
)
UTILITY_CONTAINS = (
    "delivered to your inbox", "preferred source on google", "join the conversation in the comments", "share this item via whatsapp",
    "share this item on facebook", "send this page to someone via email", "see more sharing options", "this advertisement has not loaded yet",
)
TERMINAL_PREFIXES = (
    "keep reading", "more from ", "more stories", "related stories", "related coverage", "recommended for you", "you may also like",
    "most read", "most popular", "trending now", "top stories",
)
#: What ends an article after some prose, compared as keys.
CLOSING_KEYS = ("report an editorial error", "report a technical issue", "follow related authors and topics", "interact with the globe", "editorial code of conduct", "comments")

AUTHOR_STOPWORDS = ("by", "cbc", "ctv", "global", "news", "reporter", "journalist", "staff", "senior", "producer", "editor", "correspondent", "writer", "digital", "video", "photo", "photos")
AUTHOR_URL_MARKERS = ("/author/", "/authors/", "/staff/", "author-", "byline", "headshot", "avatar", "profile-photo", "profile_image", "profile-image", "staff-photo")
AUTHOR_TEXT = r"\b(?:author|byline|columnist|correspondent|headshot|journalist|reporter|staff portrait|staff photo|profile photo|profile image)\b"
PROMO_URL_MARKERS = ("preferred-source", "preferred_source", "google-preferred", "newsletter", "signup", "subscribe")
ADVERT_URL_MARKERS = ("/advert/", "/advertisement/", "/sponsored/", "doubleclick.net", "adservice")

#: Selectors of an article's root in order, and words that name an element a module.
GENERIC_ROOTS = ("[itemprop='articleBody']", "article .article-body", "article .article-content", "article .story-body", "article .entry-content", "article .post-content", "article", "main .article-body", "main .story-body", "main")
MODULE_ATTRIBUTES = (
    "advert", "advertisement", "advertising", "ad slot", "ad unit", "ad container", "sponsor", "sponsored", "promo", "promoted", "promotion",
    "related", "related stories", "recommend", "recommended", "recommendation", "recirc", "recirculation", "read more", "more stories", "more news", "more from",
    "trending", "most read", "most popular", "top stories", "outbrain", "taboola", "newsletter", "subscribe", "subscription", "sign up", "signup",
    "social share", "share tools", "sharing", "comments", "comment module", "follow author", "author follow", "feedback", "error report", "paywall", "registration",
)

SEVERITY_WEIGHT = {"critical": 35, "warning": 12, "info": 3}

#: (greatest age in hours, score)
FRESHNESS = ((1, 100), (3, 92), (6, 84), (12, 72), (24, 58), (36, 44), (48, 30), (72, 14))
#: Score by number of sources, the last one for more.
COVERAGE = (20, 52, 76, 90, 100)

# End of the fixed values. ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    stopwords: tuple[str, ...] = STOPWORDS
    local_terms: tuple = LOCAL_TERMS
    negative_terms: tuple = NEGATIVE_TERMS
    category_rules: tuple = CATEGORY_RULES
    module_headings: tuple = MODULE_HEADINGS
    tail_furniture: tuple = TAIL_FURNITURE
    severity_weight: dict = field(default_factory=lambda: dict(SEVERITY_WEIGHT))
    freshness: tuple = FRESHNESS
    coverage: tuple = COVERAGE
    source_priors: dict = field(default_factory=lambda: dict(SOURCE_PRIORS))
    publishers: tuple[str, ...] = PUBLISHERS
    official_sources: tuple[str, ...] = OFFICIAL_SOURCES
    gate: dict = field(default_factory=lambda: dict(GATE))
    retired_sources: tuple[str, ...] = RETIRED_SOURCES
    junk_titles: dict = field(default_factory=lambda: dict(JUNK_TITLES))
    locality_scrub: tuple[str, str] = LOCALITY_SCRUB
    sports_terms: tuple[str, ...] = SPORTS_TERMS
    generic_name_words: tuple[str, ...] = GENERIC_NAME_WORDS
    acronyms: tuple[str, ...] = ACRONYMS
    proper_words: tuple[str, ...] = PROPER_WORDS
    boilerplate_labels: tuple[str, ...] = BOILERPLATE_LABELS
    boilerplate_prefixes: tuple[str, ...] = BOILERPLATE_PREFIXES
    boilerplate_phrases: tuple[str, ...] = BOILERPLATE_PHRASES
    publisher_phrases: tuple = PUBLISHER_PHRASES
    generic_roots: tuple[str, ...] = GENERIC_ROOTS
    module_attributes: tuple[str, ...] = MODULE_ATTRIBUTES
    utility_exact: tuple[str, ...] = UTILITY_EXACT
    utility_prefixes: tuple[str, ...] = UTILITY_PREFIXES
    utility_contains: tuple[str, ...] = UTILITY_CONTAINS
    terminal_prefixes: tuple[str, ...] = TERMINAL_PREFIXES
    closing_keys: tuple[str, ...] = CLOSING_KEYS
    author_stopwords: tuple[str, ...] = AUTHOR_STOPWORDS
    author_url_markers: tuple[str, ...] = AUTHOR_URL_MARKERS
    promo_url_markers: tuple[str, ...] = PROMO_URL_MARKERS
    advert_url_markers: tuple[str, ...] = ADVERT_URL_MARKERS
    zone: str = "America/Toronto"
    retention_days: int = 7
    cluster_hours: int = 36
    comparison_hours: int = 72
    top_min_local: int = 40
    top_max_age_hours: int = 36
    audit_sample: int = 10
    health_sample: int = 30

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


DEFAULT = Config()
