"""Lists, patterns and limits whose exact content and order decide the results."""

# Canonical labels with the aliases accepted for each, in order.
LABEL_ALIASES = {
    "urgent": ["urgent", "1: urgent"],
    "action_needed": ["action needed", "action_needed", "2: action needed"],
    "follow_up": ["follow up", "follow_up", "3: follow up"],
    "awaiting_reply": ["awaiting reply", "awaiting_reply", "4: awaiting reply"],
    "meeting": ["meeting", "5: meeting"],
    "fyi": ["fyi", "6: fyi"],
    "done": ["done", "7: done"],
    "payment": ["payment", "8: payment"],
    "newsletter": ["newsletter", "9: newsletter"],
    "marketing": ["marketing", "10: marketing"],
    "misc": ["misc"],
}
LABELS = list(LABEL_ALIASES)

# Mailbox folder shown for each canonical label.
MAILBOX_LABELS = {
    "urgent": "1: urgent",
    "action_needed": "2: action needed",
    "follow_up": "3: follow up",
    "awaiting_reply": "4: awaiting reply",
    "meeting": "5: meeting",
    "fyi": "6: fyi",
    "done": "7: done",
    "payment": "8: payment",
    "newsletter": "9: newsletter",
    "marketing": "10: marketing",
    "misc": "misc",
}

# Quoted-reply markers, tried in this order.
QUOTE_MARKERS = [
    r"\nOn .+ wrote:\s*$",
    r"\nFrom:\s.+\nSent:\s.+\nTo:\s.+",
    r"\n-{2,}\s*Original Message\s*-{2,}",
    r"\n_{5,}",
]

# Signature markers, tried in this order; a hit counts only past this position.
SIGNATURE_MARKERS = [
    r"\n--\s*$",
    r"\nRegards,?\s*$",
    r"\nThanks,?\s*$",
    r"\nBest,?\s*$",
]
SIGNATURE_MIN_START = 80

# Similarity masks, applied in this order, ignoring case.
SIMILARITY_MASKS = [
    (r"https?://\S+", " URL "),
    (r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", " EMAIL "),
    (r"\b[a-z]{1,10}-\d+\b", " ISSUE "),
    (r"\b#[0-9]+\b", " NUM "),
    (r"\b\d{1,2}[:/.-]\d{1,2}([:/.-]\d{2,4})?\b", " DATE "),
    (r"\b\d{4,}\b", " NUM "),
    (r"\b\d+([,.]\d+)?\b", " NUM "),
    (r"\b(rs|inr|usd|eur|gbp)\s*\.?\s*num\b", " MONEY "),
    (r"\b[a-f0-9]{8,}\b", " ID "),
]
SIMILARITY_TOKEN = r"[a-z0-9_+#.-]+"
COLLAPSED_TOKENS = ["num", "date", "url", "email", "id"]
SHINGLE_WIDTH = 3
TEMPLATE_SUBJECT_CHARS = 160
TEMPLATE_PREFIX_TOKENS = 60
HAMMING_THRESHOLD = 6
SIMHASH_BANDS = 4
EMPTY_TEXT_RANK = 999999

# Keyword rules, first label with a contained phrase wins.
KEYWORD_RULES = [
    ("urgent", ["urgent", "asap", "immediately", "critical", "production issue", "blocked"]),
    ("follow_up", ["follow up", "following up", "gentle reminder", "checking in"]),
    ("awaiting_reply", ["awaiting your reply", "waiting for your response", "waiting for your confirmation"]),
    ("fyi", ["fyi", "for your information", "no action needed"]),
    ("action_needed", [
        "action required", "please approve", "need your approval", "needs your approval",
        "please review", "please send", "let me know", "are you free", "free for a quick",
        "free for quick",
    ]),
    ("meeting", ["calendar invite", "meeting invitation", "meeting", "google meet", "zoom", "agenda",
                 "rescheduled"]),
    ("payment", ["invoice", "payment", "receipt", "paid", "refund", "transaction", "amount credited", "utr"]),
    ("newsletter", ["newsletter", "unsubscribe", "digest"]),
    ("marketing", ["limited time", "offer", "discount", "promotion", "sale", "upgrade today"]),
    ("done", ["completed", "resolved", "done", "fixed", "closing this out"]),
]
RULE_CONFIDENCE = 0.99

# Address pattern, and the words that mark an automated local part, in order.
ADDRESS = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
AUTOMATED_LOCAL_WORDS = [
    "no-reply", "noreply", "do-not-reply", "donotreply", "notification", "notifications", "notify",
    "mailer", "mailer-daemon", "postmaster", "automated", "automation", "bot", "alerts", "alert",
    "updates", "digest", "newsletter", "support", "team", "hello", "info", "admin", "system",
    "billing", "invoice", "receipts", "receipt", "security", "calendar", "reminder", "news",
    "marketing",
]

# Markers of an automated display name, in order.
AUTOMATED_NAME_MARKERS = [
    "github", "gitlab", "bitbucket", "dependabot", "tl;dv", "tldv", "jira", "confluence", "slack",
    "calendar", "calendly", "notion", "linear", "figma", "zoom", "hubspot", "razorpay", "stripe",
    "sentry", "datadog", "cloudflare", "aws", "amazon web services", "google", "workspace", "drive",
    "docs", "sheets", "newsletter", "digest", "notification",
]

# Markers of an automated domain, in order.
AUTOMATED_DOMAIN_MARKERS = [
    "github", "tldv", "tl.dv", "slack", "atlassian", "jira", "linear", "notion", "calendly",
    "sendgrid", "mailgun", "amazonses", "mailchimp", "hubspot", "sentry", "figma", "vercel",
    "cloudflare", "postmark", "mandrill",
]
SENDER_SAMPLE_SUBJECTS = 3
SENDER_SAMPLE_CHARS = 140
TOP_DOMAINS = 50

# Draft gate.
DRAFT_LABELS = ["urgent", "action_needed", "follow_up"]
DRAFT_READY_LABEL = "AI/draft ready"
SYSTEM_MAIL_LABELS = ["DRAFT", "SENT", "TRASH", "SPAM"]
# The gate's local-part markers and domain markers, in the order they are documented.
DRAFT_LOCAL_MARKERS = ["no-reply", "noreply", "notification", "mailer", "bot", "alerts", "digest", "newsletter"]
DRAFT_DOMAIN_MARKERS = [
    "github", "tl.dv", "tldv", "slack", "jira", "atlassian", "linear", "notion", "calendly",
    "google.com", "sendgrid", "mailgun", "amazonses", "mailchimp",
]

# Labeller gate and training defaults.
MIN_CONFIDENCE = 0.85
VALID_RATIO = 0.15
SPLIT_SEED = 7
