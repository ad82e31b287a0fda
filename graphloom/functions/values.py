"""Patterns, word lists and constants that results depend on. Patterns compile alike in Java and RE2."""

# --- fixed values: patterns -------------------------------------------------------------------------------------------
EXTERNAL_ID = r"(?i)\b(?:[GMSTC]A?\d{4}(?:\.\d{3})?|AN\d{4}|DET\d{4}|DC\d{4})\b"
MITRE_ID = r"(?i)\b[GMSTC]A?\d{4}(?:\.\d{3})?\b"
CVE_ID = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
ENTITY_REFERENCE = r"\b(?:[A-Z]{2,}\d+[A-Z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*|[A-Za-z]+\d+[A-Za-z0-9]*)\b"
THREAT_ACTOR = r"\b(APT\s*\d+|UNC\s*\d+|G\d{4}|(?:[A-Z][a-z]+\s+(?:Bear|Spider|Typhoon|Panda|Kitten|Blizzard|Tempest|Tiger|Dragon)))\b"
PLATFORM = r"(?i)\b(Windows|macOS|Linux|Containers|Kubernetes|IaaS|SaaS|Android|iOS|ESXi)\b"
LOW_SIGNAL = r"(?i)^\s*(?:hi|hello|hey|hi\s+there|hello\s+there|thanks|thank\s+you|thx|what\s+can\s+you\s+do\??|who\s+are\s+you\??)\s*[.!?]*\s*$"
CAMPAIGN_PHRASE = r"(?i)\b((?:\w+[\s-]+){0,3}\w+)\s+(?:campaign|campaigns|operation|operations)\b"
DESCRIPTOR = r"\b(?:is|are|was|were)\s+(?:an?|the)\s+([^.;:\n]{1,120})"
DESCRIPTOR_END = r"\b(?:that|which|used|uses|leveraged|designed|known|written|developed|created|observed|reported|associated|targeting|by|for|with|to|and|or)\b|,|\("
LINK = r"\[[^\]]+\]\([^)]+\)"
OFF_TOPIC = r"(?i)\b(?:recipe\s+for\s+(?:pasta|chicken|cake|lasagna|pizza|soup|cookies)|horoscope\s+today|dating\s+advice|relationship\s+problems|restaurant\s+near\s+me|best\s+places\s+to\s+eat|movie\s+recommendations?|what\s+to\s+watch\s+on\s+netflix|discount\s+codes?|coupon\s+for)\b"
JAILBREAK = r"(?i)(?:\b(?:ignore|1gn0r3)\s+(?:all\s+)?(?:rules|instructions|guidelines)\b|\bforget\s+(?:all\s+)?(?:rules|instructions)\b|\bj[a4][i1]lb[r]?[e3][a4]k\b|\bdan\s+mode\b|ignore[-\s]+all[-\s]+instructions|\bunjailbreak\b)"
#: Types asked for (in this order); the first list of search takes the singular technique too.
REQUESTED_TYPES = [
    ("Technique", r"(?i)\btechniques\b"),
    ("Actor", r"(?i)\bactors\b"),
    ("Malware", r"(?i)\bmalwares?\b"),
    ("Tool", r"(?i)\btools\b"),
    ("Mitigation", r"(?i)\bmitigations?\b"),
    ("Tactic", r"(?i)\btactics\b"),
    ("Campaign", r"(?i)\bcampaigns\b"),
    ("Analytic", r"(?i)\banalytics?\b"),
    ("DetectionStrategy", r"(?i)\bdetection\s+strateg(?:y|ies)\b"),
    ("DataComponent", r"(?i)\bdata\s+components?\b"),
]
REQUESTED_TYPES_IN_SEARCH = [("Technique", r"(?i)\btechniques?\b"), *REQUESTED_TYPES[1:]]
QUALIFIER_TYPES = [
    ("Technique", r"(?i)\btechnique\b"),
    ("Actor", r"(?i)\bactor\b"),
    ("Tool", r"(?i)\btool\b"),
    ("Tactic", r"(?i)\btactic\b"),
    ("Campaign", r"(?i)\bcampaign\b"),
]

# --- fixed values: word lists -----------------------------------------------------------------------------------------
STOPWORDS = [
    "show", "what", "which", "tell", "give", "list", "does", "did", "use", "uses", "used", "using", "for", "from",
    "with", "about", "the", "and", "or", "me", "all", "are", "is", "in", "on", "of", "to", "run", "runs", "ran",
    "tool", "tools", "malware", "actor", "actors", "campaign", "campaigns", "operation", "operations", "technique",
    "techniques", "tactic", "tactics", "access", "bear", "spider", "panda", "kitten", "typhoon", "blizzard",
    "tempest", "tiger", "dragon", "windows", "macos", "linux", "android", "ios", "esxi", "iaas", "saas", "containers",
    "kubernetes",
]
STRUCTURAL = [
    "tool", "tools", "malware", "actor", "actors", "campaign", "campaigns", "operation", "operations", "technique",
    "techniques", "tactic", "tactics", "platform", "platforms",
]
TACTICS = ["Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact"]
PLATFORM_TERMS = ["windows", "linux", "macos", "office suite", "saas", "iaas", "containers", "network devices", "esxi", "identity provider"]
COMPARISON_TERMS = ["compare", "comparison", "similar", "similarities", "different", "differences"]
NODE_TYPES = ["Technique", "Actor", "Malware", "Tool", "Mitigation", "Tactic", "Campaign", "Analytic", "DetectionStrategy", "DataComponent"]
NAMED_FIELDS = ["threat_actor", "malware", "tool", "campaign"]
ENTITY_FIELDS = ["threat_actor", "malware", "tool", "campaign", "tactic", "platform", "node_type", "analytic", "detection_strategy", "data_component"]
#: Where a value that its own field does not know is looked for, in this order.
FALLBACK_FIELDS = ["threat_actor", "malware", "tool", "campaign", "tactic", "mitre_id", "analytic", "detection_strategy", "data_component", "cve_id"]

# --- fixed values: numbers --------------------------------------------------------------------------------------------
RRF_K, TYPE_BONUS, EXPANSIONS = 60, 0.08, 4
DESCRIPTION_CHARS, FIELD_CHARS, COMPARED_ITEMS = 400, 1600, 5

# --- fixed values: messages -------------------------------------------------------------------------------------------
#: Of refusals and empty answers.
BLOCKED = {
    "clearly_offtopic": "I'm a cybersecurity assistant focused on threat intelligence and MITRE ATT&CK. I can't help with general topics.",
    "jailbreak": "This request has been blocked. I only assist with cybersecurity analysis.",
}
NO_ANSWER = "I don't have enough information about this in my knowledge base."
NO_CONTEXT = "No relevant context found."
COMPARISON_NOTE = "This comparison only uses explicit actor fields shown in the retrieved context."
#: (label, column) of a context block, and (label, columns, items) of a node card, in order.
CONTEXT_FIELDS = [("Tactics", "tactics"), ("Platforms", "platforms"), ("Techniques", "techniques"), ("Actors", "actors"), ("Malware", "malware"), ("Tools", "tools"), ("Campaigns", "campaigns"), ("Mitigations", "mitigations"), ("Detections", "detections"), ("Analytics", "analytics"), ("Log Sources", "log_sources"), ("Detection Strategies", "detection_strategies"), ("Subtechniques", "subtechniques"), ("Parent Technique", "parent_technique")]
CARD_FIELDS = [("Tactics", ["tactics"], 5), ("Platforms", ["platforms"], 5), ("Techniques", ["techniques", "subtechniques"], 5), ("Used by actors", ["actors", "threat_actors"], 5), ("Related malware", ["malware"], 5), ("Related tools", ["tools"], 5), ("Campaigns", ["campaigns"], 5), ("Mitigations", ["mitigations"], 3), ("Detections", ["detections", "detection_strategies"], 3), ("Data sources", ["log_sources"], 3)]
