"""Keyword lists used for tagging and categorising.

Fixed values: these phrases, and their order, decide results, so they are kept
as plain text. Every function that uses one takes another in its place.
Phrases are compared as written with lower-cased text, by substring.
"""

# Features: label -> phrases.
FEATURES = {
    "high_end": ["best", "top", "premium", "flagship", "high-end", "expensive", "pro", "ultimate", "elite",
                 "luxury", "high quality", "professional"],
    "mid_range": ["mid-range", "mid range", "medium", "balanced", "good value", "reasonably priced",
                  "middle tier", "intermediate", "mainstream", "moderate", "average price"],
    "budget": ["budget", "cheap", "affordable", "inexpensive", "low cost", "entry level", "basic",
               "economical", "value", "bargain", "low price", "low-end"],
    "camera": ["camera", "photography", "pictures", "photos", "selfie", "video", "zoom", "lens", "megapixel",
               "portrait", "night mode", "ultra-wide", "telephoto", "image quality", "photographic",
               "recording"],
    "battery": ["battery", "long lasting", "battery life", "endurance", "all day", "charging", "fast charge",
                "power", "stamina", "capacity", "mAh", "wireless charging", "battery drain",
                "battery health"],
    "performance": ["fast", "performance", "speed", "gaming", "powerful", "processor", "cpu", "gpu", "chip",
                    "snapdragon", "exynos", "a15", "bionic", "benchmark", "responsive", "smooth",
                    "multitasking", "lag free"],
    "display": ["screen", "display", "amoled", "oled", "lcd", "big screen", "resolution", "refresh rate",
                "hdr", "bright", "color", "panel", "viewing", "retina", "super amoled", "dynamic amoled",
                "fluid", "120hz", "90hz"],
    "storage": ["storage", "space", "capacity", "gb", "tb", "memory", "expandable", "microsd",
                "cloud storage", "internal storage", "data", "fill up", "store"],
    "design": ["design", "build quality", "premium feel", "materials", "glass", "metal", "plastic", "weight",
               "lightweight", "compact", "slim", "thin", "ergonomic", "comfortable", "look", "aesthetic"],
    "software": ["software", "android", "ios", "oneui", "miui", "os", "operating system", "interface", "ui",
                 "updates", "features", "clean", "stock", "customization", "theme"],
    "durability": ["durability", "rugged", "tough", "waterproof", "water resistant", "ip68", "ip67", "drop",
                   "scratch resistant", "gorilla glass", "ceramic shield", "robust", "solid"],
    "connectivity": ["5g", "wifi", "bluetooth", "nfc", "usb", "type-c", "port", "headphone jack",
                     "connection", "cellular", "network", "wireless", "hotspot"],
    "audio": ["sound", "audio", "speaker", "stereo", "dolby", "headphone", "earphone", "music", "loud",
              "quality", "bass", "spatial audio", "surround sound"],
}

# The three labels of FEATURES that name a price tier, in list order.
TIERS = ["high_end", "mid_range", "budget"]

# Specification kinds asked for in a question.
SPEC_REQUESTS = {
    "battery": ["battery", "battery capacity", "battery life", "charge", "charging"],
    "camera": ["camera", "megapixel", "mp", "photo", "selfie", "front camera", "rear camera"],
    "display": ["display", "screen", "resolution", "refresh rate", "hz", "amoled", "lcd", "oled"],
    "processor": ["processor", "cpu", "chipset", "snapdragon", "exynos", "mediatek", "tensor"],
    "memory": ["memory", "ram", "storage", "gb", "tb"],
    "dimensions": ["dimensions", "size", "width", "height", "weight"],
    "os": ["os", "android", "ios", "operating system", "software"],
    "price": ["price", "cost", "value", "dollars", "expensive", "cheap"],
}

# Where each specification kind is looked up in a specification document.
SPEC_PATHS = {
    "battery": ["battery", "Battery", "battery_type", "battery life", "charging"],
    "camera": ["main_camera", "selfie_camera", "Main Camera", "Selfie camera"],
    "display": ["display", "Display", "display_type", "resolution"],
    "processor": ["platform", "Platform", "cpu", "chipset", "gpu"],
    "memory": ["memory", "Memory", "internal", "ram"],
    "dimensions": ["dimensions", "body", "Body", "weight"],
    "os": ["os", "platform", "Platform"],
    "price": ["price", "price_info", "Misc"],
}

# Specification kinds compared when a question names none.
DEFAULT_COMPARISON = ["processor", "camera", "display", "battery", "memory"]

# Feature -> specification kinds shown for it.
FEATURE_SPECS = {
    "camera": ["camera", "main_camera", "selfie_camera"],
    "battery": ["battery", "battery_life", "charging"],
    "performance": ["processor", "cpu", "chipset", "platform"],
    "display": ["display", "screen"],
}

RECOMMENDATION = [
    "recommend", "recommendation", "suggested", "suggest", "suggestions", "best", "top", "great",
    "excellent", "outstanding", "superior", "preferred", "ideal", "perfect", "suitable", "good", "better",
    "greatest", "finest", "premier", "leading", "exceptional", "recommended", "popular", "worth",
    "worthwhile", "valuable", "quality", "impressive", "admirable", "advise", "guidance", "options",
    "choices", "alternatives", "selection", "pick", "choose", "what should i get", "which one",
    "which phone", "which device", "looking for", "need a new", "want to buy", "considering",
    "thinking about", "planning to get",
]

COMPARISON = [
    "compare", "comparison", "versus", "vs", "or", "difference", "differences", "better", "worse",
    "which is better", "prefer", "against", "match up", "side by side", "contrast", "comparable",
    "alternative to", "compete", "face off", "showdown", "battle", "comparison between", "compared to",
]

SPECIFICATION = [
    "specs", "specifications", "details", "features", "characteristics", "parameters", "capabilities",
    "technical details", "components", "hardware", "configuration", "profile", "description",
    "particulars", "attributes",
]

DEVICE_TYPES = [
    "phone", "smartphone", "mobile", "cellphone", "tablet", "ipad", "phablet", "folding phone",
    "flip phone", "foldable", "portable device",
]

# Names looked for when a question may be about one brand.
BRAND_NAMES = [
    "samsung", "apple", "iphone", "google", "pixel", "xiaomi", "huawei", "oneplus", "oppo", "vivo",
    "realme", "sony", "motorola", "nokia", "lg", "htc", "honor", "asus", "lenovo", "poco", "redmi",
    "nothing", "blackberry",
]

# Brands put first in recommendations.
POPULAR_BRANDS = ["Samsung", "Apple", "Google", "Xiaomi", "OnePlus", "Huawei"]

# Small-talk intents of the intent score.
SIMPLE_INTENTS = {
    "greeting": ["hi", "hello", "hey", "greetings"],
    "farewell": ["bye", "goodbye", "see you"],
    "thanks": ["thank you", "thanks"],
    "help": ["help", "assist", "how to use"],
}

# Small-talk categories of the category cascade.
SIMPLE_CATEGORIES = {
    "greeting": ["hi", "hello", "hey", "greetings", "good morning", "good afternoon", "good evening"],
    "farewell": ["bye", "goodbye", "see you", "talk to you later"],
    "thanks": ["thank you", "thanks", "appreciate it"],
    "identity": ["who are you", "what are you", "your name", "about you"],
    "help": ["help", "assist", "guidance", "how to use", "what can you do", "capabilities"],
}

# Categories of a conversation, first match wins. An assistant's own name is
# added to "identity" by the functions that take an ``assistant_name``.
CONVERSATION = {
    "greeting": ["hi", "hello", "hey", "greetings", "good morning", "good afternoon", "good evening", "howdy"],
    "farewell": ["bye", "goodbye", "see you", "talk to you later", "until next time", "farewell"],
    "thanks": ["thank you", "thanks", "appreciate it", "grateful", "thank you very much"],
    "affirmation": ["yes", "yeah", "sure", "absolutely", "definitely", "correct", "right"],
    "negation": ["no", "nope", "not really", "negative", "disagree", "incorrect"],
    "question": ["what", "why", "how", "when", "where", "who", "which", "whose", "whom", "?"],
    "confusion": ["confused", "don't understand", "unclear", "what do you mean", "explain"],
    "frustration": ["frustrated", "annoying", "irritating", "not working", "problem", "issue", "error"],
    "praise": ["good job", "well done", "excellent", "amazing", "awesome", "great", "fantastic"],
    "criticism": ["bad", "terrible", "awful", "poor", "disappointing", "useless", "not helpful"],
    "identity": ["who are you", "what are you", "what is your name", "your name", "about you",
                 "tell me about you", "who created you", "what can you do", "your purpose",
                 "what do you do"],
}

QUERY_TYPES = {
    "what": ["what is", "what are", "what does", "what can", "what will", "what should"],
    "how": ["how to", "how do", "how does", "how can", "how will", "how much", "how many"],
    "why": ["why is", "why are", "why does", "why do", "why can't", "why would"],
    "when": ["when will", "when is", "when can", "when does", "when should"],
    "where": ["where is", "where can", "where will", "where to", "where should"],
    "which": ["which is", "which are", "which one", "which device", "which phone"],
    "can": ["can you", "can it", "can the", "can this", "can I"],
}

SENTIMENT = {
    "positive": ["good", "great", "excellent", "amazing", "awesome", "fantastic", "wonderful", "best",
                 "perfect", "love", "like", "enjoy"],
    "negative": ["bad", "terrible", "awful", "poor", "worst", "dislike", "hate", "horrible",
                 "disappointing", "disappointed", "issue", "problem"],
    "neutral": ["okay", "fine", "average", "mediocre", "decent", "acceptable", "fair", "sufficient",
                "adequate", "passable"],
}

USAGE_PATTERNS = {
    "frequent_traveler": ["travel", "traveling", "traveller", "trip", "journey", "flight", "flying",
                          "commute", "commuting", "international", "roaming", "abroad"],
    "heavy_social_media": ["social media", "instagram", "tiktok", "facebook", "snapchat", "twitter",
                           "youtube", "influencer", "content creator", "streaming", "posting"],
    "outdoor_enthusiast": ["outdoor", "hiking", "camping", "adventure", "rugged", "durable", "sports",
                           "active", "extreme", "waterproof", "mountain", "beach"],
    "elderly_user": ["elderly", "senior", "older", "easy to use", "simple", "accessible", "large text",
                     "hearing aid", "accessibility", "basic", "beginner"],
    "music_lover": ["music", "audiophile", "headphones", "earbuds", "sound quality", "speaker", "audio",
                    "hi-res", "hi-fi", "bass", "streaming music", "spotify", "dac"],
    "privacy_focused": ["privacy", "secure", "security", "encrypted", "protection", "tracking",
                        "data collection", "anonymity", "confidential", "sensitive"],
    "multitasker": ["multitask", "productivity", "work", "efficient", "multiple apps", "split screen",
                    "dual screen", "notes", "calendar", "email", "busy"],
    "minimalist": ["minimal", "minimalist", "simple", "clean", "distraction-free", "focus", "essential",
                   "basic", "digital wellbeing", "screentime"],
    "parent": ["parent", "kids", "family", "child", "children", "parental controls", "monitoring",
               "restrictions", "safe", "family sharing", "location tracking"],
    "student": ["student", "school", "college", "university", "education", "study", "notes", "textbooks",
                "research", "assignment", "affordable", "budget"],
}

TECHNICAL_TOPICS = {
    "processor": ["processor", "cpu", "chipset", "soc", "snapdragon", "exynos", "dimensity", "bionic", "chip",
                  "cores", "clock speed", "nanometer", "performance"],
    "screen_technology": ["screen technology", "display type", "panel", "amoled", "oled", "lcd", "ips", "ltpo",
                          "refresh rate", "response time", "hdr", "nits", "brightness"],
    "charging_tech": ["charging technology", "fast charging", "quick charge", "supervooc", "supercharge",
                      "power delivery", "wireless charging", "reverse charging", "battery tech"],
    "camera_sensor": ["camera sensor", "sensor size", "sony sensor", "samsung sensor", "pixel size", "microns",
                      "image sensor", "aperture", "ois", "sensor shift"],
    "water_resistance": ["water resistance", "ip rating", "ip68", "ip67", "waterproof", "water protected",
                         "dust resistance", "submersion", "water damage"],
    "os_updates": ["os updates", "software updates", "android version", "ios version", "security patches",
                   "update policy", "support lifecycle", "end of support"],
    "connectivity": ["connectivity", "5g", "lte", "4g", "wifi", "bluetooth", "nfc", "ultra wideband", "uwb",
                     "modem", "satellite", "band support", "mimo"],
    "biometrics": ["biometrics", "fingerprint", "face recognition", "face id", "iris scanner",
                   "under display", "security", "authentication", "unlock"],
}

TROUBLESHOOTING = {
    "battery_drain": ["battery drain", "battery life", "dies quickly", "losing battery", "not lasting",
                      "discharge", "battery health", "power consumption", "draining fast"],
    "slow_performance": ["slow", "lag", "sluggish", "freezing", "hanging", "unresponsive",
                         "performance issues", "stuttering", "not smooth", "taking long time"],
    "overheating": ["overheating", "hot", "temperature", "warm", "thermal", "heat up", "burning",
                    "feels hot", "cooling", "overheat"],
    "connectivity_issues": ["connectivity issue", "wifi problem", "bluetooth problem", "not connecting",
                            "dropping connection", "signal", "weak connection", "no internet",
                            "disconnecting"],
    "screen_issues": ["screen problem", "display issue", "touch not working", "ghost touch", "dead pixel",
                      "screen flickering", "green tint", "burn-in", "display damage"],
    "storage_full": ["storage full", "no space", "memory full", "can't install", "insufficient storage",
                     "running out of space", "delete files", "free space", "low storage"],
    "app_crashes": ["app crashing", "force close", "not responding", "keeps closing", "app problem",
                    "application error", "stopped working", "crashes", "restarts"],
    "charging_problems": ["not charging", "slow charging", "charging issue", "won't charge",
                          "stops charging", "charging port", "cable problem", "power issue"],
}
