"""Lexicons and patterns of the transcript operators, in the order that rules depend on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cache
from itertools import product
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these words, numbers and patterns and on their order.

NUMERALS = {
    "शून्य": 0, "एक": 1, "दो": 2, "तीन": 3, "चार": 4,
    "पाँच": 5, "पांच": 5, "छः": 6, "छह": 6, "सात": 7,
    "आठ": 8, "नो": 9, "नौ": 9, "दस": 10, "ग्यारह": 11,
    "बारह": 12, "तेरह": 13, "चौदह": 14, "पंद्रह": 15, "सोलह": 16,
    "सत्रह": 17, "अठारह": 18, "उन्नीस": 19, "बीस": 20, "इक्कीस": 21,
    "बाईस": 22, "तेईस": 23, "चौबीस": 24, "पच्चीस": 25, "छब्बीस": 26,
    "सत्ताईस": 27, "अट्ठाईस": 28, "उनतीस": 29, "तीस": 30, "इकतीस": 31,
    "बत्तीस": 32, "तैंतीस": 33, "चौंतीस": 34, "पैंतीस": 35, "छत्तीस": 36,
    "सैंतीस": 37, "अड़तीस": 38, "उनतालीस": 39, "चालीस": 40, "इकतालीस": 41,
    "बयालीस": 42, "तैंतालीस": 43, "चौवालीस": 44, "पैंतालीस": 45, "छियालीस": 46,
    "सैंतालीस": 47, "अड़तालीस": 48, "उनचास": 49, "पचास": 50, "इक्यावन": 51,
    "बावन": 52, "तिरपन": 53, "चौवन": 54, "पचपन": 55, "छप्पन": 56,
    "सत्तावन": 57, "अट्ठावन": 58, "उनसठ": 59, "साठ": 60, "इकसठ": 61,
    "बासठ": 62, "तिरसठ": 63, "चौंसठ": 64, "पैंसठ": 65, "छियासठ": 66,
    "सड़सठ": 67, "अड़सठ": 68, "उनहत्तर": 69, "सत्तर": 70, "इकहत्तर": 71,
    "बहत्तर": 72, "तिहत्तर": 73, "चौहत्तर": 74, "पचहत्तर": 75, "छिहत्तर": 76,
    "सतहत्तर": 77, "अठहत्तर": 78, "उन्यासी": 79, "अस्सी": 80, "इक्यासी": 81,
    "बयासी": 82, "तिरासी": 83, "चौरासी": 84, "पचासी": 85, "छियासी": 86,
    "सतासी": 87, "अट्ठासी": 88, "नवासी": 89, "नब्बे": 90, "इक्यानवे": 91,
    "बानवे": 92, "तिरानवे": 93, "चौरानवे": 94, "पंचानवे": 95, "छियानवे": 96,
    "सत्तानवे": 97, "अट्ठानवे": 98, "निन्यानवे": 99, "सौ": 100, "हज़ार": 1000,
    "हजार": 1000, "लाख": 100000, "करोड": 10000000, "करोड़": 10000000, "अरब": 1000000000,
}
POWERS = (100, 1_000, 100_000, 10_000_000, 1_000_000_000)

#: Number words that stand for something else than their value; any match near a word protects it.
IDIOMS = (
    r"दो[-\s]चार\s+(बातें|बात|लोग|दिन|मिनट)",
    r"चार[-\s]पांच\s+(बातें|लोग|दिन)",
    r"दो[-\s]दो\s+हाथ",
    r"एक[-\s]दो\s+(बार|दिन|लोग|बातें)",
    r"दो[-\s]टूक",
    r"तीन[-\s]तेरह",
    r"चार[-\s]चाँद",
    r"एक[-\s]एक",
    r"नौ[-\s]दो[-\s]ग्यारह",
    r"सात[-\s]पांच",
    r"दो[-\s]राय",
    r"एक[-\s]तरफ",
    r"एक[-\s]साथ",
    r"एक[-\s]दूसरे",
)

#: English words written in Devanagari; the first that a word starts with counts as its variant.
LOANWORDS = {
    "फोन": "phone", "मोबाइल": "mobile", "कंप्यूटर": "computer", "लैपटॉप": "laptop",
    "डेस्कटॉप": "desktop", "इंटरनेट": "internet", "ऑनलाइन": "online", "ऑफलाइन": "offline",
    "वेबसाइट": "website", "ऐप": "app", "सॉफ्टवेयर": "software", "वाईफाई": "wifi",
    "सोशल": "social", "मीडिया": "media", "यूट्यूब": "youtube", "गूगल": "google",
    "व्हाट्सएप": "whatsapp", "इंस्टाग्राम": "instagram", "फेसबुक": "facebook", "वीडियो": "video",
    "ऑडियो": "audio", "नेटवर्क": "network", "सर्वर": "server", "डेटा": "data",
    "स्कूल": "school", "कॉलेज": "college", "यूनिवर्सिटी": "university", "क्लास": "class",
    "टीचर": "teacher", "स्टूडेंट": "student", "एग्जाम": "exam", "टेस्ट": "test",
    "रिजल्ट": "result", "डिग्री": "degree", "कोर्स": "course", "सब्जेक्ट": "subject",
    "ट्यूशन": "tuition", "होमवर्क": "homework", "प्रोजेक्ट": "project", "जॉब": "job",
    "ऑफिस": "office", "कंपनी": "company", "बिजनेस": "business", "मीटिंग": "meeting",
    "इंटरव्यू": "interview", "सैलरी": "salary", "वर्क": "work", "बॉस": "boss",
    "मैनेजर": "manager", "स्टाफ": "staff", "टीम": "team", "टारगेट": "target",
    "प्रमोशन": "promotion", "रिज्यूमे": "resume", "टाइम": "time", "प्रॉब्लम": "problem",
    "सॉल्यूशन": "solution", "लाइफ": "life", "फैमिली": "family", "फ्रेंड": "friend",
    "फ्रेंड्स": "friends", "पार्टी": "party", "ग्रुप": "group", "लिस्ट": "list",
    "प्लान": "plan", "टॉपिक": "topic", "पॉइंट": "point", "रिलेशनशिप": "relationship",
    "एक्सपीरियंस": "experience", "एक्चुअली": "actually", "बेसिकली": "basically", "ऑब्वियसली": "obviously",
    "डेफिनेटली": "definitely", "सीरियसली": "seriously", "डाइट": "diet", "जिम": "gym",
    "फिटनेस": "fitness", "हेल्थ": "health", "हेल्दी": "healthy", "फैशन": "fashion",
    "शॉपिंग": "shopping", "ब्रांड": "brand", "स्टाइल": "style", "ट्रेंड": "trend",
    "लुक": "look", "कूल": "cool", "ट्रेन": "train", "बस": "bus",
    "टैक्सी": "taxi", "एयरपोर्ट": "airport", "फ्लाइट": "flight", "होटल": "hotel",
    "ट्रिप": "trip", "टूर": "tour", "टिकट": "ticket", "ड्राइवर": "driver",
    "पार्किंग": "parking", "रोड": "road", "फूड": "food", "रेस्टोरेंट": "restaurant",
    "मेनू": "menu", "कॉफी": "coffee", "पिज्जा": "pizza", "बर्गर": "burger",
    "चॉकलेट": "chocolate", "आइसक्रीम": "ice cream", "केक": "cake", "मूवी": "movie",
    "फिल्म": "film", "म्यूजिक": "music", "गेम": "game", "क्रिकेट": "cricket",
    "फुटबॉल": "football", "डांस": "dance", "डांसिंग": "dancing", "सॉन्ग": "song",
    "थैंक": "thank", "सॉरी": "sorry", "प्लीज": "please", "ओके": "okay",
    "हेलो": "hello", "बाय": "bye", "नंबर": "number", "टाइप": "type",
    "लेवल": "level", "सिंपल": "simple", "ईजी": "easy", "इजी": "easy",
    "लाइक": "like", "शेयर": "share", "फॉलो": "follow", "स्टार्ट": "start",
    "स्टॉप": "stop", "चेंज": "change", "फर्स्ट": "first", "लास्ट": "last",
    "नेक्स्ट": "next", "बेस्ट": "best", "वर्स्ट": "worst", "फुल": "full",
    "फ्री": "free", "सेफ": "safe", "रिस्क": "risk", "चांस": "chance",
    "लक": "luck", "सक्सेस": "success", "फैक्ट": "fact", "डिटेल": "detail",
    "बैलेंस": "balance", "फीडबैक": "feedback", "अपडेट": "update", "रिपोर्ट": "report",
    "नॉर्मल": "normal", "स्पेशल": "special", "फाइनल": "final", "कार": "car",
    "बाइक": "bike", "साइकिल": "cycle", "ट्रेडिशनल": "traditional", "मॉडर्न": "modern",
    "कल्चर": "culture", "गिफ्ट": "gift", "गिफ्टेड": "gifted", "लैंड": "land",
    "फोटो": "photo", "कैमरा": "camera", "सेल्फी": "selfie", "पैशन": "passion",
    "टैलेंट": "talent", "स्किल": "skill", "फ्यूचर": "future", "कैरियर": "career",
    "गोल": "goal", "बर्थडे": "birthday", "फेवरेट": "favourite", "सेम": "same",
    "डिफरेंट": "different", "ब्रेक": "break", "ट्रेनिंग": "training", "हार्ट": "heart",
    "प्योर": "pure", "फेस": "face", "बिहेव": "behave", "इंफॉर्मेशन": "information",
    "फ्लोर": "floor", "लिफ्ट": "lift", "स्ट्रगल": "struggle", "स्ट्रीट": "street",
    "लैंग्वेज": "language", "एरिया": "area", "माइंड": "mind", "सपोर्ट": "support",
    "हेल्प": "help", "क्लियर": "clear", "एक्सप्लोर": "explore", "सिम्पल": "simple",
    "पेमेंट": "payment", "ऑर्डर": "order", "डिलीवरी": "delivery", "रिव्यू": "review",
    "इंडिया": "India", "कॉल": "call",
}

SUFFIXES = tuple(
    """
    ियों ियां ियाँ ाइए ईए ओं वाला वाली वाले कार दार गार ता ती ते ना ने नी ें ों
    ूं ूँ ां ाँ ेगा ेगी ेंगे ेंगी ाओ ओ ईं पन ता आई आस ा ी े ो
    """.split()
)
PREFIXES = tuple("अन बे ना निर नि प्र अति अध परि सम सु कु दुर दुस अभि उप अधि".split())
NUKTA = "़"
NUKTA_BASES = ("ज", "फ", "क", "ख", "ग")
#: Impossible sequences of dependent signs.
BROKEN = (r"[ा-्]{3,}", r"््", r"[ा-ौ]ा")
#: Endings that English words take in Devanagari.
ENGLISH_ENDINGS = tuple("शन मेंट नेस टिव टिक इंग ली फुल लेस एबल ेशन र्स ट्स न्स क्स िटी ेंस ेंट ैंड".split())
DIALECT_ENDINGS = ("िये", "ियो", "एंगे", "ाओ")

# End of the fixed values.

IDIOM = "|".join(IDIOMS)

#: Stems of the core vocabulary by paradigm, with the endings that each takes. The vocabulary is a parameter
#: of the classifier; this default is made by rule, so that it covers inflected forms that no list would.
PARADIGMS: tuple[tuple[str, str], ...] = (
    (  # pronouns in the oblique case
        "मुझ तुझ हम तुम आप इस उस इन उन जिस किस जिन किन सब खुद",
        "- को से में पर का की के ने",
    ),
    (  # verbs whose stem ends in a consonant
        "कर चल बोल देख सुन पढ़ लिख मिल बन रह कह समझ सोच रख निकल पहुंच खेल पूछ उठ बैठ बढ़ बदल सीख मान जान लग मार काट बेच खरीद भेज पकड़ छोड़ जोड़ तोड़ खोल रुक भूल",
        "- ना ने नी ता ती ते ा ी े ो कर के ेगा ेगी ेंगे ूंगा ूंगी ें",
    ),
    (  # verbs whose stem ends in a long vowel
        "जा खा ला पा गा आ बता बना दिखा सुना चला उठा लगा समझा बुला",
        "- ना ने नी ता ती ते या ए ई ओ कर के एगा एगी एंगे ऊंगा ऊंगी",
    ),
    (  # adjectives and possessives that agree
        "अच्छ बड़ छोट पुरान लंब ऊंच नीच सीध थोड़ पूर आध दूसर पहल अपन मेर तेर हमार तुम्हार कितन इतन उतन जितन कैस ऐस वैस जैस सस्त महंग ठंड मीठ काल",
        "ा ी े",
    ),
    (  # masculine nouns in a long vowel
        "बच्च लड़क रास्त पैस घंट महीन कमर सपन मौक तरीक हिस्स फायद",
        "ा े ों",
    ),
    (  # feminine nouns in a long vowel
        "लड़क नौकर कहान रोट गाड़ खिड़क परेशान",
        "ी ियां ियों",
    ),
    (  # other nouns
        "दिन लोग साल घर काम देश गांव शहर दोस्त बात किताब रात चीज जगह आवाज बार नाम हाथ स्कूल कंप्यूटर बिजनेस स्कॉलरशिप जंगल समय पानी भाई मां",
        "- ें ों",
    ),
    (  # words that do not change
        "मैं तू वह वो यह ये वे हूं हूँ है हैं था थी थे हो हुआ हुई हुए होना होता होती होते होगा होगी गया गई गए "
        "और या लेकिन मगर कि जो जब तब अब कब क्यों क्या कौन कोई कुछ नहीं न मत हां हाँ जी भी ही तो तक बहुत ज्यादा कम फिर अगर क्योंकि इसलिए "
        "यहां वहां कहां जहां आज कल अभी कभी हमेशा शायद बिल्कुल सिर्फ साथ बाद पहले ऊपर नीचे अंदर बाहर बीच पास दूर लिए द्वारा हम्म अच्छे पढ़ाई",
        "-",
    ),
)


@cache
def vocabulary(path: str | None = None) -> tuple[str, ...]:
    """The core vocabulary, sorted: the words of a text file, one on a line, or those of PARADIGMS."""
    if path is not None:
        return tuple(sorted({w for line in Path(path).read_text(encoding="utf-8").splitlines() if (w := line.strip())}))
    return tuple(sorted({stem + ending.strip("-") for stems, endings in PARADIGMS for stem, ending in product(stems.split(), endings.split())}))


def numerals() -> dict[str, int]:
    return NUMERALS


def loanwords() -> dict[str, str]:
    return LOANWORDS


def affixes(kind: str) -> tuple[str, ...]:
    return {"suffix": SUFFIXES, "prefix": PREFIXES}[kind]


def quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def among(value: Column, words: Iterable[str]) -> Column:
    """Whether a value is one of the words, which Spark hashes; the whole set is parsed in one call."""
    words = sorted(set(words))
    return F.call_function("exists", F.array(value), F.expr(f"w -> w in ({', '.join(map(quoted, words))})")) if words else F.lit(False)


def mapping(values: Mapping[str, str | int]) -> Column:
    """A map literal, parsed in one call."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v) if isinstance(v, str) else v}" for k, v in values.items()) + ")")


def resource(path: str) -> tuple[tuple[str, str | None], ...]:
    """Ordered ``(key, value)`` entries of a text file with ``ord<TAB>key[<TAB>value]`` on a line, by ord; a key counts once.

    For loanwords (``dict(resource(path))``), affixes and vocabularies (the keys); ``ord`` decides ties.
    """
    rows = [line.split("\t") for line in Path(path).read_text(encoding="utf-8").splitlines() if line.strip()]
    out: dict[str, str | None] = {}
    for row in sorted(rows, key=lambda r: int(r[0])):
        out.setdefault(row[1], row[2] if len(row) > 2 else None)
    return tuple(out.items())
