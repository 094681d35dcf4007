"""Word lists of the article engine."""

from __future__ import annotations

# They must be these for equal results.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"
STOPWORDS = (
    "का", "की", "के", "को", "में", "से", "पर", "और", "है", "हैं", "हुआ", "हुई",
    "ने", "यह", "वह", "इस", "उस", "कि", "भी", "तक", "हो", "कर", "लिए", "साथ",
    "एक", "अब", "जो", "था", "थी", "थे", "गया", "गई", "गए", "रहा", "रही", "रहे",
    "होगा", "होगी", "होंगे", "सकता", "सकती", "वाले", "वाला", "वाली", "कोई",
    "क्या", "कैसे", "कहां", "क्यों", "जब", "तब", "यदि", "अगर", "लेकिन", "या",
    "बाद", "पहले", "दौरान", "बीच", "ओर", "अपनी", "अपने", "उन्होंने", "जाएगा",
)
GENERIC = (
    "रेल", "रेलवे", "ट्रेन", "ट्रेनें", "भारतीय", "भारत", "समाचार", "न्यूज",
    "खबर", "अपडेट", "जानिए", "देखें", "बड़ी", "नई", "नया", "आज", "करोड़", "लाख",
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her",
    "was", "one", "our", "out", "has", "from", "that", "this", "with", "will",
    "what", "how", "its", "than", "also", "been", "have", "more", "after",
    "into", "over", "says", "said", "amid", "among", "about", "being", "some",
    "when", "here", "news", "india", "indian", "railway", "railways", "train",
    "trains", "check", "report", "reports", "update", "latest", "today",
    "crore", "lakh", "million", "year", "quarter", "fiscal", "share", "shares",
    "stock", "price", "market", "company", "limited", "international",
    "corporation", "new", "set", "gets", "give", "take", "make", "know", "need",
)
SUFFIXES = ("ाओं", "ाएँ", "ाएं", "ियों", "ियाँ", "ियां", "ों", "ें", "ओं", "यों", "याँ", "ुओं", "ी", "ि", "े", "ा", "ो", "ु", "ू", "ं", "ें")
MATRAS = "ािीुूेैोौंँृ"
STRONG = ("रेलवे", "ट्रेन", "रेलगाड़ी", "आईआरसीटीसी", "वंदे भारत", "अमृत भारत", "रेल मंत्रालय", "रेलयात्री", "railway", "railways", "irctc", "vande bharat", "indian rail")
WEAK = ("रेल", "ट्रैक", "एक्सप्रेस", "स्टेशन", "लोको", "डिब्बे", "कोच", "यात्री", "प्लेटफॉर्म", "मालगाड़ी", "train", "rail", "coach", "platform")
IMPACT_HIGH = ("दुर्घटना", "टक्कर", "पटरी", "मौत", "मृतक", "घायल", "आगजनी", "रद्द", "रद्दीकरण", "हादसा", "accident", "derail", "collision", "death", "fatal", "injur", "cancelled", "cancellation", "emergency")
IMPACT_MEDIUM = ("नई ट्रेन", "परियोजना", "उद्घाटन", "विद्युतीकरण", "दोहरीकरण", "निर्माण", "विस्तार", "मंजूरी", "नई सुविधा", "new train", "project", "inaugurat", "electrification", "construction", "expansion", "approv", "launch", "upgrade")
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
