"""The closed topic vocabulary and the words that give evidence of each topic."""

from __future__ import annotations

# They must be these for equal results.
TOPICS = {
    "Safety": ("सुरक्षा", "दुर्घटना", "टक्कर", "पटरी से उतर", "आग", "मौत", "घायल", "safety", "accident", "derail", "collision", "fire", "injur"),
    "Infrastructure": ("ट्रैक", "लाइन", "पुल", "विद्युतीकरण", "दोहरीकरण", "निर्माण", "परियोजना", "track", "bridge", "electrification", "doubling", "construction", "project"),
    "Passenger-Service": ("यात्री", "सुविधा", "आरक्षण", "टिकट", "कोच", "बर्थ", "passenger", "amenity", "reservation", "ticket", "berth"),
    "Operations": ("परिचालन", "समय", "मार्ग", "रद्द", "डायवर्ट", "ब्लॉक", "operation", "schedule", "route", "cancel", "divert", "block"),
    "Technology": ("तकनीक", "कवच", "सिग्नल", "स्वचालित", "डिजिटल", "ऐप", "technolog", "kavach", "signal", "automat", "digital", "app"),
    "Policy": ("नीति", "मंत्रालय", "मंजूरी", "बोर्ड", "नियम", "आदेश", "policy", "ministry", "approv", "board", "rule", "regulation"),
    "Finance": ("करोड़", "लाख", "राजस्व", "निवेश", "बजट", "आय", "जुर्माना", "crore", "lakh", "revenue", "investment", "budget", "fine"),
    "Environment": ("पर्यावरण", "हरित", "सौर", "प्रदूषण", "स्वच्छ", "environment", "green", "solar", "pollution", "clean"),
    "HR": ("भर्ती", "कर्मचारी", "नियुक्ति", "प्रशिक्षण", "पदोन्नति", "recruit", "employee", "staff", "appointment", "training"),
    "Tenders": ("निविदा", "ठेका", "अनुबंध", "tender", "contract", "bid"),
    "Delays": ("विलंब", "देरी", "लेट", "रद्दीकरण", "delay", "late", "cancel"),
    "New-Trains": ("नई ट्रेन", "नई रेलगाड़ी", "वंदे भारत", "अमृत भारत", "स्पेशल ट्रेन", "उद्घाटन", "new train", "vande bharat", "amrit bharat", "special train", "inaugurat"),
    "Station-Development": ("स्टेशन", "अमृत भारत स्टेशन", "पुनर्विकास", "प्लेटफॉर्म", "station", "redevelop", "platform"),
    "Freight": ("माल", "मालगाड़ी", "ढुलाई", "लदान", "freight", "cargo", "goods", "loading"),
    "Tourism": ("पर्यटन", "तीर्थ", "भारत गौरव", "tourism", "tourist", "pilgrim"),
}
