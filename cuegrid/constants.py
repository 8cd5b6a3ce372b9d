"""Word lists, lookup tables, thresholds and formats that results depend on."""

# Readability thresholds of the house profile.
MAX_LINES, PREFERRED_CPS, HARD_MAX_CPS, PREFERRED_CPL, HARD_MAX_CPL, MIN_DURATION_MS, MIN_GAP_MS = 2, 17, 20, 40, 42, 800, 80

# Scene segmentation.
SCENE_MIN_CUES, SCENE_MAX_CUES, SCENE_GAP_MS = 10, 30, 3500

# Letters: Arabic kaf, yeh and alef maqsura become their Kurdish forms, tatweel goes.
LETTERS_FROM, LETTERS_TO = "كيىـ", "کیی"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
RLM = "‏"

# Kurmanji letters and markers.
KURMANJI_CHARS = "êîûşçÊÎÛŞÇ"
KURMANJI_MARKERS = ["دکەت", "دکەن", "دبێت", "دبن", "ئەز", "تە", "وە", "وان", "هاتیە", "چوویە"]

# English words that may stay in a translation.
ALLOWED_ENGLISH = [
    "i", "b", "u", "font", "color", "size", "br", "div", "span",
    "ok", "tv", "dvd", "dna", "fbi", "cia", "ngo", "usa", "sms", "gps", "atm", "vip", "dj", "cd", "pc", "wi", "fi",
    "km", "kg", "mg", "mm", "cm", "ml",
    "taxi", "internet", "video", "radio", "facebook", "google", "email", "telegram", "whatsapp", "youtube",
]

# Negation in a translation, and the mark of a placeholder translation.
TARGET_NEGATIONS = ["نە", "نا", "مە", "نیت", "نییە"]
PLACEHOLDER = "تەرجەمەی:"

# Honorifics, in order.
HONORIFICS = [("mr.", "بەڕێز"), ("mrs.", "خاتوونی"), ("ms.", "خاتوو"), ("dr.", "دکتۆر"), ("professor", "پڕۆفیسۆر"), ("captain", "کاپتن"), ("detective", "پشکنەر")]

# Languages named by an opaque marker.
LANGUAGES = {
    "spanish": "ئیسپانی", "french": "فەرەنسی", "german": "ئەڵمانی", "italian": "ئیتالی", "russian": "ڕوسی", "arabic": "عەرەبی", "turkish": "تورکی", "japanese": "ژاپۆنی",
    "chinese": "چینی", "korean": "کۆری", "portuguese": "پورتوگالی", "hindi": "هیندی", "persian": "فارسی", "hebrew": "عیبری", "dutch": "هۆڵەندی", "swedish": "سویدی",
    "polish": "پۆلەندی", "greek": "یۆنانی", "thai": "تایلەندی", "vietnamese": "ڤیەتنامی", "latin": "لاتینی", "mandarin": "چینی ماندارین", "cantonese": "چینی کانتۆنی",
}
SPEAKS = "دەدوێت"

# Broadcast compliance: term, replacement, severity.
COMPLIANCE = [("سگ", "نەفرەتی", "medium"), ("خوێنڕێژی", "توندوتیژی", "low")]

# Phrases of the offline dictionary provider, in order; the first one inside a text wins.
PHRASES = [
    ("hello my friend", "سڵاو هاوڕێم"), ("hello", "سڵاو"), ("goodbye", "ماڵئاوا"), ("yes", "بەڵێ"), ("no", "نەخێر"), ("thank you very much", "زۆر سوپاس"), ("thank you", "سوپاس"),
    ("i told you to stop", "پێم گوتیت بوەستە"), ("what are you doing", "چی دەکەیت؟"), ("you're pushing your luck", "تۆ زێدەڕۆیی لە بەختت دەکەیت"), ("bite your tongue", "زمانت بگرە!"),
    ("break a leg", "بەختی باشت هەبێت!"), ("i am in over my head", "من لە سەرتاپای ئەم بابەتەدا نوقم بووم"), ("over my dead body", "تەنها بەسەر تەرمەکەمدا!"), ("it's raining cats and dogs", "بارانی زۆر دێت"),
    ("you stabbed me in the back", "تۆ خیانەتت لێکردم!"), ("hold your horses", "هێمن بە! چاوەڕوان بە!"), ("don't let the cat out of the bag", "نهێنییەکە ئاشکرا مەکە"),
    ("i have bigger fish to fry", "کاری گرنگتر لەمە هەیە بۆ ئەنجامدان"), ("time to face the music", "کاتی ئەوەیە بەرگریت بکەیت و ئەنجامەکە قبوڵ بکەیت"), ("speak of the devil", "قسەی لێوە بوو!"),
    ("the ball is in your court", "ئێستا بڕیاردان لە دەستی تۆیە"), ("he kicked the bucket", "مرد"), ("keep your eyes peeled", "ئاگادار بن و باش سەیر بکەن"), ("hit the nail on the head", "تەواو بە دروستی پێت گوت"),
    ("under the weather", "کەمێک هەست بە نەخۆشی دەکەم"), ("spill the beans", "سڕەکە ئاشکرا بکە!"), ("barking up the wrong tree", "لە شوێنی هەڵەدا دەگەڕێیت"), ("burn the midnight oil", "تا درەنگانی شەو کارم دەکرد"),
    ("i love you", "خۆشمدەوێت"), ("help me", "یارمەتیم بدە"), ("let's go", "وەرە بڕۆین"), ("come on", "وەرە"), ("wait", "وەستە"), ("stop", "بوەستە"), ("run", "بڕۆ"), ("get out", "بچۆ دەرەوە"),
    ("shut up", "دەمت دابخە"), ("please", "تکایە"), ("sorry", "ببورە"), ("be careful", "وریابە"), ("are you ok", "باشیت؟"), ("i'm fine", "باشم"), ("what happened", "چی بوو؟"),
    ("i don't know", "نازانم"), ("it's over", "تەواو بوو"),
]

# Prices in USD for 1,000 tokens: model, input, output.
PRICES = [
    ("gemini-2.5-pro", 0.00125, 0.005), ("gemini-2.5-flash", 0.00015, 0.0006), ("gpt-4o", 0.0025, 0.01), ("gpt-4o-mini", 0.00015, 0.0006),
    ("claude-sonnet-4-20250514", 0.003, 0.015), ("claude-3-5-haiku-20241022", 0.0008, 0.004), ("_default", 0.001, 0.003),
]

# QC rules: name, category, severity, points of 100.
RULES = [
    ("hard_max_cps", "technical", "major", 15), ("hard_max_cpl", "technical", "minor", 10), ("max_lines", "technical", "major", 20), ("min_duration", "technical", "minor", 5),
    ("kurmanji_contamination", "linguistic", "critical", 40), ("untranslated_english", "linguistic", "major", 25), ("llm_error_pattern", "linguistic", "major", 20), ("excessive_ezafe_chain", "linguistic", "minor", 10),
    ("number_inconsistency", "semantic", "critical", 35), ("negation_reversal", "semantic", "critical", 45), ("question_mark_missing", "semantic", "minor", 10), ("mock_fallback_detected", "semantic", "critical", 50),
    ("length_ratio_too_short", "semantic", "major", 20), ("length_ratio_too_long", "semantic", "minor", 10), ("duplicate_translation", "semantic", "major", 20),
]
REVIEW_BELOW, PASS_FROM = 88, 85

# Advanced SubStation header; the title is filled in.
ASS_HEADER = """[Script Info]
Title: {title}
ScriptType: v4.00+
WrapStyle: 0
ScaledBorderAndShadow: yes
YCbCr Matrix: None

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Noto Naskh Arabic,28,&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""

# Codes of a provider's failures that may pass.
RETRIED_CODES = [429, 500, 502, 503, 529]
