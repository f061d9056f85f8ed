"""Word lists of the language rules."""

# Words that hint at Roman Urdu.
ROMAN_URDU_HINTS = """
bukhar bukhaar dard khansi khasi matli ulti qay dast
kamzori thakaan chakkar sujan khujli daane dane
zukam nazla saans tabiyat bohat bahut zyada mujhe
seene sine peshab peet gardan kamar jism badan
hai hain ho raha rahi hoon hun tha thi
hoga hogi hua hui jayein jayen karein karen
lein len piyein piyen
ye yeh wo woh main mein aap ap hum tum
kya kyun kab kahan kaun kis kaise kitnay
se ka ki ke ko par tak bhi
toh to aur ya nahi nahin na phir ab
sb sab k h hn kch kuch btao batao
kal aj aaj abhi parso
salaam salam
ghar khana khaana
paani pani
theek thik
zaroor
wajah waja
ilaj
doctor
sirf aam maloomat
aksar mushkil
shehad adrak
masla
nishani nishaan
shukriya shukr
takleef
apka aapka apki aapki
""".split()

# Words that suffice on their own.
STRONG_HINTS = """
bukhar dard khansi matli ulti qay dast
kamzori thakaan chakkar sujan khujli daane
zukam nazla saans tabiyat mujhe
""".split()

# Roman Urdu phrase to English.
PHRASES = {
    "bukhar": "fever",
    "bukhaar": "fever",
    "tez bukhar": "high fever",
    "sar dard": "headache",
    "sardard": "headache",
    "sar ka dard": "headache",
    "dard": "pain",
    "takleef": "pain",
    "jism dard": "body ache",
    "badan dard": "body ache",
    "dard ho raha hai": "I am in pain",
    "kamzori": "weakness",
    "thakaan": "fatigue",
    "chakkar": "dizziness",
    "chakkar aana": "dizziness",
    "behoshi": "loss of consciousness",
    "gardan dard": "neck pain",
    "kamar dard": "back pain",
    "khansi": "cough",
    "khasi": "cough",
    "saans lena mushkil": "difficulty breathing",
    "saans phoolna": "shortness of breath",
    "naak bagna": "runny nose",
    "naak band": "blocked nose",
    "nazla": "cold / nasal congestion",
    "zukam": "cold",
    "gale mein dard": "sore throat",
    "gala kharab": "sore throat",
    "ulti": "vomiting",
    "qay": "vomiting",
    "matli": "nausea",
    "dast": "diarrhea",
    "qabz": "constipation",
    "pait dard": "abdominal pain",
    "pet dard": "abdominal pain",
    "bhook nahi": "loss of appetite",
    "bhook na lagna": "loss of appetite",
    "khujli": "itching",
    "daane": "rash",
    "dane": "rash",
    "sujan": "swelling",
    "soraa": "wound / sore",
    "seene mein dard": "chest pain",
    "sine mein dard": "chest pain",
    "dil ki dharkan": "palpitations",
    "dil tez dhadakna": "rapid heartbeat",
    "peshab mein jalan": "burning urination",
    "bar bar peshab": "frequent urination",
    "aankhon ke aage andhera": "blurred vision",
    "yaad nahi rehta": "memory loss",
    "haath pair sonne": "numbness in hands and feet",
    "kal se": "since yesterday",
    "kuch dino se": "for a few days",
    "haftay se": "for a week",
    "bohat": "very",
    "thoda": "a little",
    "zyada": "more",
    "kam": "less",
    "acha nahi feel": "not feeling well",
    "tabiyat theek nahi": "not feeling well",
    "tabiyat kharab": "feeling unwell",
}

# Everyday English wording to the usual term, applied in this order.
TERM_SYNONYMS = {
    "stomachache": "abdominal pain",
    "stomach ache": "abdominal pain",
    "tummy ache": "abdominal pain",
    "loose motions": "diarrhea",
    "loose stool": "diarrhea",
    "running nose": "runny nose",
    "breathlessness": "shortness of breath",
    "throwing up": "vomiting",
    "throwing-up": "vomiting",
    "feel sick": "nausea",
    "feeling sick": "nausea",
}

# One-word forms used by the entry form in Urdu mode.
FORM_TERMS = {
    "bukhaar": "fever", "bukhar": "fever", "taiz_bukhaar": "high_fever",
    "sar_dard": "headache", "sardard": "headache",
    "khansi": "cough", "kamzori": "fatigue",
    "dast": "diarrhoea", "ulti": "vomiting", "matli": "nausea",
    "pait_dard": "stomach_pain", "seene_mein_dard": "chest_pain",
    "saans_phulna": "difficulty_breathing", "chakkar": "dizziness",
    "jor_dard": "joint_pain", "jism_dard": "muscle_pain",
}

# Letter to Latin; the one pair is looked at before single letters.
LETTER_PAIR = ("لا", "la")
LETTERS = {
    "ا": "a", "آ": "aa", "ب": "b", "پ": "p", "ت": "t", "ٹ": "T",
    "ث": "s", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d",
    "ڈ": "D", "ذ": "z", "ر": "r", "ڑ": "R", "ز": "z", "ژ": "zh",
    "س": "s", "ش": "sh", "ص": "s", "ض": "z", "ط": "t", "ظ": "z",
    "ع": "", "غ": "gh", "ف": "f", "ق": "q", "ک": "k", "گ": "g",
    "ل": "l", "م": "m", "ن": "n", "ں": "n", "و": "o", "ہ": "h",
    "ھ": "h", "ء": "", "ی": "i", "ے": "e", "ئ": "y", "ؤ": "o",
    "ۃ": "h",
    "۰": "0", "۱": "1", "۲": "2", "۳": "3", "۴": "4",
    "۵": "5", "۶": "6", "۷": "7", "۸": "8", "۹": "9",
    "َ": "a", "ِ": "i", "ُ": "u", "ْ": "",
    "ّ": "", "ٔ": "", "ٕ": "",
}

# Pattern to Roman Urdu word, whole words, any case, applied in this order.
REPLY_TERMS = [
    (r"\bfeer\b", "bukhar"),
    (r"\bfever\b", "bukhar"),
    (r"\bbody\s+(?:ache|pain)\b", "jism mein dard"),
    (r"\bbody\s+ki\s+dard\b", "jism mein dard"),
    (r"\bbody\b", "jism"),
    (r"\bache\b", "dard"),
    (r"\bpain\b", "dard"),
    (r"\bvomiting\b", "ulti"),
    (r"\bnausea\b", "matli"),
    (r"\bdiarrhea\b", "dast"),
    (r"\bdiarrhoea\b", "dast"),
    (r"\bcough(?:ing)?\b", "khansi"),
    (r"\bshortness\s+of\s+breath\b", "saans phoolna"),
    (r"\bbreathing\s+(?:difficulty|problem|trouble|issue)\b", "saans ki takleef"),
    (r"\bdifficulty\s+(?:in\s+)?breathing\b", "saans ki takleef"),
    (r"\bbreathing\b", "saans lena"),
    (r"\bbreath\b", "saans"),
    (r"\bheadache\b", "sar dard"),
    (r"\bsore\s+throat\b", "gala kharab"),
    (r"\bthroat\s+(?:pain|ache|hurting|hurts)\b", "gala dard"),
    (r"\bthroat\b", "gala"),
    (r"\bweakness\b", "kamzori"),
    (r"\bfatigue\b", "thakaan"),
    (r"\bdizziness\b", "chakkar"),
    (r"\bdizzy\b", "chakkar"),
    (r"\bswelling\b", "sujan"),
    (r"\bitching\b", "khujli"),
    (r"\brash\b", "daane"),
    (r"\bmedicines?\b", "dawai"),
    (r"\bmedication\b", "dawai"),
    (r"\btreatment\b", "ilaj"),
    (r"\bpossibility\b", "mumkin"),
    (r"\bpossible\b", "mumkin"),
    (r"\bweeks\b", "haftay"),
    (r"\bweek\b", "hafta"),
    (r"\bwater\b", "paani"),
    (r"\bstomach\b", "pet"),
]
