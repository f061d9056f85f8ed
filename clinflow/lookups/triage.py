"""Word lists and reply templates of the chat triage."""

# Greetings that must match the whole message.
GREETINGS = [
    "hi", "hello", "hey", "hiya", "howdy", "greetings",
    "how are you", "how r u", "how are u", "whats up", "what's up", "sup",
    "good morning", "good afternoon", "good evening", "good night",
    "assalam", "assalamualaikum", "salam", "aoa",
]
# Greetings that may also open or close the message.
OPEN_GREETINGS = [
    "kaise", "kaisa", "kaisay",
    "kaise ho", "kaise hain", "kaisy ho", "kesy ho", "ap kaise hain",
    "theek ho", "theek hain", "kem cho", "kiddan",
    "adaab", "sat sri akal",
]

# Symptom keywords in the order they are looked for.
KEYWORDS = [
    "fever", "headache", "cough", "diarrhea", "vomiting", "chest pain",
    "shortness of breath", "breathlessness", "rash", "abdominal pain",
    "dizziness", "dehydration", "nausea", "sweating", "fatigue", "diabetes",
    "hunger", "thirst", "urination", "blood vomit", "blood in vomit",
    "vomiting blood", "sudden headache", "severe headache", "blood in stool",
    "weight loss", "night sweats", "persistent cough",
]

# Word groups that together mean an emergency.
EMERGENCY_GROUPS = [
    ["chest pain", "sweating"],
    ["chest pain", "breathlessness"],
    ["chest pain", "nausea"],
    ["chest pain", "dizziness"],
    ["chest pain", "sweating", "breathlessness"],
    ["blood", "vomiting"],
    ["blood", "stool"],
    ["sudden", "headache", "vomiting"],
    ["severe headache", "confusion"],
    ["severe headache", "fever"],
]

# Parts of words that make a message a question about medicines.
MEDICINE_WORDS = [
    "medicine", "medication", "drug", "tablet", "pill", "syrup", "injection",
    "treatment", "treat", "cure", "remedy", "prescri", "antibiotic", "what to take",
    "what should i take", "what can i take", "how to treat", "dawa", "dawai",
    "ilaj", "علاج", "دوا",
]

# Seed texts of our own; jobs take the templates as an argument.
GUIDANCE = {word: f"Note {word}: rest, drink enough, and see a doctor if it lasts or gets worse." for word in KEYWORDS}
REPLIES = {
    "greeting_english": "Hello, how can I help with your health today?",
    "greeting_roman_urdu": "Salam, aaj main aap ki kya madad kar sakta hoon?",
    "greeting_urdu": "السلام علیکم",
    "emergency": "This may be an emergency. Call an ambulance now.",
    "ask_disease": "Name the disease, or describe the symptoms, to get medicine information.",
    "generic": "Describe your symptoms, or ask about a disease or a medicine.",
    "notice": "General health information only. Please consult a doctor.",
}
# Seed texts of our own: system text per language for a request to a model.
SYSTEM_TEXTS = {
    "english": "Answer in English. Close with the advice to see a doctor.",
    "roman_urdu": "Answer in Roman Urdu. Close with the advice to see a doctor.",
    "urdu": "Answer in Urdu script. Close with the advice to see a doctor.",
}
