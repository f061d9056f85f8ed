"""Small seed tables for tests and demos.

Feature lists, synonyms, disease maps, search terms and medicines are inputs of
the jobs: users bring their own tables, of any size.
"""

FEATURES = [
    "itching", "skin_rash", "chills", "joint_pain", "stomach_pain", "acidity", "vomiting",
    "fatigue", "weight_loss", "cough", "high_fever", "mild_fever", "breathlessness", "sweating",
    "headache", "nausea", "loss_of_appetite", "back_pain", "abdominal_pain", "muscle_pain",
    "neck_pain", "dizziness", "chest_pain", "spinning_movements", "loss_of_balance",
    "visual_disturbances", "swelling_joints", "runny_nose", "dark_urine", "yellowish_skin",
]

SYNONYMS = {
    "fever": ["high_fever"],
    "high_temperature": ["high_fever"],
    "temperature": ["high_fever", "mild_fever"],
    "body_aches": ["muscle_pain", "joint_pain"],
    "aches": ["muscle_pain", "joint_pain"],
    "severe_headache": ["headache"],
    "migraine": ["headache"],
    "vertigo": ["dizziness", "spinning_movements", "loss_of_balance"],
    "shoulder_pain": ["neck_pain"],
    "tummy_ache": ["stomach_pain", "abdominal_pain"],
    "light_sensitivity": ["visual_disturbances"],
    "night_sweat": ["sweating"],
    "shivering": ["chills", "shaking"],
    "hair_fall": ["hair_loss"],
}

# Entered terms of the derived request table: exact, synonym, plural, misspelt, run-on and unknown.
ENTERED_TERMS = [
    "high fever", "cough", "body aches", "headaches", "Itching", "skin rash", "vertigo",
    "vomitting", "chest pain", "breathlessness", "fever", "zzzzqq", "night sweats", "nausea",
    "high fever severe headache joint pain skin rash", "dizzyness", "joint pain", "hair fall",
    "back pains", "loss of balance", " Fatigue ", "weight loss", "dark urine", "yellowish skin",
    "qqq xxx cough yyy chills jjj", "stomach pain", "runny nose", "acidity", "swelling_joints",
    "tummy ache",
]

DISEASE_FEATURES = {
    "Fungal infection": ["itching", "skin_rash"],
    "Allergy": ["chills", "runny_nose", "itching"],
    "Malaria": ["chills", "vomiting", "high_fever", "sweating", "headache", "nausea", "muscle_pain"],
    "Dengue": ["skin_rash", "chills", "joint_pain", "vomiting", "fatigue", "high_fever", "headache", "nausea"],
    "Jaundice": ["itching", "vomiting", "fatigue", "weight_loss", "yellowish_skin", "dark_urine"],
    "Migraine": ["acidity", "headache", "visual_disturbances"],
    "Vertigo": ["vomiting", "headache", "nausea", "spinning_movements", "loss_of_balance", "dizziness"],
    "Pneumonia": ["chills", "fatigue", "cough", "high_fever", "breathlessness", "sweating", "chest_pain"],
    "Heart attack": ["vomiting", "breathlessness", "sweating", "chest_pain"],
    "Arthritis": ["swelling_joints", "joint_pain", "muscle_pain", "back_pain"],
    "Gastritis": ["stomach_pain", "acidity", "abdominal_pain", "loss_of_appetite"],
}

VIGNETTES = [
    ("Allergy", ["sneezing", "itching", "runny nose", "chills"]),
    ("Malaria", ["fever", "chills", "sweating", "headache"]),
    ("Dengue", ["high fever", "headache", "joint pain", "skin rash"]),
    ("Jaundice (acute)", ["yellowish skin", "dark urine", "fatigue"]),
    ("Vertigo", ["dizziness", "loss of balance", "nausea"]),
    ("Heart Attack", ["chest pain", "breathlessness", "sweating", "nausea"]),
    ("Psoriasis", ["skin rash", "itching"]),
]

# (disease, drug, type)
MEDICINES = [
    ("Malaria", "Paracetamol", "otc"),
    ("Malaria", "Chloroquine", "prescription"),
    ("Malaria", "Primaquine", "prescription"),
    ("Allergy", "Cetirizine 10mg", "otc"),
    ("Allergy", "Loratadine", "otc"),
    ("Allergy", "Montelukast", "prescription"),
    ("Migraine", "Ibuprofen 400mg", "otc"),
    ("Migraine", "Sumatriptan", "prescription"),
    ("Dengue", "ORS", "otc"),
    ("Dengue", "Rest", "otc"),
    ("Heart attack", "Aspirin 325mg", "otc"),
    ("Pneumonia", "Amoxicillin", "prescription"),
    ("Pneumonia", "Azithromycin", "prescription"),
]
# What is offered when no table knows the disease.
DEFAULT_OTC = ["Paracetamol 500mg", "ORS sachets", "Multivitamins"]
DEFAULT_PRESCRIPTION = ["Consult a doctor for prescription medicines"]
