"""Term tables. Larger ones are data that the caller loads (sources.lexicons); these are fixed values.

Every mapping here must equal the published system's for equal results; order is meaningful where rules apply
one after the other.
"""

# Abbreviations, replaced one after the other as whole words.
ABBREVIATIONS = {
    "mi": "myocardial infarction", "ami": "acute myocardial infarction", "stemi": "st-elevation myocardial infarction",
    "nstemi": "non-st-elevation myocardial infarction", "chf": "congestive heart failure", "copd": "chronic obstructive pulmonary disease",
    "dm": "diabetes mellitus", "dm2": "diabetes mellitus type 2", "htn": "hypertension", "cad": "coronary artery disease",
    "pe": "pulmonary embolism", "dvt": "deep vein thrombosis", "uti": "urinary tract infection", "pneumonia": "pneumonia",
    "sepsis": "sepsis", "aki": "acute kidney injury", "ckd": "chronic kidney disease", "ecg": "electrocardiogram",
    "ekg": "electrocardiogram", "ct": "computed tomography", "mri": "magnetic resonance imaging", "ace": "angiotensin converting enzyme",
    "arbs": "angiotensin receptor blockers", "tpa": "tissue plasminogen activator", "asa": "aspirin", "nsaids": "nonsteroidal anti-inflammatory drugs",
    "iv": "intravenous", "im": "intramuscular", "po": "oral", "stat": "immediately", "bid": "twice daily", "tid": "three times daily",
    "qid": "four times daily", "qd": "once daily", "qod": "every other day", "prn": "as needed", "mg": "milligram", "g": "gram",
    "ml": "milliliter", "kg": "kilogram",
}

# Synonym groups; a group is found by its first term that is in the text.
SYNONYMS = {
    "heart_attack": ["myocardial infarction", "mi", "ami", "heart attack", "cardiac arrest"],
    "chest_pain": ["chest pain", "angina", "chest discomfort", "precordial pain", "retrosternal pain", "pressure-like pain", "crushing pain"],
    "chest_pain_radiation": ["left arm pain", "jaw pain", "radiation to arm", "radiates to back", "radiates to shoulder"],
    "shortness_of_breath": ["dyspnea", "shortness of breath", "sob", "breathlessness", "difficulty breathing"],
    "high_blood_pressure": ["hypertension", "htn", "high blood pressure", "elevated blood pressure"],
    "diabetes": ["diabetes mellitus", "dm", "diabetes", "diabetes type 2", "dm2"],
    "stroke": ["cerebrovascular accident", "cva", "stroke", "brain attack"],
    "stroke_deficit": ["hemiparesis", "unilateral weakness", "facial droop", "aphasia", "dysarthria"],
    "ecg_features": ["st elevation", "st depression", "t wave inversion", "new lbbb", "q waves"],
    "kidney_failure": ["renal failure", "kidney failure", "aki", "acute kidney injury"],
    "infection": ["infection", "sepsis", "bacteremia", "systemic infection"],
    "acute_limb_ischemia": ["pale cold limb", "pulseless limb", "limb ischemia"],
    "neutropenic_fever": ["fever with neutropenia", "low neutrophils fever", "oncology fever"],
    "treatment": ["treatment", "therapy", "management", "intervention", "care"],
    "medication": ["medication", "drug", "medicine", "pharmaceutical"],
    "dose": ["dose", "dosage", "amount", "quantity"],
    "duration": ["duration", "length", "period", "course", "days"],
    "antibiotic": ["antibiotic", "antimicrobial", "antibacterial", "anti-infective"],
    "pain": ["pain", "ache", "discomfort", "soreness"],
    "fever": ["fever", "pyrexia", "elevated temperature", "hyperthermia"],
    "bleeding": ["bleeding", "hemorrhage", "blood loss", "hemorrhaging"],
    "oxygen": ["nasal cannula", "face mask oxygen", "supplemental oxygen"],
    "iv_access": ["iv line", "intravenous access", "drip", "cannula"],
}

# Expansions appended to a query.
EXPANSIONS = {
    "retrosternal pain": ["central chest pain", "pressure-like chest pain", "crushing chest pain"],
    "crushing pain": ["pressure-like pain", "tight chest pain"],
    "left arm radiation": ["radiation to upper limb", "pain radiating to arm", "jaw radiation"],
    "hemiparesis": ["unilateral weakness", "one-sided weakness"],
    "ecg": ["electrocardiogram", "ekg"],
    "stemi": ["st elevation mi", "st-segment elevation myocardial infarction"],
    "nstemi": ["non st elevation mi", "non-st-segment elevation myocardial infarction"],
    "troponin": ["cardiac enzyme", "cardiac biomarker"],
    "tpa": ["thrombolysis", "alteplase"],
    "thrombolysis": ["fibrinolysis", "alteplase"],
    "weakness": ["paresis", "loss of power"],
    "slurred speech": ["dysarthria"],
    "facial droop": ["facial asymmetry"],
    "nitroglycerin": ["glyceryl trinitrate", "gtn"],
    "asa": ["aspirin"],
    "acute limb ischemia": ["pulseless limb", "cold limb"],
    "neutropenic fever": ["oncology fever", "fever with low neutrophils"],
}

# Words that hint at a specialty.
SPECIALTIES = {
    "cardiology": ["heart", "cardiac", "myocardial", "coronary", "troponin", "ecg", "ekg", "chest pain", "mi", "chf", "angina"],
    "neurology": ["stroke", "cva", "headache", "seizure", "neurological", "brain", "cns", "meningitis", "epilepsy", "stiff neck"],
    "endocrinology": ["diabetes", "dm", "glucose", "insulin", "thyroid", "hormone", "a1c", "hemoglobin a1c", "hypoglycemia", "hypoglycaemia"],
    "gastroenterology": ["liver", "hepatic", "abdomen", "abdominal", "gi", "gastrointestinal", "hepatitis", "abscess"],
    "nephrology": ["kidney", "renal", "creatinine", "bun", "dialysis", "aki", "ckd", "glomerulonephritis"],
    "pulmonology": ["lung", "pulmonary", "copd", "asthma", "pneumonia", "respiratory", "dyspnea"],
    "infectious_disease": ["infection", "sepsis", "bacteremia", "antibiotic", "fever", "culture", "sti"],
    "pediatrics": ["child", "pediatric", "neonate", "newborn", "infant", "adolescent", "sick newborn", "neonatal", "baby", "hypoglycaemia", "hypoglycemia", "lethargy", "vomiting", "seizures", "hypotonia", "poor feeding"],
    "obstetrics": ["pregnant", "pregnancy", "obstetric", "labor", "delivery", "gestation", "gynecology"],
    "dermatology": ["skin", "rash", "dermatitis", "cellulitis", "abscess", "boil", "furuncle", "carbuncle", "fluctuant", "shaving"],
    "toxicology": ["poison", "toxic", "overdose", "ingestion"],
    "surgery": ["surgical", "operation", "procedure", "incision"],
}
CONDITION_SPECIALTY = {"heart_attack": "cardiology", "chest_pain": "cardiology", "diabetes": "endocrinology", "stroke": "neurology", "kidney_failure": "nephrology", "infection": "infectious_disease"}
TEST_SPECIALTY = {"troponin": "cardiology", "ecg": "cardiology", "ekg": "cardiology", "glucose": "endocrinology", "a1c": "endocrinology", "creatinine": "nephrology"}

# Urgency words, symptoms, drugs and tests looked for in a query.
EMERGENCY = ["emergency", "emergent", "acute", "critical", "urgent", "immediate", "stat", "code"]
URGENT = ["urgent", "soon", "prompt", "asap", "expedited"]
ROUTINE = ["routine", "elective", "scheduled", "follow-up", "maintenance"]
SYMPTOMS = ["pain", "fever", "cough", "shortness of breath", "dyspnea", "chest pain", "headache", "nausea", "vomiting", "diarrhea", "fatigue", "weakness", "dizziness", "syncope", "seizure", "rash", "jaundice", "edema", "swelling", "bleeding"]
TESTS = ["ecg", "ekg", "electrocardiogram", "ct", "mri", "x-ray", "ultrasound", "troponin", "creatinine", "glucose", "hemoglobin", "a1c", "blood test", "lab test", "culture", "biopsy"]
DRUGS = [
    "aspirin", "metformin", "insulin", "morphine", "nitroglycerin", "metoprolol", "lisinopril", "atorvastatin", "warfarin", "heparin",
    "antibiotic", "anticoagulant", "ace inhibitor", "beta blocker", "metronidazole", "ceftriaxone", "azithromycin", "doxycycline",
    "ciprofloxacin", "amoxicillin", "penicillin", "furosemide", "gentamicin", "ampicillin", "cloxacillin", "cefotaxime", "nitrofurantoin",
    "trimethoprim", "sulfamethoxazole", "cephalexin", "clindamycin", "vancomycin", "labetalol", "nifedipine", "magnesium sulfate",
    "oxytocin", "methylergonovine", "acetaminophen", "ibuprofen", "paracetamol", "diclofenac",
]
NEGATIONS = [r"\bno\s+(\w+)", r"\bdenies\s+(\w+)", r"\bwithout\s+(\w+)", r"\babsence\s+of\s+(\w+)", r"\bnegative\s+for\s+(\w+)", r"\bnot\s+(\w+)", r"\bunremarkable\s+(\w+)"]

# Diseases, symptoms and treatments that chunks are tagged with.
CHUNK_DISEASES = "pneumonia|sepsis|meningitis|diabetes|hypertension|hypotension|myocardial infarction|heart failure|stroke|pulmonary embolism|preeclampsia|eclampsia|anemia|infection|shock|arrhythmia|tuberculosis|malaria|typhoid|cholera|dengue|hepatitis|asthma|copd|bronchitis|gastroenteritis|cellulitis|endocarditis|neonatal sepsis|respiratory distress|jaundice|dehydration|acute kidney injury|chronic kidney disease|urinary tract infection"
CHUNK_SYMPTOMS = "fever|cough|dyspnea|pain|bleeding|vomiting|diarrhea|headache|seizure|confusion|weakness|fatigue|rash|swelling|tachycardia|bradycardia|hypoxia|cyanosis|jaundice|edema|nausea|syncope|dizziness|chest pain|abdominal pain"
CHUNK_TREATMENTS = "antibiotic|antiviral|analgesic|antipyretic|steroid|insulin|oxygen|fluids|transfusion|surgery|intubation|ceftriaxone|ampicillin|gentamicin|azithromycin|metronidazole|paracetamol|ibuprofen|morphine|epinephrine|dopamine|furosemide|magnesium sulfate|oxytocin|hydralazine"

# Patterns of intent, time and urgency; the class with most matches wins, the first of equals.
INTENTS = {
    "diagnosis": [r"\b(diagnos|identif|confirm|rule out|differential|what is|what are)\b", r"\b(cause|etiology|pathology)\b"],
    "treatment": [r"\b(treat|therapy|medication|drug|prescribe|administer|dose|dosage)\b", r"\b(antibiotic|antimicrobial|intervention)\b"],
    "management": [r"\b(manag|care|approach|protocol|guideline|recommend)\b", r"\b(should|consider|appropriate|plan)\b"],
    "prevention": [r"\b(prevent|prophylaxis|prophylactic|avoid|reduce risk)\b"],
    "test": [r"\b(test|laboratory|lab|diagnostic|imaging|procedure|examination)\b", r"\b(what.*test|which.*test|order|indicated)\b"],
}
TIMES = {
    "initial": [r"\b(initial|first|first-line|primary|immediate|stat|acute|emergency)\b", r"\b(start|begin|commence)\b"],
    "definitive": [r"\b(definitive|final|complete|full|standard)\b", r"\b(long-term|chronic|maintenance)\b"],
    "long-term": [r"\b(long-term|chronic|maintenance|ongoing|continued)\b"],
    "maintenance": [r"\b(maintenance|ongoing|continued|follow-up)\b"],
}
URGENCIES = {
    "emergency": [r"\b(emergency|emergent|immediate|stat|urgent|acute|critical|life-threatening)\b", r"\b(severe|shock|arrest|unstable)\b"],
    "urgent": [r"\b(urgent|soon|prompt|quick|rapid)\b"],
    "routine": [r"\b(routine|elective|scheduled|planned)\b"],
}
