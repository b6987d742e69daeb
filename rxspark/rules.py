"""Clinical rule tables. All values in this file are fixed: results depend on them."""

from __future__ import annotations

# --- fixed values: allergen -> molecule keywords of its family, in match order ---
ALLERGY_FAMILIES: dict[str, list[str]] = {
    "pénicilline": [
        "cilline", "cillin", "amoxicilline", "ampicilline", "oxacilline", "cloxacilline",
        "flucloxacilline", "pivmécillinam", "pénicilline", "bêta-lactamine", "céfixime", "cefixime",
        "céfazoline", "cefazoline", "céfalexine", "cefalexine", "ceftriaxone", "cefotaxime",
        "céfuroxime", "cefuroxime", "ceftazidime",
    ],
    "penicilline": [
        "cilline", "cillin", "amoxicilline", "ampicilline", "oxacilline", "cloxacilline",
        "pénicilline", "céfixime", "cefixime", "ceftriaxone", "céfazoline",
    ],
    "amoxicilline": [
        "cilline", "cillin", "ampicilline", "oxacilline", "céfixime", "cefixime", "ceftriaxone",
    ],
    "ampicilline": ["cilline", "cillin", "amoxicilline", "oxacilline", "céfixime", "cefixime"],
    "sulfamide": [
        "sulfaméthoxazole", "sulfamethoxazole", "sulfamide", "cotrimoxazole", "triméthoprime",
        "trimethoprime", "sulfadiazine", "sulfadoxine", "sulfasalazine",
    ],
    "sulfamides": [
        "sulfaméthoxazole", "sulfamethoxazole", "sulfamide", "cotrimoxazole", "sulfadiazine",
        "sulfasalazine",
    ],
    "sulfaméthoxazole": [
        "sulfaméthoxazole", "sulfamethoxazole", "sulfamide", "cotrimoxazole", "sulfadiazine",
    ],
    "céphalosporine": [
        "céfazoline", "céfalexine", "cefazoline", "cefalexine", "céfixime", "cefixime",
        "ceftriaxone", "cefotaxime", "céfuroxime", "cefuroxime",
    ],
    "cephalosporine": [
        "céfazoline", "céfalexine", "cefazoline", "cefalexine", "céfixime", "cefixime", "ceftriaxone",
    ],
    "aspirine": [
        "acide acétylsalicylique", "acetylsalicylique", "ibuprofène", "ibuprofene", "naproxène",
        "naproxene", "diclofénac", "diclofenac", "kétorolac", "ketorolac", "méloxicam", "meloxicam",
    ],
    "ibuprofène": ["acide acétylsalicylique", "naproxène", "diclofénac", "kétorolac", "méloxicam"],
    "ibuprofene": ["acide acetylsalicylique", "naproxene", "diclofenac"],
    "iode": ["iode", "iodé", "iodée", "povidone", "levothyroxine", "lévothyroxine", "amiodarone"],
    "latex": ["latex"],
    "arachide": ["arachide", "huile d'arachide", "soja", "lécithine de soja"],
    "arachides": ["arachide", "huile d'arachide", "soja", "lécithine de soja"],
    "gluten": ["gluten", "blé", "orge", "seigle"],
    "lactose": ["lactose", "lactulose"],
    "quinolone": [
        "floxacine", "floxacin", "ofloxacine", "ciprofloxacine", "lévofloxacine", "moxifloxacine",
        "norfloxacine",
    ],
    "quinolones": [
        "floxacine", "floxacin", "ofloxacine", "ciprofloxacine", "lévofloxacine", "moxifloxacine",
    ],
    "macrolide": [
        "azithromycine", "clarithromycine", "érythromycine", "spiramycine", "roxithromycine",
    ],
    "macrolides": ["azithromycine", "clarithromycine", "érythromycine", "spiramycine"],
}

# --- fixed values: (molecule keyword, clearance threshold mL/min, severity, risk), in match order ---
RENAL_RULES: list[tuple[str, int, str, str]] = [
    ("metformine", 45, "MAJOR", "contre-indication (risque d'acidose lactique)"),
    ("metformin", 45, "MAJOR", "contre-indication (risque d'acidose lactique)"),
    ("ibuprofène", 30, "MAJOR", "néphrotoxicité aggravée en IRC"),
    ("ibuprofene", 30, "MAJOR", "néphrotoxicité aggravée en IRC"),
    ("naproxène", 30, "MAJOR", "néphrotoxicité aggravée en IRC"),
    ("diclofénac", 30, "MAJOR", "néphrotoxicité aggravée en IRC"),
    ("kétorolac", 30, "MAJOR", "néphrotoxicité aggravée en IRC"),
    ("gentamicine", 60, "MAJOR", "accumulation et néphrotoxicité"),
    ("vancomycine", 50, "MAJOR", "accumulation et néphrotoxicité"),
    ("amikacine", 60, "MAJOR", "accumulation et néphrotoxicité"),
    ("dabigatran", 30, "MAJOR", "accumulation — risque hémorragique"),
    ("rivaroxaban", 15, "MAJOR", "accumulation — risque hémorragique"),
    ("apixaban", 25, "MODERATE", "précaution, adapter la dose"),
    ("glyburide", 60, "MAJOR", "risque d'hypoglycémie prolongée"),
    ("glibenclamide", 60, "MAJOR", "risque d'hypoglycémie prolongée"),
    ("sitagliptine", 45, "MODERATE", "adapter la posologie à la fonction rénale"),
    ("spironolactone", 30, "MAJOR", "risque d'hyperkaliémie en IRC"),
    ("triamtérène", 30, "MAJOR", "risque d'hyperkaliémie en IRC"),
    ("lithium", 50, "MAJOR", "accumulation — fenêtre thérapeutique étroite"),
    ("colchicine", 30, "MAJOR", "accumulation — risque de myopathie/neuropathie"),
    ("aciclovir", 25, "MODERATE", "adapter la posologie"),
    ("valaciclovir", 30, "MODERATE", "adapter la posologie"),
]

# --- fixed values: rule -> (title, detail); {0}, {1}, ... are values that the rule gives ---
ALERT_TEXTS: dict[str, tuple[str, str]] = {
    "allergy_exact": (
        "Allergie connue — {dci}",
        "Le patient a une allergie documentée à : {0}. Médicament prescrit : {name}.",
    ),
    "allergy_text": (
        "Allergie potentielle — {name}",
        "Le médicament {name} peut contenir ou être associé à '{0}' (excipient ou contre-indication). "
        "Allergie documentée : {0}. Vérifier la composition complète avant de dispenser.",
    ),
    "allergy_family": (
        "Allergie croisée — {name}",
        "Le patient est allergique aux {0}. Le médicament prescrit ({name}) appartient à cette famille ou présente un "
        "risque de réaction croisée (DCI : {1}). Vérifier avant administration.",
    ),
    "age": (
        "Âge insuffisant — {name}",
        "Ce médicament est autorisé à partir de {0}. Âge du patient : {1} an(s).",
    ),
    "pregnancy": (
        "Contre-indication grossesse — {name}",
        "La fiche du médicament mentionne une contre-indication liée à la grossesse.{0}",
    ),
    "breastfeeding": (
        "Contre-indication allaitement — {name}",
        "La fiche du médicament mentionne une contre-indication liée à l'allaitement.",
    ),
    "psychoactive": (
        "Substance psychoactive — {name}",
        "Ce médicament contient une ou plusieurs substances psychoactives. Vérifier l'absence de co-prescription "
        "sédative et informer le patient.",
    ),
    "renal": (
        "Insuffisance rénale — {name}",
        "Ce médicament est {0} lorsque la clairance rénale est < {1} mL/min. Clairance du patient : {2} mL/min (IRC {3}). "
        "Adapter la posologie ou substituer.",
    ),
    "duplicate": (
        "Redondance de DCI — {0}",
        "La molécule '{0}' est présente dans plusieurs lignes de la prescription : {1}. Risque de surdosage cumulatif.",
    ),
}

# --- fixed values: substrings that mention pregnancy and breastfeeding ---
PREGNANCY_TERMS = [
    "grossesse", "enceinte", "pregnant", "pregnancy", "tératogène", "teratogen", "foetus", "fœtus",
]
BREASTFEEDING_TERMS = ["allaitement", "allaiter", "breastfeed", "lactation", "lait maternel"]

# --- fixed values: (level pattern, level, severity), first match wins ---
LEVEL_PATTERNS: list[tuple[str, str, str]] = [
    (r"(?i)association\s+d[eé]conseil+[eé]+", "Association déconseillée", "MAJOR"),
    (r"(?i)contre[- ]?indication", "Contre-indication", "MAJOR"),
    (r"(?i)pr[eé]caution\s+d'emploi", "Précaution d'emploi", "MODERATE"),
    (r"(?i)[aà]\s+prendre\s+en\s+compte", "À prendre en compte", "MINOR"),
    (r"(?i)\basdec\b", "Association déconseillée", "MAJOR"),
    (r"(?i)\bapec\b", "À prendre en compte", "MINOR"),
    (r"(?i)\bpe\b", "Précaution d'emploi", "MODERATE"),
    (r"(?i)\bci\b", "Contre-indication", "MAJOR"),
]

# --- fixed values: thesaurus page layout ---
COLUMN_SPLIT = 310
FONT_HEAD = "CIDFont+F1"
FONT_BODY = "CIDFont+F2"
HEAD_MIN_SIZE = 9.0

# --- fixed values: severities, decisions, thesaurus corrections ---
SEVERITY_RANK = {"MAJOR": 3, "MODERATE": 2, "MINOR": 1}
ALERT_TYPES = ["ALLERGY", "REDUNDANT_DCI", "POSOLOGY", "CONTRA_INDICATION", "INTERACTION", "RENAL"]
DECISIONS = ["ACCEPTED", "IGNORED", "OVERRIDE"]
MOLECULE_FIXES = {"OR": "SEL(S) D'OR"}
THESAURUS_SOURCE = "ANSM_2023"

# --- fixed values: French number words in minimum ages ---
NUMBER_WORDS = {
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7,
    "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12,
}

# --- fixed values: raw catalogue header -> column ---
CATALOGUE_HEADERS = {
    "drug_name": "brand_name_raw",
    "Présentation": "presentation_raw",
    "Dosage": "dosage_raw_raw",
    "Distributeur ou fabriquant": "labo_raw",
    "Composition": "composition_raw",
    "Classe thérapeutique": "class_raw",
    "Statut": "status_raw",
    "Code ATC": "atc_raw",
    "PPV": "ppv_raw",
    "Prix hospitalier": "hospital_raw",
    "Tableau": "toxicity_raw",
    "Nature du Produit": "nature_raw",
    "Indication(s)": "indications_raw",
    "Substance (s) psychoactive (s)": "psycho_raw",
    "Contres-indication(s)": "contra_raw",
    "Age minimal d'utilisation": "age_raw",
    "Lien du Produit": "link_raw",
}

# --- fixed values: explanation length limits, override texts and score band ---
MIN_EXPLANATION, MAX_EXPLANATION = 20, 800
MIN_JUSTIFICATION = 10
MAX_FEEDBACK = 200
SHORT_JUSTIFICATION_FEEDBACK = "Justification trop courte pour être médicalement valide."
OFTEN_IGNORED_SCORE = 0.7
