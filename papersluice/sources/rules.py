"""Rules as data: keywords, patterns, anchors, weights and thresholds, and the tables made of them.

A document type is added by adding rows to these tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TYPES = ("aadhaar", "pan", "vehicle_rc")

# They equal those that results are compared with.
KEYWORDS = {
    "aadhaar": ["aadhaar", "आधार", "uidai", "government of india", "भारत सरकार", "unique identification", "unique identification authority", "enrollment", "resident", "dob", "date of birth", "male", "female", "gender", "address", "पता"],
    "pan": ["income tax", "permanent account number", "pan", "income tax department", "govt. of india", "government of india", "आयकर विभाग", "स्थायी खाता संख्या", "father", "signature", "fathers name", "father's name"],
    "vehicle_rc": ["registration certificate", "vehicle", "registration number", "engine no", "chassis no", "registering authority", "owner", "रजिस्ट्रेशन", "वाहन", "इंजन", "चेसिस", "maker", "model", "vehicle class", "reg no", "rc", "rto"],
}
# Fixed values, with word edges written out so that every engine reads them alike.
PATTERNS = {
    "aadhaar": [r"(^|[^A-Za-z0-9_])[0-9]{4}\s+[0-9]{4}\s+[0-9]{4}([^A-Za-z0-9_]|$)", r"(^|[^A-Za-z0-9_])[0-9]{12}([^A-Za-z0-9_]|$)", r"(aadhaar|आधार)", r"UIDAI"],
    "pan": [r"(^|[^A-Za-z0-9_])[A-Z]{5}[0-9]{4}[A-Z]([^A-Za-z0-9_]|$)", r"[I1|]NCOME\s*TAX\s*DEP[A-Z]*", r"NCOME\s*T[A-X]+", r"P[AE]RM[A-Z]*\s*ACC[A-Z]*\s*NUM[A-Z]*", r"father'?s?\s+name", r"GOVT\.?\s*OF\s*IND[A-Z]*"],
    "vehicle_rc": [r"(^|[^A-Za-z0-9_])[A-Z]{2}\s*-?\s*[0-9]{2}\s*-?\s*[A-Z]{1,2}\s*-?\s*[0-9]{4}([^A-Za-z0-9_]|$)", r"(registration\s+certificate|vehicle\s+informa)", r"(chassis|engine\s+no)", r"(fuel|seating|unladen|wheel\s*base)", r"(mfg\s*date|form\s+23)", r"(model|maker|manufacturer)"],
}
PATTERN_WEIGHT, PHRASE_WEIGHT = 5, 2
#: Between equal scores the later type here wins.
TIE_ORDER = ("aadhaar", "pan", "vehicle_rc")
# Fixed values.
ANCHORS = {
    "aadhaar": {"required": ["aadhaar", "uidai", "government of india", "date of birth", "आधार"], "optional": ["name", "address", "gender", "pin", "enrollment", "vid"]},
    "pan": {"required": ["income tax", "permanent account number", "pan", "government of india"], "optional": ["father", "fathers name", "signature", "date of birth", "dob"]},
    "vehicle_rc": {"required": ["registration certificate", "registration number", "engine", "chassis", "owner"], "optional": ["vehicle", "make", "model", "fuel", "color", "fitness", "insurance"]},
}
ANCHOR_THRESHOLD = 80.0
# Fixed values.
#: type: least share of digits, most of special characters, range of the mean word length.
PROFILES = {"aadhaar": (0.15, 0.10, 3, 15), "pan": (0.10, 0.05, 3, 12), "vehicle_rc": (0.20, 0.15, 2, 15)}
# Fixed values.
FIELD_WEIGHTS = {
    "aadhaar": {"aadhaar_number": 0.4, "name": 0.3, "date_of_birth": 0.3},
    "pan": {"pan_number": 0.5, "name": 0.25, "date_of_birth": 0.25},
    "vehicle_rc": {"registration_number": 0.4, "owner_name": 0.2, "engine_number": 0.2, "chassis_number": 0.2},
}
CRITICAL_WEIGHT = 0.25
# Fixed values.
REQUIRED = {"aadhaar": ["aadhaar_number", "name", "date_of_birth"], "pan": ["pan_number", "name", "date_of_birth"], "vehicle_rc": ["registration_number", "owner_name"]}
REQUIRED_ELSE = ["id_number", "name"]
# Fixed values.
PRIORITY = {
    "aadhaar": ["aadhaar_number", "name", "date_of_birth", "gender", "address"],
    "pan": ["pan_number", "name", "father_name", "date_of_birth"],
    "vehicle_rc": ["registration_number", "owner_name", "engine_number", "chassis_number"],
}
SCORE_WEIGHTS = {"image_quality": 0.10, "ocr_confidence": 0.15, "regex": 0.10, "fuzzy": 0.10, "layout": 0.10, "kv": 0.10, "consistency": 0.10, "schema": 0.15, "distribution": 0.05, "spatial": 0.05}
THRESHOLDS = {"accept": 0.85, "review": 0.60, "max_non_alphanumeric": 0.85}
QUALITY = {"min_blur_score": 50.0, "min_brightness": 20.0, "max_brightness": 240.0, "min_contrast_ratio": 0.2, "min_edge_density": 0.005, "max_glare_ratio": 0.05}
QUALITY_WEIGHTS = {"blur": 0.30, "brightness": 0.20, "resolution": 0.20, "contrast": 0.20, "glare": 0.10}
STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]
WORD_WEIGHTS = {"stopword": 0.3, "numeric": 1.5, "other": 1.0}
LOW_CONFIDENCE, LEAST_WORDS = 60.0, 5
# Fixed values.
#: type: (keyword, band, tolerance) of layout anchors.
LAYOUT = {
    "aadhaar": [("aadhaar", "top", 0.3), ("uidai", "top", 0.3), ("government of india", "top", 0.3), ("date of birth", "center", 0.4), ("आधार", "top", 0.3)],
    "pan": [("income tax", "top", 0.3), ("permanent account number", "top", 0.3), ("pan", "top", 0.3), ("government of india", "top", 0.3), ("father", "center", 0.4)],
    "vehicle_rc": [("registration certificate", "top", 0.3), ("registration number", "top", 0.3), ("engine no", "center", 0.4), ("chassis no", "center", 0.4), ("owner", "top", 0.3)],
}
LAYOUT_LEAST = 2
# Fixed values.
#: type: field and the pattern configured for it.
FIELD_PATTERNS = {
    "aadhaar": {"aadhaar_number": r"[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}", "vid": r"[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}", "name": r"[A-Z][a-z]+(\s+[A-Z][a-z]+)*", "date_of_birth": r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", "pin_code": r"[0-9]{6}", "enrollment_id": r"[0-9]{14}"},
    "pan": {"pan_number": r"[A-Z]{5}[0-9]{4}[A-Z]", "name": r"[A-Z][A-Z\s]+", "date_of_birth": r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", "father_name": r"[A-Z][A-Z\s]+"},
    "vehicle_rc": {"registration_number": r"[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}", "engine_number": r"[A-Z0-9]{6,15}", "chassis_number": r"[A-Z0-9]{10,20}", "owner_name": r"[A-Z][A-Z\s]+", "registration_date": r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"},
}
#: Confidence of a typed document's field where none is given; the first is its key.
DEFAULT_CONFIDENCE = {
    "aadhaar": {"aadhaar_number": 0.9, "name": 0.8, "gender": 0.8, "date_of_birth": 0.8, "year_of_birth": 0.8, "address": 0.6, "pin_code": 0.8, "vid": 0.9, "enrollment_id": 0.9},
    "pan": {"pan_number": 0.95, "name": 0.8, "father_name": 0.7, "date_of_birth": 0.85},
    "vehicle_rc": {
        "registration_number": 0.95, "owner_name": 0.8, "engine_number": 0.8, "chassis_number": 0.8, "registration_date": 0.8, "vehicle_make_model": 0.7, "vehicle_class": 0.8, "fuel_type": 0.85,
        "seating_capacity": 0.8, "wheelbase": 0.7, "unladen_weight": 0.7, "vehicle_color": 0.7, "hypothecation": 0.6, "fitness_validity_date": 0.7, "insurance_validity_date": 0.7, "manufacturing_date": 0.7,
    },
}
# Fixed values.
STATE_CODES = [
    "AN", "AP", "AR", "AS", "BR", "CH", "CG", "DD", "DL", "DN", "GA", "GJ", "HP", "HR", "JH", "JK", "KA", "KL", "LA", "LD",
    "MH", "ML", "MN", "MP", "MZ", "NL", "OD", "OR", "PB", "PY", "RJ", "SK", "TN", "TR", "TS", "UK", "UP", "WB",
]
# Fixed values.
NOT_NAMES = {
    "aadhaar": ["government", "india", "aadhaar", "male", "female", "address", "date", "birth", "dob", "yob", "pata", "unique", "identification", "authority", "enrollment", "s/o", "d/o", "w/o", "c/o", "care of", "son of", "daughter of", "wife of", "vid", "help", "email", "www.", "website", "download", "uidai", "govt", "भारत", "सरकार", "आबकारी", "विभाग", "nrc", "pib", "name", "नाम", "नामा", "नाभ"],
    "pan": ["income", "tax", "department", "government", "india", "permanent", "account", "number", "signature", "date", "birth", "father"],
    "vehicle_rc": ["registration", "certificate", "vehicle", "engine", "chassis", "authority", "date", "class", "model", "make"],
}
# Fixed values.
FUELS = ["PETROL", "DIESEL", "CNG", "LPG", "ELECTRIC", "HYBRID", "PETRO"]
# Fixed values.
VEHICLE_CLASSES = ["MCWG", "MCWOG", "LMV", "LMV-NT", "HMV", "HTV", "MGV", "LGV", "PSV", "HPMV", "HGMV", "TRANS"]


@dataclass(frozen=True)
class DocumentType:
    """What makes a document type: rows of the rule tables."""

    name: str
    keywords: list[str]
    patterns: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    #: By field, patterns with one group that find its value, in the order they are tried.
    values: dict[str, list[str]] = field(default_factory=dict)
    required_anchors: list[str] = field(default_factory=list)
    optional_anchors: list[str] = field(default_factory=list)


def rule_tables(spark: SparkSession, more: list[DocumentType] | None = None) -> dict[str, DataFrame]:
    """The rules as small tables; more: further document types."""
    more = more or []
    weight = lambda k: PHRASE_WEIGHT if " " in k else 1
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "type_keywords": table([(t, k, weight(k)) for t, ks in KEYWORDS.items() for k in ks] + [(m.name, k, weight(k)) for m in more for k in m.keywords], "type string, keyword string, weight int"),
        "type_patterns": table([(t, p, PATTERN_WEIGHT) for t, ps in PATTERNS.items() for p in ps] + [(m.name, p, PATTERN_WEIGHT) for m in more for p in m.patterns], "type string, pattern string, weight int"),
        "anchors": table([(t, a, kind == "required", ANCHOR_THRESHOLD) for t, kinds in ANCHORS.items() for kind, names in kinds.items() for a in names] + [(m.name, a, names is m.required_anchors, ANCHOR_THRESHOLD) for m in more for names in (m.required_anchors, m.optional_anchors) for a in names], "type string, anchor string, required boolean, threshold double"),
        "labelled_values": table([(m.name, f, k, p) for m in more for f, ps in m.values.items() for k, p in enumerate(ps)], "type string, field_name string, place int, pattern string"),
        "profiles": table([(t, a, b, [c, d]) for t, (a, b, c, d) in PROFILES.items()], "type string, min_numeric double, max_special double, word_len array<int>"),
        "field_weights": table([(t, f, w) for t, ws in FIELD_WEIGHTS.items() for f, w in ws.items()] + [(m.name, f, w) for m in more for f, w in m.weights.items()], "type string, field_name string, weight double"),
        "required_fields": table([(t, f) for t, fs in REQUIRED.items() for f in fs] + [(m.name, f) for m in more for f in m.required], "type string, field_name string"),
        "priority_fields": table([(t, f) for t, fs in PRIORITY.items() for f in fs], "type string, field_name string"),
        "score_weights": table(list(SCORE_WEIGHTS.items()), "component string, weight double"),
        "thresholds": table([(k, float(v)) for k, v in (THRESHOLDS | QUALITY).items()], "name string, value double"),
    }


def load_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables from a YAML configuration in any store Spark reads: anchors, profiles, score_weights, thresholds."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    cfg = yaml.safe_load(text)
    anchors = [(t, a, kind == "required", float(c.get("threshold", ANCHOR_THRESHOLD))) for t, c in cfg.get("anchors", {}).items() for kind in ("required", "optional") for a in c.get(kind, [])]
    profiles = [(t, float(c.get("min_numeric_ratio", 0.0)), float(c.get("max_special_char_ratio", 1.0)), c.get("avg_word_length_range")) for t, c in cfg.get("distribution", {}).items()]
    numbers = [(k, float(v)) for part in ("quality", "decision") for k, v in cfg.get(part, {}).items() if isinstance(v, int | float) and not isinstance(v, bool)]
    return {
        "anchors": spark.createDataFrame(anchors, "type string, anchor string, required boolean, threshold double"),
        "profiles": spark.createDataFrame(profiles, "type string, min_numeric double, max_special double, word_len array<int>"),
        "score_weights": spark.createDataFrame([(k, float(v)) for k, v in cfg.get("scoring", {}).get("weights", {}).items()], "component string, weight double"),
        "thresholds": spark.createDataFrame(numbers, "name string, value double"),
    }
