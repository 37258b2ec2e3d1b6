"""Word lists, class rules and constants.

FIXED VALUES: the lists below must stay exactly as written (same words, same
order) because the class rules are first-match-wins and the scores count how
many of these terms occur. They are plain data; every operator also accepts
its own lexicon as a parameter.
"""

from __future__ import annotations

# --- FIXED VALUES: keyword extraction ------------------------------------
STOP_WORDS = ["the", "is", "at", "which", "on", "a", "an", "and", "or",
              "but", "in", "with", "to", "for", "of", "as", "by", "from"]
KEYWORD_MIN_LEN = 4          # words of length <= 3 are dropped
KEYWORD_TOP_K = 10

# --- FIXED VALUES: section classes (first match wins, in this order) ------
SECTION_CLASSES = [
    ("safety", ["warning", "caution", "danger", "hazard", "safety", "emergency"]),
    ("procedure", ["procedure", "step", "process", "method", "operation"]),
    ("specification", ["specification", "requirement", "parameter", "tolerance", "standard"]),
    ("maintenance", ["maintenance", "service", "repair", "inspection", "calibration"]),
    ("quality_control", ["quality", "control", "test", "measurement", "defect", "inspection"]),
    ("equipment", ["equipment", "machine", "tool", "instrument", "device"]),
]

# --- FIXED VALUES: document type classes (first match wins) ---------------
DOCUMENT_TYPE_CLASSES = [
    ("procedure", ["procedure", "process", "method", "step-by-step"]),
    ("specification", ["specification", "spec", "requirement", "standard"]),
    ("manual", ["manual", "guide", "handbook", "instruction"]),
    ("safety", ["safety", "hazard", "warning", "emergency"]),
    ("maintenance", ["maintenance", "service", "repair", "pm"]),
    ("quality", ["quality", "qc", "inspection", "test"]),
]

# --- FIXED VALUES: equipment classes (first match wins) -------------------
EQUIPMENT_CLASSES = [
    ("ion_implanter", ["ion implanter", "implanter", "ion implantation"]),
    ("cvd", ["cvd", "chemical vapor deposition", "deposition"]),
    ("etcher", ["etcher", "etch", "etching", "plasma etch"]),
    ("lithography", ["lithography", "stepper", "scanner", "photolithography"]),
    ("metrology", ["metrology", "measurement", "inspection", "sem", "microscope"]),
    ("cmp", ["cmp", "chemical mechanical", "polishing", "planarization"]),
]

# --- FIXED VALUES: safety levels -----------------------------------------
SAFETY_HIGH = ["danger", "toxic", "hazardous", "emergency", "explosion", "fire"]
SAFETY_MEDIUM = ["warning", "caution", "hot", "electrical", "chemical"]
SAFETY_CLASSES = [("high", SAFETY_HIGH), ("medium", SAFETY_MEDIUM)]
SAFETY_DEFAULT = "low"

# --- FIXED VALUES: process categories (first match wins) ------------------
PROCESS_CLASSES = [
    ("frontend", ["photolithography", "etch", "deposition", "implant", "diffusion"]),
    ("backend", ["metallization", "packaging", "assembly", "wire bond"]),
    ("test", ["test", "probe", "burn-in", "final test", "validation"]),
    ("quality", ["inspection", "metrology", "defect", "yield", "quality"]),
]

# --- FIXED VALUES: technical complexity indicators (count, capped at 10) --
TECHNICAL_INDICATORS = [
    "specification", "parameter", "tolerance", "measurement", "calibration",
    "procedure", "process", "method", "algorithm", "formula", "equation",
    "temperature", "pressure", "flow", "voltage", "current", "frequency",
]
COMPLEXITY_CAP = 10

# --- FIXED VALUES: tag terms (kept in this order) --------------------------
TAG_TERMS = [
    "wafer", "semiconductor", "silicon", "photoresist", "plasma", "vacuum",
    "temperature", "pressure", "flow rate", "voltage", "current", "frequency",
    "thickness", "uniformity", "defect", "yield", "throughput", "cycle time",
]

# --- FIXED VALUES: diagram indicators ------------------------------------
DIAGRAM_INDICATORS = [
    "figure", "diagram", "chart", "graph", "image", "illustration",
    "see figure", "refer to", "shown in", "table",
]

# --- FIXED VALUES: content quality score ---------------------------------
QUALITY_TECH_TERMS = [
    "procedure", "specification", "requirement", "standard",
    "measurement", "tolerance", "quality", "control", "safety",
    "temperature", "pressure", "voltage", "current",
]
QUALITY_STRUCTURE_MARKERS = ["step", ":", ";", "note:", "warning:", "caution:"]

# Older capped quality variant: any of these terms gives x1.2.
QUALITY_CAPPED_TERMS = ["procedure", "specification", "requirement", "standard",
                        "measurement", "tolerance", "quality", "control"]

# --- FIXED VALUES: boundary chunker sizes by document type -----------------
BOUNDARY_SIZES = [
    ("procedure", 800, 150), ("manual", 800, 150),
    ("specification", 1200, 200), ("standard", 1200, 200),
]
BOUNDARY_DEFAULT = (1000, 200)
BOUNDARY_MIN_CHARS = 100     # chunks of <= 100 chars are dropped

# --- FIXED VALUES: priority separators for the separator chunker -----------
SEPARATORS = ["\n## ", "\nStep ", "\nWARNING:", "\nCAUTION:", "\nNOTE:",
              "\nPROCEDURE:", "\nSPECIFICATION:", "\n\n", "\n", ". ", ", "]

# --- FIXED VALUES: documents with less content yield no chunks ------------
MIN_DOCUMENT_CHARS = 50

# --- FIXED VALUES: external corpus filter keywords ---------------------------
CORPUS_KEYWORDS = ["manufacturing", "industrial", "production", "quality control",
                   "equipment", "maintenance", "process", "semiconductor",
                   "automotive", "aerospace", "safety", "procedure"]

# --- FIXED VALUES: name/head document classes --------------------------------
# (class, term looked for in the file name, term looked for in the first
# NAME_HEAD_CHARS characters of the text)
NAME_HEAD_CLASSES = [
    ("maintenance_manual", "maintenance", "maintenance"),
    ("quality_report", "quality", "inspection"),
    ("process_specification", "process", "specification"),
    ("safety_protocol", "safety", "safety"),
]
NAME_HEAD_DEFAULT = "general_document"
NAME_HEAD_CHARS = 500

# --- FIXED VALUES: hybrid search weights -----------------------------------
HYBRID_ALPHA = 0.7
HYBRID_KEYWORD_WEIGHT = 0.5
HYBRID_IMPORTANCE_WEIGHT = 0.2
SEMANTIC_THRESHOLD = 0.3

# --- FIXED VALUES: BM25 parameters ------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75

# --- Fixture lexicon: words that actually occur in the test corpus ---------
# (the default lists above almost never fire on the synthetic text, so the
# SQL-checked queries also run the same operators with this list)
FIXTURE_TERMS = ["that", "with", "this", "from", "tion", "ment", "test"]
FIXTURE_CLASSES = [("c_that", ["that"]), ("c_with", ["with"]),
                   ("c_tion", ["tion"]), ("c_ment", ["ment"])]

# --- FIXED VALUES: technical-content indicators of the dataset check --------
DATASET_QUALITY_TERMS = ["procedure", "specification", "safety", "maintenance", "quality", "control"]

# --- FIXED VALUES: evaluation word lists ------------------------------------
SAFETY_RESULT_KEYWORDS = ["warning", "caution", "danger", "emergency", "safety", "hazard"]
MULTIMODAL_TEXT_INDICATORS = ["table", "figure", "chart", "diagram", "image", "see below", "above"]
SAFETY_DENSITY_INDICATORS = ["warning", "caution", "danger", "ppe", "protective equipment",
                             "emergency", "shutdown", "evacuation", "hazard", "toxic",
                             "safety", "protocol", "procedure"]
SAFETY_DENSITY_MARKERS = ["safety procedure", "warning", "caution"]
ANSWER_TERM_GROUPS = [["daily"], ["weekly"], ["monthly"],
                      ["vacuum", "temperature", "particle", "calibrat"]]
FACILITY_WORDS = ["facility", "site"]

# --- FIXED VALUES: grade bands ------------------------------------------------
IMPROVEMENT_GRADES = [(50, "A+"), (30, "A"), (20, "B+"), (10, "B"), (0, "C")]   # else D
SCORE_GRADES = [(90, "A+"), (85, "A"), (80, "B+"), (75, "B"), (70, "C+"), (65, "C")]  # else D

# --- FIXED VALUES: targets and alert thresholds (metric, op, threshold, message)
TARGET_RULES = [
    ("avg_latency_ms", ">", 500.0, "average latency above target"),
    ("p95_latency_ms", ">", 1000.0, "p95 latency above target"),
    ("f1_score", "<", 0.85, "F1 below target"),
    ("precision", "<", 0.8, "precision below target"),
    ("recall", "<", 0.8, "recall below target"),
    ("max_latency_ms", ">", 2000.0, "query latency alert"),
    ("error_rate", ">", 0.05, "error rate alert"),
]

# --- FIXED VALUES: baseline metrics of the comparison ------------------------
BASELINE_METRICS = [("avg_query_latency_ms", 500.0), ("p95_query_latency_ms", 1200.0),
                    ("throughput_qps", 10.0), ("accuracy_f1_score", 0.76), ("cost_per_1k_queries", 1.0)]

# --- FIXED VALUES: validation query templates per document type ---------------
QUERY_TEMPLATES = [
    ("maintenance_manual", ["daily maintenance procedure for equipment", "weekly maintenance checklist",
                            "equipment calibration procedure"]),
    ("procedure", ["standard operating procedure", "step by step process guide", "quality control procedure"]),
    ("safety_guide", ["safety procedures and protocols", "emergency response procedures",
                      "personal protective equipment requirements"]),
    ("quality_manual", ["quality management system", "inspection procedures and requirements",
                        "statistical process control methods"]),
    ("specification", ["technical specifications and requirements", "process parameters and settings",
                       "measurement and testing procedures"]),
]
GENERAL_QUERIES = ["equipment maintenance and service", "quality control and inspection",
                   "safety protocols and procedures"]

# --- FIXED VALUES: post-migration validation thresholds ----------------------
COUNT_VARIANCE_MAX = 0.2
CHUNKS_PER_DOCUMENT_ESTIMATE = 2.5
SEARCH_MIN_RESULTS, SEARCH_MIN_SIMILARITY, SEARCH_MIN_QUALITY = 1, 0.6, 0.7
LATENCY_AVG_MAX_MS, LATENCY_MAX_MS = 1000.0, 2000.0
INTEGRITY_TYPE_COVERAGE, INTEGRITY_MIN_QUALITY, INTEGRITY_PASS_SHARE = 0.8, 0.7, 0.8
WAVE_MIN_SUCCESS = 0.8
SYSTEM_SIMILARITY_ISSUE, SYSTEM_SIMILARITY_ADVICE = 0.7, 0.8

# --- FIXED VALUES: the labelled evaluation queries ----------------------------
# (category, query, expected document types, complexity, expected keywords)
LABELLED_QUERIES = [
    ("equipment_maintenance", "daily maintenance procedure for ion implanter equipment",
     ["maintenance_manual", "procedure"], "medium", ["ion implanter", "maintenance", "daily"]),
    ("equipment_maintenance", "weekly calibration schedule for metrology tools",
     ["maintenance_manual", "procedure"], "medium", ["calibration", "metrology", "weekly"]),
    ("equipment_maintenance", "preventive maintenance checklist for CVD equipment",
     ["maintenance_manual", "checklist"], "medium", ["preventive", "maintenance", "cvd"]),
    ("safety_procedures", "emergency shutdown procedure for chemical vapor deposition",
     ["safety_guide", "procedure"], "high", ["emergency", "shutdown", "cvd"]),
    ("safety_procedures", "personal protective equipment requirements for clean room",
     ["safety_guide", "specification"], "medium", ["ppe", "clean room", "protective"]),
    ("safety_procedures", "lockout tagout procedures for equipment maintenance",
     ["safety_guide", "procedure"], "high", ["lockout", "tagout", "maintenance"]),
    ("quality_control", "statistical process control methods for manufacturing",
     ["quality_manual", "procedure"], "high", ["statistical", "process control", "manufacturing"]),
    ("quality_control", "defect classification system for wafer inspection",
     ["quality_manual", "specification"], "high", ["defect", "classification", "wafer", "inspection"]),
    ("quality_control", "measurement uncertainty analysis for critical dimensions",
     ["quality_manual", "procedure"], "very_high", ["measurement", "uncertainty", "critical dimensions"]),
    ("process_specifications", "photolithography process parameters for 7nm technology",
     ["specification", "process_guide"], "very_high", ["photolithography", "parameters", "7nm"]),
    ("process_specifications", "ion implantation energy levels for boron doping",
     ["specification", "process_guide"], "high", ["ion implantation", "energy", "boron", "doping"]),
    ("process_specifications", "chemical mechanical planarization slurry composition",
     ["specification", "process_guide"], "high", ["cmp", "slurry", "composition"]),
]

# Expected type names of the labelled set -> the classes the classifier
# produces (the two vocabularies never meet otherwise).
TYPE_ALIASES = {"maintenance_manual": "maintenance", "safety_guide": "safety",
                "quality_manual": "quality", "process_guide": "procedure"}
