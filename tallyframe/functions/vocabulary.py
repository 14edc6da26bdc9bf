"""Fixed vocabularies, thresholds and patterns of the statistics domain."""

from __future__ import annotations

# The thirteen districts that facts may name.
DISTRICTS = ["Anantapur", "Chittoor", "East Godavari", "Guntur", "Kadapa", "Krishna", "Kurnool", "Nellore", "Prakasam", "Srikakulam", "Visakhapatnam", "Vizianagaram", "West Godavari"]

# Spellings of districts, in the order in which they are tried.
DISTRICT_SPELLINGS = {
    "Anantapur": ["anantapur", "ananthpur", "anantpur"],
    "Chittoor": ["chittoor", "chitoor", "chitor"],
    "East Godavari": ["east godavari", "eastgodavari", "e.godavari", "e godavari"],
    "Guntur": ["guntur", "guntoor"],
    "Krishna": ["krishna", "kistna"],
    "Kurnool": ["kurnool", "kurnol"],
    "Nellore": ["nellore", "nelor"],
    "Prakasam": ["prakasam", "prakash"],
    "Srikakulam": ["srikakulam", "srikakula"],
    "Visakhapatnam": ["visakhapatnam", "vishakhapatnam", "vizag", "visag"],
    "Vizianagaram": ["vizianagaram", "vijayanagaram"],
    "West Godavari": ["west godavari", "westgodavari", "w.godavari", "w godavari"],
    "Kadapa": ["kadapa", "cuddapah", "cudapa"],
}

# Words that name indicators, in the order in which they are tried.
INDICATOR_SPELLINGS = {
    "Enrollment": ["enrollment", "enrolment", "enrolled"],
    "Applications": ["applications", "applicants", "applied"],
    "Schools": ["schools", "institutions", "school"],
    "Teachers": ["teachers", "faculty", "staff"],
    "Students": ["students", "pupils", "children"],
    "Dropout Rate": ["dropout", "dropouts"],
    "GER": ["ger", "gross enrollment ratio", "gross enrolment ratio"],
    "NER": ["ner", "net enrollment ratio", "net enrolment ratio"],
    "PTR": ["ptr", "pupil teacher ratio", "student teacher ratio"],
    "Literacy Rate": ["literacy", "literate"],
    "Pass Rate": ["pass rate", "passing rate"],
    "Examination Results": ["examination", "exam"],
    "Budget Allocation": ["budget", "funds"],
    "Infrastructure": ["infrastructure", "facilities"],
}

# What a validated indicator's values may be.
RANGES = [
    ("Total Enrollment", 1.0, 500000.0, "count"),
    ("Boys Enrollment", 1.0, 250000.0, "count"),
    ("Girls Enrollment", 1.0, 250000.0, "count"),
    ("Primary Enrollment", 1.0, 300000.0, "count"),
    ("Upper Primary Enrollment", 1.0, 200000.0, "count"),
    ("Secondary Enrollment", 1.0, 150000.0, "count"),
    ("Higher Secondary Enrollment", 1.0, 100000.0, "count"),
    ("Gross Enrollment Ratio", 0.0, 150.0, "%"),
    ("Net Enrollment Ratio", 0.0, 100.0, "%"),
    ("Gender Parity Index", 0.5, 1.5, "ratio"),
    ("Dropout Rate", 0.0, 50.0, "%"),
    ("Retention Rate", 50.0, 100.0, "%"),
    ("Transition Rate", 70.0, 100.0, "%"),
    ("Number of Schools", 10.0, 10000.0, "count"),
    ("Number of Teachers", 50.0, 50000.0, "count"),
    ("Pupil Teacher Ratio", 10.0, 100.0, "ratio"),
    ("Number of Classrooms", 100.0, 100000.0, "count"),
    ("Toilet Facilities", 0.0, 100.0, "%"),
    ("Drinking Water Facilities", 0.0, 100.0, "%"),
    ("Electricity Connection", 0.0, 100.0, "%"),
    ("Computer Facilities", 0.0, 100.0, "%"),
    ("Library Facilities", 0.0, 100.0, "%"),
]

# Rules of the validator with what each takes from a fact's confidence.
RULES = ["DIST_001", "IND_001", "VAL_001", "YEAR_001", "UNIT_001", "STAT_001", "CONS_001", "TEMP_001"]
FIRST_YEAR, Z_LIMIT, IQR_FACTOR, GROWTH_LIMIT = 2010, 3.0, 1.5, 0.5

# First match wins, in this order ("male" stands before "female" and "sc" is in "school").
CATEGORY_SPELLINGS = {
    "SC": ["sc", "scheduled caste", "scheduled castes"],
    "ST": ["st", "scheduled tribe", "scheduled tribes"],
    "OBC": ["obc", "other backward class", "other backward classes"],
    "General": ["general", "open"],
    "Boys": ["boys", "male", "men"],
    "Girls": ["girls", "female", "women"],
    "Rural": ["rural", "village", "villages"],
    "Urban": ["urban", "city", "cities", "town"],
}
UNIT_SPELLINGS = [
    ("percent", "percentage"), ("%", "percentage"), ("percentage", "percentage"), ("ratio", "ratio"), ("rate", "rate"), ("count", "count"), ("number", "count"), ("total", "count"),
    ("lakh", "lakh"), ("lakhs", "lakh"), ("crore", "crore"), ("crores", "crore"), ("rupees", "rupees"), ("rs", "rupees"), ("inr", "rupees"),
]
CATEGORY_FIRST = [("boys", "male"), ("girls", "female"), ("male", "male"), ("female", "female"), ("rural", "rural"), ("urban", "urban"), ("government", "government"), ("private", "private"), ("aided", "aided"), ("unaided", "unaided"), ("total", "total"), ("all", "total")]

# Kinds of questions and the phrases that tell them, in order.
QUESTION_PHRASES = {
    "statistical": ["how many", "what is the number", "statistics", "data", "count", "percentage", "enrollment", "dropout rate", "ger", "ner", "ptr", "schools count", "teachers"],
    "comparative": ["compare", "versus", "vs", "difference between", "better than", "higher", "district comparison", "performance gap", "ranking"],
    "temporal": ["trend", "over time", "increase", "decrease", "year over year", "growth", "improvement", "decline", "change since", "progression"],
    "policy_lookup": ["policy", "order", "circular", "notification", "rule", "regulation", "government order", "go", "amendment", "revision"],
    "complex": ["why", "how", "what factors", "analyze", "impact", "correlation", "relationship between", "causes", "effects"],
}
INTENTS = [
    ("find", ["find", "get", "show", "what is"]),
    ("compare", ["compare", "versus", "vs", "difference"]),
    ("analyze", ["analyze", "why", "how", "impact"]),
    ("trend", ["trend", "change", "growth", "over time"]),
    ("summarize", ["summary", "summarize", "overview"]),
]

# The strengths a bridge edge must reach, by type.
EDGE_THRESHOLDS = {"district_year": 0.8, "indicator_temporal": 0.7, "policy_hierarchy": 0.6, "cross_district": 0.5}

# What questions name, in order, and the words of comparison and of time.
NAMED_DISTRICTS = ["anantapur", "chittoor", "east godavari", "guntur", "krishna", "kurnool", "nellore", "prakasam", "srikakulam", "visakhapatnam", "vizianagaram", "west godavari", "kadapa"]
NAMED_INDICATORS = ["enrollment", "enrolment", "ger", "ner", "ptr", "dropout", "literacy", "schools", "teachers", "students", "infrastructure", "applications"]
SOUGHT_INDICATORS = ["enrollment", "schools", "teachers", "students", "infrastructure", "budget", "dropout", "attendance", "performance", "literacy", "facilities", "classrooms", "libraries", "laboratories", "toilets"]
COMPARISON_WORDS = ["compare", "versus", "vs", "difference", "between", "among"]
TIME_WORDS = ["trend", "over time", "change", "growth", "decline", "increase", "decrease"]
METHODS = [("bridge", ["compare", "versus", "vs", "difference"]), ("advanced", ["why", "how", "explain", "analyze"]), ("graph", ["trend", "over time", "years", "timeline"])]
POLICY_ROUTES = [
    ("legal_lookup", ["which act", "which rule", "which go", "legal", "law"]),
    ("data_lookup", ["statistics", "data", "how many", "enrollment", "dropout"]),
    ("comparison", ["compare", "difference", "versus", "vs"]),
    ("temporal_analysis", ["trend", "over time", "change", "growth"]),
]
HEDGES = ["may", "might", "could", "possibly", "likely", "appears to", "seems to", "suggests", "indicates", "according to", "as per"]
GENERIC_CLAIMS = ["it is well known that", "studies show that", "research indicates", "experts agree", "it is generally accepted", "common knowledge"]
