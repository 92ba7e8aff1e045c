"""Controlled vocabularies and limits shared by the jobs (fixed values)."""

SIGNIFICANCE = {"none": 0, "minimal": 1, "moderate": 2, "significant": 3}
MITIGATION = ("avoidance", "minimization", "compensatory")
REVIEW_BELOW = 0.6
SCORED_CATEGORIES = ("wetlands", "air_quality", "noise", "traffic", "environmental_justice", "endangered_species", "floodplain", "prime_farmland")
DOCUMENT_TYPES = ("cfr_regulation", "statute", "executive_order", "state_code")
STATUSES = ("pending", "embedding", "ready", "failed")
MIN_TOKENS, MAX_TOKENS, TARGET_TOKENS, OVERLAP_TOKENS = 200, 1500, 700, 90
SCORE_WEIGHTS = (0.4, 0.4, 0.2)
UPLOAD_LIMIT = 25 * 1024 * 1024
AGENTS = ("project_parser", "environmental_data", "regulatory_screening", "impact_analysis", "report_synthesis")

#: Words that carry no meaning in a category's name.
CATEGORY_STOPWORDS = ("and", "or", "the", "of", "a", "an", "impact", "impacts", "resource", "resources", "environmental", "section", "assessment")
#: Environmental layers in report order, and the category that a non-empty one implies.
LAYER_CATEGORIES = (
    ("usfws_species", "endangered_species"),
    ("nwi_wetlands", "wetlands"),
    ("fema_flood_zones", "floodplain"),
    ("usda_farmland", "prime_farmland"),
    ("ejscreen", "environmental_justice"),
    ("usgs_seismic", "seismic_hazard"),
    ("epa_aqs", "air_quality"),
    ("noaa_climate", "climate_conditions"),
)
#: Words that stay in lower case inside a title.
MINOR_WORDS = ("and", "of", "to", "the", "for", "in", "on", "or", "a", "an")
#: Group headings of the state code that are no body text.
KNOWN_GROUPS = (
    "GENERAL",
    "GENERAL PROVISIONS",
    "PERMIT APPLICATIONS",
    "PERMIT ISSUANCE, TRANSFER AND REVOCATION",
    "SUBMERGED LANDS OF THE COMMONWEALTH\u2014LICENSES AND ANNUAL CHARGES",
    "CONSTRUCTION REQUIREMENTS AND PROCEDURES",
    "OPERATION, MAINTENANCE AND INSPECTION",
    "INVESTIGATION AND CORRECTION OF UNSAFE CONDITIONS\u2014EMERGENCY PROCEDURES",
    "PERMITS",
    "PERMITS, LETTERS OF AMENDMENTS AND LETTERS OF AUTHORIZATIONS",
    "CLASSIFICATION AND DESIGN CRITERIA FOR APPROVAL OF CONSTRUCTION, OPERATION, MODIFICATION AND MAINTENANCE",
    "STORAGE AND DISCHARGE",
    "PROTECTION AND RESTORATION OF AQUATIC LIFE",
    "OPERATION, MAINTENANCE AND EMERGENCIES",
    "CRITERIA FOR APPROVAL OF CONSTRUCTION OR MODIFICATION",
    "CRITERIA FOR APPROVAL FOR CONSTRUCTION OR MODIFICATION",
    "MAINTENANCE",
    "CONSTRUCTION AND MAINTENANCE",
    "WETLANDS",
    "GENERAL PERMITS",
)
#: Bold page furniture of the federal print that is no heading.
NOISE_PHRASES = (
    "Council on Environmental Quality",
    "Executive Office of the President",
    "REGULATIONS",
    "For Implementing The Procedural Provisions Of The",
    "NATIONAL",
    "ENVIRONMENTAL",
    "POLICY ACT",
    "Reprint",
    "40 CFR Parts 1500-1508",
    "(2005)",
    "Source:",
    "NEPAnet:",
)
