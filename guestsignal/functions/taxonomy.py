"""The aspect taxonomy, the profile rules and a default word-list labeller.

Rules and lexicon are arguments of the operators; these are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

GENERAL = "general"

# Aspect keys in taxonomy order and their display names (output contract).
DISPLAY_NAMES = {
    "cleanliness": "Cleanliness",
    "service": "Service",
    "luxury": "Luxury & refinement",
    "value": "Value for money",
    "location_central": "Central location",
    "local_culture": "Local culture",
    "safety": "Safety",
    "quietness": "Quietness",
    "nightlife": "Nightlife",
    "family_friendly": "Family-friendly",
    "business_facilities": "Business & WiFi",
    "wellness_spa": "Spa & wellness",
    "beach_access": "Beach access",
    "food_dining": "Food & dining",
    "accessibility": "Accessibility",
}
ASPECT_KEYS = tuple(DISPLAY_NAMES)

# Trigger patterns per aspect, matched against the lower-cased profile text.
# Their order decides between aspects of equal weight.
DIMENSION_PATTERNS = {
    "safety": r"safe|safety|secur|felt (?:very )?safe|sketchy|uncomfortable",
    "local_culture": r"local culture|markets|authentic|neighbou?rhood|local dining|real culture",
    "location_central": r"central|walkable|heart of the city|near the office|minimize travel|walking distance",
    "business_facilities": r"wifi|wi-fi|internet|remote work|meeting|conference|desk|video call|business",
    "quietness": r"quiet|peaceful|restful|calls|focus|soundproof|noise",
    "wellness_spa": r"\bspa\b|wellness|sauna|massage|retreat|unwind|self-care",
    "family_friendly": r"famil|toddler|kids|children|connecting rooms|pool|high chair",
    "value": r"\bvalue\b|cheap|affordable|shoestring|tight budget|splitting costs|save money|bang for|budget backpacker",
    "nightlife": r"nightlife|bars|clubs|social scene|night out|lively",
    "luxury": r"luxur|five-star|5-star|refinement|impeccable|premium|world-class|discerning|high-end|no object",
    "food_dining": r"food|dining|restaurant|culinary|foodie|cuisine|breakfast|\beat\b|eateries|dine",
    "beach_access": r"beach|seaside|beachfront|shore|sun-seeker|\bsea\b",
    "accessibility": r"accessib|wheelchair|step-free|mobility|ramp|reduced mobility",
    "cleanliness": r"clean|spotless|spotless cleanliness|immaculate|hygiene|tidy",
    "service": r"attentive|personal service|helpful staff|attentive staff|warm service|impeccable service",
}

# First match wins, in this order.
TRAVELER_PATTERNS = (
    ("family", r"famil|toddler|kids|children|parents"),
    ("couple", r"couple|honeymoon|romantic|getaway"),
    ("group", r"group|friends|bachelor|bachelorette|splitting costs"),
    ("business", r"business|corporate|road-warrior|expense-account|office"),
    ("solo", r"solo|alone|traveling alone|independent|backpacker|freelancer|nomad|remote worker"),
)
DEFAULT_TRAVELER = "leisure"
BUDGET_PATTERNS = (
    ("high", r"budget is no object|no object|higher budget|high-end|luxury|five-star|premium|world-class"),
    ("mid_high", r"mid-to-high|upper budget|mid-range to upper|happy with a higher budget"),
    ("tight", r"tight budget|shoestring|budget backpacker|value is everything|cheap|save money"),
    ("mid", r"mid-range|expense-account|good value|mid-to-high budget"),
)
DEFAULT_BUDGET = "mid"
FEMALE_PATTERN = r"(?i)\bfemale\b|\bwoman\b|\bher\b"

# How well a star category fits a budget band.
CATEGORY_FIT = {
    "tight": {"3-star": 1.0, "4-star": 0.4, "5-star": -0.4},
    "mid": {"3-star": 0.6, "4-star": 1.0, "5-star": 0.5},
    "mid_high": {"3-star": 0.1, "4-star": 1.0, "5-star": 0.8},
    "high": {"3-star": -0.4, "4-star": 0.6, "5-star": 1.0},
}

# The theme a dimension adds to an archetype slug.
ARCHETYPE_THEMES = {
    "local_culture": "culture",
    "wellness_spa": "wellness",
    "business_facilities": "business",
    "beach_access": "beach",
    "nightlife": "nightlife",
    "luxury": "luxury",
    "family_friendly": "family",
    "food_dining": "foodie",
    "accessibility": "accessible",
    "value": "budget",
    "safety": "safety",
    "location_central": "central",
}
FEMALE_TRAVELER = "solo"
MAX_ARCHETYPE_PARTS = 3


@dataclass(frozen=True)
class ProfileRules:
    dimensions: dict[str, str]
    travelers: tuple[tuple[str, str], ...]
    budgets: tuple[tuple[str, str], ...]
    category_fit: dict[str, dict[str, float]]
    themes: dict[str, str]
    default_traveler: str = DEFAULT_TRAVELER
    default_budget: str = DEFAULT_BUDGET
    female_pattern: str = FEMALE_PATTERN
    female_traveler: str = FEMALE_TRAVELER


DEFAULT_RULES = ProfileRules(
    dimensions=DIMENSION_PATTERNS,
    travelers=TRAVELER_PATTERNS,
    budgets=BUDGET_PATTERNS,
    category_fit=CATEGORY_FIT,
    themes=ARCHETYPE_THEMES,
)


@dataclass(frozen=True)
class Lexicon:
    """Lower-case ASCII words per aspect, and words that carry approval or complaint."""

    aspects: dict[str, tuple[str, ...]]
    positive: tuple[str, ...]
    negative: tuple[str, ...]


# A small starting vocabulary of our own; production labels come from a model through
# the scorer hook or from a maintained lexicon.
DEFAULT_LEXICON = Lexicon(
    aspects={
        "cleanliness": ("clean", "spotless", "dirty", "dusty", "stained", "housekeeping"),
        "service": ("staff", "service", "reception", "concierge", "helpful", "rude"),
        "luxury": ("luxury", "luxurious", "elegant", "refined", "opulent"),
        "value": ("price", "value", "overpriced", "affordable", "bargain"),
        "location_central": ("central", "location", "downtown", "walkable"),
        "local_culture": ("culture", "market", "markets", "authentic", "artisans"),
        "safety": ("safe", "secure", "unsafe", "security"),
        "quietness": ("quiet", "noise", "noisy", "loud", "peaceful"),
        "nightlife": ("nightlife", "bar", "bars", "club", "clubs"),
        "family_friendly": ("family", "kids", "children", "playground"),
        "business_facilities": ("wifi", "desk", "meeting", "conference", "internet"),
        "wellness_spa": ("spa", "sauna", "massage", "wellness"),
        "beach_access": ("beach", "beachfront", "seaside", "shore"),
        "food_dining": ("food", "breakfast", "restaurant", "dinner", "buffet"),
        "accessibility": ("wheelchair", "ramp", "accessible", "lift"),
    },
    positive=("good", "great", "excellent", "wonderful", "perfect", "lovely", "friendly",
              "clean", "spotless", "helpful", "quiet", "safe", "delicious", "amazing"),
    negative=("bad", "poor", "terrible", "awful", "dirty", "rude", "noisy", "loud",
              "unsafe", "overpriced", "broken", "slow", "disappointing", "cold"),
)
