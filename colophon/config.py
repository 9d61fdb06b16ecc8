"""Operator parameters, and the values that results depend on."""

from dataclasses import dataclass

# They must equal what existing users' data hold.
READY, LOW_RESOLUTION, LOW_QUALITY, DUPLICATE = "READY", "LOW_RESOLUTION", "LOW_QUALITY", "DUPLICATE"
NEEDS_RELEASE, REVIEW, ERROR, ERROR_PERMANENT = "NEEDS_RELEASE", "REVIEW", "ERROR", "ERROR_PERMANENT"
STATUSES = [READY, LOW_RESOLUTION, LOW_QUALITY, DUPLICATE, NEEDS_RELEASE, REVIEW, ERROR, ERROR_PERMANENT]
DESTINATIONS = {
    "READY": "01_READY_UPLOAD",
    "LOW_RESOLUTION": "02_SKIPPED_LOWRES",
    "LOW_QUALITY": "03_SKIPPED_LOWQUALITY",
    "DUPLICATE": "04_DUPLICATES",
    "NEEDS_RELEASE": "05_NEEDS_RELEASE",
    "REVIEW": "06_REVIEW",
}
ORIGINALS, REPORTS = "00_SOURCE_ORIGINALS", "Reports"
CATEGORIES = [
    "Abstract", "Animals/Wildlife", "The Arts", "Backgrounds/Textures", "Beauty/Fashion", "Buildings/Landmarks", "Business/Finance",
    "Celebrities", "Education", "Food and Drink", "Healthcare/Medical", "Holidays", "Industrial", "Interiors", "Miscellaneous", "Nature",
    "Objects", "Parks/Outdoor", "People", "Religion", "Science", "Signs/Symbols", "Sports/Recreation", "Technology", "Transportation", "Vintage",
]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".tif", ".tiff"]
RESPONSE_KEYS = ["title", "description", "keywords", "category", "commercial_score", "rejection_risk"]


REPORT_COLUMNS = [
    "original_name", "final_name", "status", "score", "risk", "category", "category2", "title", "destination", "reason",
    "people_visible", "property_or_trademark_visible", "watermark_or_overlay_visible", "keyword_count",
]
UPLOAD_COLUMNS = ["Filename", "Description", "Keywords", "Categories"]
SUMMARY_COLUMNS = [
    "version", "model", "processed_this_run", "ready_to_upload", "low_res", "low_quality", "duplicates", "needs_release", "review", "errors",
    "remaining", "folder", "duration_seconds", "average_commercial_score", "average_keyword_count", "category_distribution", "api_retries",
    "api_hard_failures", "low_risk_ready_ratio_percent", "stopped_on_daily_quota",
]
#: What an annotation holds; the last five fields may be left out.
RESPONSE = (
    "title string, description string, keywords array<string>, category string, commercial_score int, rejection_risk string, "
    "category2 string, rejection_reason string, people_visible boolean, property_or_trademark_visible boolean, watermark_or_overlay_visible boolean"
)
# What a server's message says, in lower case, of the kind of its error, the first kind first; a limit that names the day is a quota.
ERROR_MARKS = {"rate_limit": ["resource_exhausted", " 429"], "overload": ["503", "unavailable", "overloaded"]}
QUOTA_MARK = "perday"
# Seconds before the next call: the first wait, whether later ones add it or double, the longest, and what chance adds at most.
WAITS = {"rate_limit": (15.0, "add", None, 3.0), "overload": (10.0, "double", 90.0, 5.0), "generic": (3.0, "add", None, 0.0)}
# Where a message names a delay in seconds: behind which word, what may stand between, and the form of the number.
DELAYS = [("retry in ", "", "[0-9.]+"), ("retrydelay", "['\"]?\\s*:\\s*['\"]?", "[0-9]+(?:[.][0-9]+)?")]
# End of the fixed values.

#: What a provider is asked for, in our words; a provider may use another text that asks for the same fields.
CONTRACT = f"""Describe this picture for a stock library. Answer with one JSON object and nothing else.
Fields: {RESPONSE}.
title: 8 to 18 words. description: under 180 characters. keywords: 40 to 50, the most important first.
category and category2: one each of: {", ".join(CATEGORIES)}.
commercial_score: 0 to 100, of which technical quality gives 30, demand 25, composition 25 and freedom from risk 20.
rejection_risk: Low, Medium or High; rejection_reason: why, if it is not Low.
people_visible: a person that could be recognised. property_or_trademark_visible: private property, brands or logos.
watermark_or_overlay_visible: any text, stamp or mark that was put over the picture, however small."""


@dataclass(frozen=True)
class Settings:
    # The defaults that existing users' results rest on.
    batch_limit: int = 50
    min_score: int = 60
    min_megapixels: float = 4.0
    max_file_mb: int = 50
    max_attempts: int = 3
    call_attempts: int = 5
    hash_threshold: int = 6
    max_keywords: int = 50
    slug_length: int = 80
    pause_seconds: float = 4.0
    max_side: int = 1024
    #: Near duplicates are looked for in this run (as existing users know it) or in all runs so far: run or all.
    near_scope: str = "run"
    version: str = "1.0"
    model: str = "none"
