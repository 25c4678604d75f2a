"""Code -> label lookups.

The maps are small fixed literals, so they are compiled into the plan as
``create_map`` expressions: no join, no shuffle, no broadcast to size-check.
"""

from __future__ import annotations

from collections.abc import Mapping
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source project's maps for equal results).
# ---------------------------------------------------------------------------

# Analysis scheme: country code -> region (13 regions + "Unknown" fallback).
COUNTRY_TO_REGION_ANALYSIS = {
    "US": "North America", "CA": "North America", "MX": "North America", "GT": "North America",
    "CU": "North America", "DO": "North America", "PR": "North America", "HN": "North America",
    "SV": "North America", "NI": "North America", "CR": "North America", "PA": "North America",
    "JM": "North America", "GL": "North America", "AG": "North America", "AI": "North America",
    "VG": "North America",
    "BR": "South America", "AR": "South America", "CL": "South America", "CO": "South America",
    "PE": "South America", "VE": "South America", "EC": "South America", "BO": "South America",
    "PY": "South America", "UY": "South America",
    "GB": "Western Europe", "FR": "Western Europe", "DE": "Western Europe", "IT": "Western Europe",
    "ES": "Western Europe", "NL": "Western Europe", "PT": "Western Europe", "IE": "Western Europe",
    "AT": "Western Europe", "BE": "Western Europe", "CH": "Western Europe", "LU": "Western Europe",
    "GI": "Western Europe",
    "SE": "Northern Europe", "NO": "Northern Europe", "DK": "Northern Europe", "FI": "Northern Europe",
    "IS": "Northern Europe",
    "PL": "Eastern Europe", "RO": "Eastern Europe", "HU": "Eastern Europe", "CZ": "Eastern Europe",
    "SK": "Eastern Europe", "BG": "Eastern Europe", "HR": "Eastern Europe", "RS": "Eastern Europe",
    "UA": "Eastern Europe", "RU": "Eastern Europe", "BY": "Eastern Europe", "MD": "Eastern Europe",
    "SI": "Eastern Europe", "BA": "Eastern Europe", "MK": "Eastern Europe", "AL": "Eastern Europe",
    "ME": "Eastern Europe", "LT": "Eastern Europe", "LV": "Eastern Europe", "EE": "Eastern Europe",
    "GR": "Southern Europe", "CY": "Southern Europe", "MT": "Southern Europe",
    "VN": "Southeast Asia", "ID": "Southeast Asia", "TH": "Southeast Asia", "PH": "Southeast Asia",
    "MY": "Southeast Asia", "SG": "Southeast Asia", "KH": "Southeast Asia", "LA": "Southeast Asia",
    "MM": "Southeast Asia",
    "JP": "East Asia", "KR": "East Asia", "CN": "East Asia", "TW": "East Asia", "HK": "East Asia",
    "MN": "East Asia",
    "IN": "South Asia", "PK": "South Asia", "BD": "South Asia", "LK": "South Asia", "NP": "South Asia",
    "KZ": "Central Asia", "UZ": "Central Asia", "AZ": "Central Asia", "GE": "Central Asia",
    "AM": "Central Asia", "AF": "Central Asia",
    "AE": "Middle East", "SA": "Middle East", "IL": "Middle East", "TR": "Middle East",
    "EG": "Middle East", "JO": "Middle East", "LB": "Middle East", "KW": "Middle East",
    "QA": "Middle East", "BH": "Middle East", "OM": "Middle East", "YE": "Middle East",
    "IQ": "Middle East", "IR": "Middle East",
    "ZA": "Africa", "NG": "Africa", "KE": "Africa", "MA": "Africa", "GH": "Africa", "CM": "Africa",
    "TZ": "Africa", "ET": "Africa", "SN": "Africa", "CI": "Africa", "TN": "Africa", "DZ": "Africa",
    "LY": "Africa", "UG": "Africa", "ZW": "Africa", "MZ": "Africa", "AO": "Africa",
    "AU": "Oceania", "NZ": "Oceania", "PG": "Oceania", "NF": "Oceania", "WF": "Oceania",
    "GS": "Oceania", "AQ": "Oceania", "IO": "Oceania",
}

# Analysis scheme: default_language -> region.
LANG_TO_REGION = {
    "vi": "Southeast Asia", "id": "Southeast Asia", "th": "Southeast Asia", "fil": "Southeast Asia",
    "ms": "Southeast Asia", "km": "Southeast Asia",
    "ko": "East Asia", "ja": "East Asia", "zh-Hant": "East Asia",
    "hi": "South Asia", "bn": "South Asia", "en-IN": "South Asia", "ta": "South Asia",
    "te": "South Asia", "ml": "South Asia", "ur": "South Asia",
    "ar": "Middle East", "iw": "Middle East", "tr": "Middle East",
    "ru": "Eastern Europe", "uk": "Eastern Europe", "pl": "Eastern Europe", "ro": "Eastern Europe",
    "hu": "Eastern Europe",
    "de": "Western Europe", "fr": "Western Europe", "it": "Western Europe", "nl": "Western Europe",
    "en-GB": "Western Europe",
    "en-US": "North America",
    "pt-PT": "South America",
}

# Analysis scheme: default_audio_language -> region (language map plus these).
AUDIO_EXTRA = {"en-US": "North America", "en-GB": "Western Europe", "en-IN": "South Asia", "pa": "South Asia"}
AUDIO_TO_REGION = {**LANG_TO_REGION, **AUDIO_EXTRA}

# Serving scheme: country code -> region (11 regions, default "North America", country default "US").
COUNTRY_TO_REGION_SERVING = {
    "US": "North America", "CA": "North America", "MX": "North America",
    "VN": "Southeast Asia", "TH": "Southeast Asia", "ID": "Southeast Asia", "MY": "Southeast Asia",
    "SG": "Southeast Asia", "PH": "Southeast Asia", "KH": "Southeast Asia", "LA": "Southeast Asia",
    "MM": "Southeast Asia",
    "GB": "Western Europe", "DE": "Western Europe", "FR": "Western Europe", "IT": "Western Europe",
    "ES": "Western Europe", "NL": "Western Europe", "BE": "Western Europe", "AT": "Western Europe",
    "CH": "Western Europe", "SE": "Western Europe", "NO": "Western Europe", "DK": "Western Europe",
    "FI": "Western Europe", "PT": "Western Europe", "GR": "Western Europe",
    "RU": "Eastern Europe", "UA": "Eastern Europe", "PL": "Eastern Europe", "CZ": "Eastern Europe",
    "SK": "Eastern Europe", "HU": "Eastern Europe", "RO": "Eastern Europe", "BG": "Eastern Europe",
    "HR": "Eastern Europe", "RS": "Eastern Europe", "BY": "Eastern Europe",
    "CN": "East Asia", "JP": "East Asia", "KR": "East Asia", "TW": "East Asia",
    "IN": "South Asia", "BD": "South Asia", "PK": "South Asia", "NP": "South Asia", "LK": "South Asia",
    "KZ": "Central Asia", "UZ": "Central Asia", "TM": "Central Asia", "KG": "Central Asia",
    "TJ": "Central Asia",
    "SA": "Middle East", "AE": "Middle East", "IR": "Middle East", "IQ": "Middle East",
    "EG": "Middle East", "IL": "Middle East",
    "ZA": "Africa", "NG": "Africa", "KE": "Africa", "GH": "Africa",
    "BR": "South America", "AR": "South America", "CL": "South America", "CO": "South America",
    "PE": "South America",
    "AU": "Oceania", "NZ": "Oceania",
}

# Analysis scheme: category id -> topic (used for the "trending" topic back-fill).
CATEGORY_TOPIC_ANALYSIS = {
    1: "film", 2: "cars", 10: "music", 15: "pets", 17: "sports", 19: "travel", 20: "gaming",
    22: "people", 23: "comedy", 24: "entertainment", 25: "news", 26: "howto", 27: "education",
    28: "science", 29: "nonprofit", 30: "movies", 31: "anime", 32: "action", 33: "classics",
    34: "comedy_movies", 35: "documentary", 36: "drama", 37: "family", 38: "foreign", 39: "horror",
    40: "sci_fi", 41: "thriller", 42: "shorts", 43: "shows", 44: "trailers",
}

# Serving scheme: category id -> category name (default "entertainment").
CATEGORY_NAME_SERVING = {
    1: "film", 2: "autos", 10: "music", 15: "pets", 17: "sports", 18: "short", 19: "travel",
    20: "gaming", 21: "videoblogging", 22: "people", 23: "comedy", 24: "entertainment", 25: "news",
    26: "howto", 27: "education", 28: "science", 29: "technology", 30: "movies", 31: "animation",
    32: "action", 33: "classics", 34: "comedy", 35: "documentary", 36: "drama", 37: "familyfriendly",
    38: "foreign", 39: "horror", 40: "scifi", 41: "thriller", 42: "shorts", 43: "shows",
    44: "trailers", 45: "watches",
}

# Serving scheme: category name -> model topic (default "entertainment").
CATEGORY_TO_MODEL_TOPIC = {
    "film": "entertainment", "autos": "technology", "music": "music", "pets": "animals",
    "sports": "sports", "travel": "travel", "gaming": "gaming", "videoblogging": "vlog",
    "people": "vlog", "comedy": "entertainment", "entertainment": "entertainment",
    "news": "technology", "howto": "education", "education": "education", "science": "education",
    "technology": "technology", "movies": "entertainment", "animation": "entertainment",
    "action": "entertainment", "classics": "entertainment", "documentary": "entertainment",
    "drama": "entertainment", "familyfriendly": "kids", "foreign": "entertainment",
    "horror": "entertainment", "scifi": "entertainment", "thriller": "entertainment",
    "shorts": "entertainment", "shows": "entertainment", "trailers": "entertainment",
}

UNKNOWN = "Unknown"


# ---------------------------------------------------------------------------

def _int_keys(mapping: Mapping) -> bool:
    return all(isinstance(k, int) for k in mapping)


def literal_map(mapping: Mapping) -> Column:
    """A ``create_map`` literal; lives in the plan, evaluated inside codegen.
    Integer keys are typed BIGINT so any integral column can probe the map."""
    ints = _int_keys(mapping)
    parts = []
    for k, v in mapping.items():
        parts += [F.lit(k).cast("bigint") if ints else F.lit(k), F.lit(v)]
    return F.create_map(*parts)


def lookup(col: Column | str, mapping: Mapping, default=None) -> Column:
    """``Series.map(dict).fillna(default)``: unmapped or NULL keys get ``default``."""
    c = F.col(col) if isinstance(col, str) else col
    if _int_keys(mapping):
        c = c.try_cast("bigint")
    v = F.try_element_at(literal_map(mapping), c)
    return v if default is None else F.coalesce(v, F.lit(default))


def infer_region(country: Column | str, language: Column | str, audio_language: Column | str) -> Column:
    """Region by country; only when the country is unknown (NULL / "Unknown")
    fall back to the default language, then the audio language, then "Unknown".
    A known but unmapped country code stays "Unknown"."""
    c = F.col(country) if isinstance(country, str) else country
    c = F.coalesce(c, F.lit(UNKNOWN))
    by_lang = F.coalesce(lookup(language, LANG_TO_REGION), lookup(audio_language, AUDIO_TO_REGION))
    return F.coalesce(F.when(c == UNKNOWN, by_lang).otherwise(lookup(c, COUNTRY_TO_REGION_ANALYSIS)),
                      F.lit(UNKNOWN))


def serving_region(country: Column | str) -> Column:
    """Serving variant: upper-cased country, default "US"; unmapped -> "North America"."""
    c = F.col(country) if isinstance(country, str) else country
    code = F.upper(F.coalesce(F.nullif(c, F.lit("")), F.lit("US")))
    return lookup(code, COUNTRY_TO_REGION_SERVING, "North America")


def backfill_topic(topic: Column | str, category_id: Column | str, marker: str = "trending") -> Column:
    """Where topic equals ``marker``, take the category's topic name, else keep the topic."""
    t = F.col(topic) if isinstance(topic, str) else topic
    return F.when(t == marker, F.coalesce(lookup(category_id, CATEGORY_TOPIC_ANALYSIS), t)).otherwise(t)


def category_name(category_id: Column | str) -> Column:
    return lookup(category_id, CATEGORY_NAME_SERVING, "entertainment")


def model_topic(category_id: Column | str) -> Column:
    """Two-level lookup: category id -> category name -> model topic."""
    return lookup(category_name(category_id), CATEGORY_TO_MODEL_TOPIC, "entertainment")
