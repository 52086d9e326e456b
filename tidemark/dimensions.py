"""Fixed dimensions: cities, categories with their keywords, date buckets, the time zone."""

from __future__ import annotations

ZONE = "Pacific/Auckland"

# Slug, latitude, longitude, radius in km.
CITIES = (
    ("auckland", -36.8509, 174.7645, 45.0),
    ("wellington", -41.2866, 174.7756, 30.0),
    ("christchurch", -43.5309, 172.6365, 35.0),
    ("queenstown", -45.0312, 168.6626, 40.0),
    ("taupo", -38.6857, 176.0702, 30.0),
)

# The order of the rules decides.
CATEGORY_RULES = (
    ("water", ("surf", "kayak", "paddle", "sail", "dive", "swim", "boat", "yacht", "waka ama", "rowing", "on the water")),
    ("sports", ("rugby", "cricket", "netball", "league", "football", "soccer", "basketball", "marathon", "triathlon", "race", "match", "tournament", "sport", "fitness", "cycling")),
    ("market", ("market", "fair", "bazaar", "car boot", "flea", "artisan", "makers")),
    ("food", ("food", "wine", "beer", "brew", "dining", "degustation", "tasting", "coffee", "restaurant", "feast")),
    ("outdoor", ("hike", "walk", "tramp", "trail", "bush", "garden", "park run", "outdoor", "camping", "climb", "mountain bike")),
    ("family", ("kids", "family", "children", "whānau", "whanau", "playground", "toddler", "school holiday")),
    ("arts", ("theatre", "theater", "exhibition", "gallery", "museum", "art", "dance", "ballet", "opera", "film", "cinema", "comedy", "literature", "poetry")),
    ("music", ("music", "gig", "concert", "band", "dj", "live", "festival", "orchestra", "symphony", "choir", "jazz", "hip hop", "electronic")),
)
CATEGORIES = ("music", "market", "outdoor", "sports", "family", "water", "arts", "food", "other")

# Words that tell nothing about which event it is.
NOISE_WORDS = (
    "the", "a", "an", "and", "of", "at", "in", "on", "for", "with", "to", "by",
    "presents", "present", "presented", "featuring", "feat", "ft", "live", "tour",
    "show", "shows", "event", "tickets", "ticket", "official", "nz", "new", "zealand",
    "aotearoa", "concert", "session", "sessions", "night", "day", "series",
)

DATE_BUCKETS = ("today", "tomorrow", "weekend", "week", "all")
# Labels in English and Chinese.
CITY_LABELS = {
    "auckland": ("Auckland", "奥克兰"), "wellington": ("Wellington", "惠灵顿"), "christchurch": ("Christchurch", "基督城"),
    "queenstown": ("Queenstown", "皇后镇"), "taupo": ("Taupō", "陶波"),
}
CATEGORY_LABELS = {
    "music": ("Music", "音乐"), "market": ("Markets", "市集"), "outdoor": ("Outdoors", "户外"), "sports": ("Sports", "体育"), "family": ("Family", "亲子"),
    "water": ("On the water", "水上"), "arts": ("Arts", "艺文"), "food": ("Food & drink", "美食"), "other": ("Other", "其他"),
}
LANGUAGES = ("en", "zh")
CITY_SLUGS = tuple(c[0] for c in CITIES)
