"""Parsers for raw listing strings (PR1-PR11, PR36, PR37). All are Column
expressions: they run inside whole-stage codegen, no Python UDFs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_of, pround

# Currency conversion to EUR and city centres.
JPY_TO_EUR = 0.0062
CURRENCY_TO_EUR = {"EUR": 1.0, "JPY": JPY_TO_EUR}
CITY_CENTRES = {"Madrid": (40.4168, -3.7038), "Tokyo": (35.6812, 139.7671)}

# Amenity flag -> substrings that set it (matched inside each amenity item).
KEY_AMENITIES = {
    "has_wifi": ["wifi"],
    "has_kitchen": ["kitchen"],
    "has_air_conditioning": ["air conditioning", "ac - split type ductless system"],
    "has_washer": ["washer"],
    "has_dedicated_workspace": ["dedicated workspace"],
    "has_tv": ["tv", "hdtv"],
    "has_parking": ["free parking", "paid parking", "parking"],
    "has_elevator": ["elevator"],
    "has_heating": ["heating"],
    "has_self_checkin": ["self check-in", "lockbox", "keypad", "smart lock"],
}

# Ordered property-type rules (first match wins) -> group.
PROPERTY_RULES = [
    (["hotel", "serviced", "aparthotel"], "Hotel/serviced"),
    (["rental unit", "apartment", "condo", "loft"], "Apartment/condo"),
    (["home", "house", "townhouse", "villa"], "House/villa"),
    (["hostel", "guesthouse", "bed and breakfast"], "Guesthouse/hostel"),
    (["room"], "Room"),
]


def parse_price(price, currency=None, rates: Mapping[str, float] = CURRENCY_TO_EUR) -> Column:
    """PR1: "$1,234.00" -> 1234.0; unparseable -> null; converted to EUR by currency."""
    text = F.trim(F.regexp_replace(col_of(price).cast("string"), r"[$,]", ""))
    value = text.try_cast("double")
    if currency is None:
        return value
    cur = F.lit(currency) if isinstance(currency, str) and currency in rates else col_of(currency)
    out = value
    for code, r in rates.items():
        if r != 1.0:
            out = F.when(cur == code, value * F.lit(r)).otherwise(out)
    return out


def parse_boolean(c) -> Column:
    """PR2: 't' -> 1.0, 'f' -> 0.0, anything else -> null (boolean columns cast directly)."""
    s = col_of(c).cast("string")
    return F.when(s.isin("t", "true"), 1.0).when(s.isin("f", "false"), 0.0)


def parse_rate(c) -> Column:
    """PR3: "95%" -> 0.95."""
    return F.trim(F.regexp_replace(col_of(c).cast("string"), "%", "")).try_cast("double") / 100


def parse_bathrooms(c) -> Column:
    """PR4: first number in the text; "half" without any digit -> 0.5; else null."""
    t = F.lower(col_of(c).cast("string"))
    num = F.nullif(F.regexp_extract(t, r"(\d+\.?\d*)", 1), F.lit(""))
    half = t.contains("half") & ~t.rlike(r"\d")
    return F.when(half, F.lit(0.5)).otherwise(num.try_cast("double"))


def bathroom_type(c) -> Column:
    """PR5: Unknown / Shared / Private / Half / Standard, first match wins."""
    t = F.lower(col_of(c).cast("string"))
    return (F.when(t.isNull() | t.isin("nan", ""), "Unknown")
            .when(t.contains("shared"), "Shared")
            .when(t.contains("private"), "Private")
            .when(t.contains("half"), "Half")
            .otherwise("Standard"))


def parse_amenities(c) -> Column:
    """PR6: JSON/literal list -> lower-cased trimmed array; else comma split with quotes
    stripped; null -> empty array."""
    raw = col_of(c).cast("string")
    as_json = F.from_json(raw, "array<string>")
    listed = F.transform(as_json, lambda x: F.lower(F.trim(x)))
    pieces = F.transform(F.split(raw, ","), lambda x: F.lower(F.trim(F.trim(F.trim(x), F.lit('"')), F.lit("'"))))
    pieces = F.filter(pieces, lambda x: x != "")
    parsed = F.when(raw.isNull(), F.array().cast("array<string>")) \
        .when(as_json.isNotNull(), listed).otherwise(pieces)
    return parsed


def amenity_flags(amenities, terms: Mapping[str, Sequence[str]] = KEY_AMENITIES) -> list[Column]:
    """PR8: one 0/1 column per flag: any amenity item contains any of its terms."""
    arr = col_of(amenities)
    out = []
    def matcher(words):
        def hit(x):
            cond = F.lit(False)
            for w in words:
                cond = cond | x.contains(w)
            return cond
        return hit

    for name, words in terms.items():
        out.append(F.coalesce(F.exists(arr, matcher(words)), F.lit(False)).cast("int").alias(name))
    return out


def classify_property_type(c, rules=PROPERTY_RULES) -> Column:
    """PR9: ordered substring rules -> property group (order matters: 'guesthouse' is a house)."""
    t = F.lower(F.coalesce(col_of(c).cast("string"), F.lit("nan")))
    out = None
    for words, label in rules:
        cond = F.lit(False)
        for w in words:
            cond = cond | t.contains(w)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("Other")


def haversine_km(lat, lon, centre_lat, centre_lon, digits: int | None = 4) -> Column:
    """PR10: great-circle km to a centre (R = 6371), rounded like the reference."""
    la1, lo1 = F.radians(col_of(lat).cast("double")), F.radians(col_of(lon).cast("double"))
    la2 = F.radians(centre_lat if isinstance(centre_lat, Column) else F.lit(float(centre_lat)))
    lo2 = F.radians(centre_lon if isinstance(centre_lon, Column) else F.lit(float(centre_lon)))
    a = F.pow(F.sin((la1 - la2) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo1 - lo2) / 2), 2)
    d = F.lit(2 * 6371.0) * F.asin(F.sqrt(a))
    return pround(d, digits) if digits is not None else d


def slugify(c) -> Column:
    """PR36: lower, runs of non-alphanumerics -> '_', trimmed; blank -> 'unknown'."""
    s = F.regexp_replace(F.lower(F.trim(col_of(c).cast("string"))), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def clip_text(c, n: int) -> Column:
    """PR37: the first ``n`` characters of the text (whole text when shorter)."""
    return F.substring(col_of(c).cast("string"), 1, n)


# Accepted spellings in future-rate payloads.
RATE_LIST_KEYS = ["rates", "future_rates", "calendar", "entries", "data"]
DATE_KEYS = ["date", "day", "night"]
RATE_KEYS = ["nightly_rate", "rate", "price", "amount"]
AVAILABLE_KEYS = ["available", "is_available", "availability"]
TRUE_WORDS = ["true", "t", "1", "yes"]


def payload_rates(payload) -> Column:
    """PR35: a JSON payload's rate list as array<struct<date, nightly_rate, available, minimum_nights>>,
    whichever list key and field spelling it uses."""
    obj = F.from_json(col_of(payload), "map<string,string>")
    lst = F.coalesce(*[F.element_at(obj, k) for k in RATE_LIST_KEYS])
    items = F.from_json(lst, "array<map<string,string>>")

    def pick(m, keys):
        return F.coalesce(*[F.element_at(m, k) for k in keys])

    return F.transform(items, lambda m: F.struct(
        pick(m, DATE_KEYS).try_cast("date").alias("date"),
        pick(m, RATE_KEYS).try_cast("double").alias("nightly_rate"),
        F.lower(pick(m, AVAILABLE_KEYS)).isin(*TRUE_WORDS).alias("available"),
        F.element_at(m, "minimum_nights").try_cast("int").alias("minimum_nights")))
