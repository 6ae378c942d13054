"""Fixed schemas: raw review page, normalised review, the analysis report."""

from pyspark.sql import types as T

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def _strings():
    return T.ArrayType(S)


# One landed review page as the search API returns it.  Fixed values: the
# field names below are the page format's own and must match it exactly.
# Ratings are read as text and cast per review, so one malformed rating does
# not turn the whole page line into a corrupt record.
PAGE_REVIEW = _struct(
    ("rating", S),
    ("iso_date", S),
    ("user", _struct(("name", S))),
    ("extracted_snippet", _struct(("original", S))),
)
PAGE = _struct(
    ("data_id", L),          # added when landed
    ("page_no", L),          # added when landed
    ("place_info", _struct(("type", S), ("title", S), ("rating", S),
                           ("address", S), ("reviews", L))),
    ("search_metadata", _struct(("status", S), ("created_at", S))),
    ("search_parameters", _struct(("data_id", S))),
    ("reviews", T.ArrayType(PAGE_REVIEW)),
    ("serpapi_pagination", _struct(("next", S), ("next_page_token", S))),
)
PAGE_WITH_CORRUPT = T.StructType(PAGE.fields + [T.StructField("_corrupt", S, True)])

# Normalised review row shared by every analysis operator.
REVIEW_COLUMNS = ["data_id", "fetch_pos", "page_no", "user", "rating", "ts",
                  "date", "review_text"]

# The structured report of one place (or one batch / combine node).
OVERALL_SENTIMENT = _struct(("average_score", D), ("positive_percentage", D),
                            ("neutral_percentage", D), ("negative_percentage", D))
PRIORITY = _struct(("category", S), ("issue", S), ("suggestion", S),
                   ("potential_impact", S))
HOTEL_ANALYSIS = _struct(
    ("hotel_name", S),
    ("summary", S),
    ("overall_sentiment", OVERALL_SENTIMENT),
    ("accommodation", _struct(("room_quality", _strings()), ("common_praises", _strings()),
                              ("common_criticisms", _strings()), ("suggestions", _strings()))),
    ("service", _struct(("strengths", _strings()), ("weaknesses", _strings()),
                        ("suggestions", _strings()))),
    ("amenities", _struct(("praised_features", _strings()),
                          ("criticized_features", _strings()), ("suggestions", _strings()))),
    ("food_and_dining", _struct(("restaurant_quality", S), ("breakfast_feedback", S),
                                ("praised_items", _strings()), ("criticized_items", _strings()),
                                ("suggestions", _strings()))),
    ("location_and_accessibility", _struct(("positive_aspects", _strings()),
                                           ("negative_aspects", _strings()),
                                           ("suggestions", _strings()))),
    ("value_for_money", _struct(("perceived_value", S), ("positive_factors", _strings()),
                                ("negative_factors", _strings()), ("suggestions", _strings()))),
    ("online_presence", _struct(("website_feedback", _strings()),
                                ("social_media_feedback", _strings()),
                                ("suggestions", _strings()))),
    ("top_improvement_priorities", T.ArrayType(PRIORITY)),
)

# Fields a model reply must carry (dotted paths into HOTEL_ANALYSIS).  Service
# lists are optional in the report contract, everything else is required.
REQUIRED_REPORT_FIELDS = [
    "hotel_name", "summary",
    "overall_sentiment.average_score", "overall_sentiment.positive_percentage",
    "overall_sentiment.neutral_percentage", "overall_sentiment.negative_percentage",
    "accommodation.room_quality", "accommodation.common_praises",
    "accommodation.common_criticisms", "accommodation.suggestions",
    "amenities.praised_features", "amenities.criticized_features", "amenities.suggestions",
    "food_and_dining.restaurant_quality", "food_and_dining.breakfast_feedback",
    "food_and_dining.praised_items", "food_and_dining.criticized_items",
    "food_and_dining.suggestions",
    "location_and_accessibility.positive_aspects",
    "location_and_accessibility.negative_aspects", "location_and_accessibility.suggestions",
    "value_for_money.perceived_value", "value_for_money.positive_factors",
    "value_for_money.negative_factors", "value_for_money.suggestions",
    "online_presence.website_feedback", "online_presence.social_media_feedback",
    "online_presence.suggestions", "top_improvement_priorities",
]

# Fixed values that must match the reference's formats.
DISPLAY_DATE_FORMAT = "MMMM dd, yyyy 'at' hh:mm a 'UTC'"   # strftime "%B %d, %Y at %I:%M %p UTC"
ISO_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"               # strptime "%Y-%m-%dT%H:%M:%SZ"
STORE_TYPES = ("instant", "full")
