"""Fixed values.

Names, lists and patterns that results depend on. They are data, kept together
so that they can be read and checked in one place.
"""

# Creator tiers, lowest to highest.
CREATOR_TIERS = [
    "2 - Beginner",
    "3 - Elementary",
    "4 - Intermediate",
    "5 - Advanced",
    "6 - Expert",
]

# Audience kinds.
AUDIENCE_KINDS = ["broadcast- one time", "broadcast- recurring", "email"]

# Text that switches an optional filter off.
NOT_REQUIRED = "not required"

# Campaign measurement.
CAMPAIGN_ACTIONS = ["IMPRESSION", "CLICK", "DISMISS"]
CAMPAIGN_SURFACES = ["FEED_HEADER_PROMPT", "PROFILE_ACTIVITY_CARD", "FULL_SCREEN_TAKEOVER"]
QUARTER_ENDS = ["0331", "0630", "0930", "1231"]
EARLIEST_CAMPAIGN_START = "2023-03-31"
USER_DISTRIBUTION_STATS = ["min", "p25", "median", "p75"]

# Goals whose conversions come from the app deep funnel.
APP_DEEP_FUNNEL_GOALS = [
    "APP_REENGAGE_PURCHASE",
    "APP_PURCHASE",
    "APP_PURCHASE_VO",
    "APP_ADD_TO_CART",
    "APP_SIGNUP",
    "APP_AD_VIEW",
    "APP_ACHIEVEMENT_UNLOCKED",
    "APP_LEVEL_COMPLETE",
]
EXPERIMENT_KINDS = ["classical", "pixel_star", "app_star", "amalgam", "swipe"]
ANOMALY_SEVERITY_DROPPED = 2
GOAL_LEFT_OUT = "IMPRESSIONS"
OVERALL = "Overall"
UNKNOWN_SIZE = "Unknown"

# Band in which a prediction counts as matching its outcome.
SLA_LOW = 0.8
SLA_HIGH = 1.2

# Right-closed conversion buckets: (low, high, label).
CONVERSION_BUCKETS = [
    (0, 1, "0-1"),
    (1, 10, "1-10"),
    (10, 50, "10-50"),
    (50, 100, "50-100"),
    (100, None, "100+"),
]

# Fields of a story label, in output order.
LABEL_TEXT_FIELDS = [
    "short_description",
    "long_description",
    "event_type",
    "event_scale",
    "event_duration",
    "event_intensity",
    "associated_mood",
]
LABEL_LIST_FIELDS = ["keywords", "key_objects", "activity_type", "contributing_context"]
LABEL_ID_FIELDS = ["place_id", "place_country_code"]
LABEL_TIME_FIELDS = ["detection_start_time", "detection_end_time"]
LABEL_NUMBER_FIELDS = ["virality_potential", "consistency"]
LABEL_FIELDS = [
    "short_description",
    "long_description",
    "keywords",
    "event_type",
    "event_scale",
    "event_duration",
    "event_intensity",
    "associated_mood",
    "key_objects",
    "activity_type",
    "contributing_context",
    "virality_potential",
    "detection_start_time",
    "detection_end_time",
    "place_id",
    "place_country_code",
    "consistency",
]
STORY_LABEL_FIELDS = [
    "short_description",
    "long_description",
    "keywords",
    "event_type",
    "event_scale",
    "event_duration",
    "event_intensity",
    "associated_mood",
    "key_objects",
    "activity_type",
    "contributing_context",
    "virality_potential",
]
PLACE_LABEL_FIELDS = [
    "key_objects",
    "activity_type",
    "contributing_context",
    "short_description",
    "long_description",
    "keywords",
    "consistency",
]
PLACE_VOTE_FIELDS = [
    "event_type",
    "event_scale",
    "event_duration",
    "event_intensity",
    "associated_mood",
]
PLACE_STORY_KEYS = [
    "place_id",
    "continent",
    "place_name",
    "place_country_code",
    "detection_start_time",
    "detection_end_time",
]

# Patterns that find label fields in broken text; {key} is the field's name.
LABEL_KEY = r"""['"]{key}['"]\s*:\s*"""
LABEL_SCALAR = r"""(?:Timestamp\(['"]([^'"]+)['"]\)|['"]([^'"]+)['"]|([A-Za-z0-9_\-:.]+))"""
LABEL_OPEN_LIST = r"\["
LABEL_LIST_INSIDE = r"([^\]]*)"
LABEL_QUOTED_TOKEN = r"""['"]([^'"]+)['"]"""
LABEL_NUMBER = r"""['"]?(-?\d+(?:\.\d+)?)"""

# The first number in noisy text.
LENIENT_NUMBER = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
