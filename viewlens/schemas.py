"""Table schemas and the fixed vocabularies the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Video category id -> name, as published for the video-metadata service.
# Two ids (23 and 34) share the name "Comedy".
CATEGORIES = [
    ("1", "Film & Animation"),
    ("2", "Autos & Vehicles"),
    ("10", "Music"),
    ("15", "Pets & Animals"),
    ("17", "Sports"),
    ("18", "Short Movies"),
    ("19", "Travel & Events"),
    ("20", "Gaming"),
    ("21", "Videoblogging"),
    ("22", "People & Blogs"),
    ("23", "Comedy"),
    ("24", "Entertainment"),
    ("25", "News & Politics"),
    ("26", "Howto & Style"),
    ("27", "Education"),
    ("28", "Science & Technology"),
    ("29", "Nonprofits & Activism"),
    ("30", "Movies"),
    ("31", "Anime/Animation"),
    ("32", "Action/Adventure"),
    ("33", "Classics"),
    ("34", "Comedy"),
    ("35", "Documentary"),
    ("36", "Drama"),
    ("37", "Family"),
    ("38", "Foreign"),
    ("39", "Horror"),
    ("40", "Sci-Fi/Fantasy"),
    ("41", "Thriller"),
    ("42", "Shorts"),
    ("43", "Shows"),
    ("44", "Trailers"),
]
# Quality dimensions of a judgment, in output order.
QUALITY_DIMENSIONS = ["depth", "rigor", "novelty", "effort", "engagement_quality"]
# Judgment labels (sorted order is the report order).
TRIAGE_LABELS = ["deep", "useful", "mixed", "shallow"]
# Composite thresholds used when a judgment carries no valid label.
LABEL_THRESHOLDS = [(4.0, "deep"), (3.0, "useful"), (2.0, "mixed")]
LABEL_FLOOR = "shallow"
CONFIDENCE_LEVELS = ["high", "medium", "low"]
CONTENT_TYPES = ["educational", "analysis", "news", "tutorial", "entertainment",
                 "music", "personal", "promotional", "documentary", "other"]
EVIDENCE_TOOLS = ["fetch_transcript", "analyze_channel_patterns",
                  "compute_engagement_metrics", "get_category_context"]
SUBMIT_TOOL = "submit_assessment"
MAX_TOOL_ROUNDS = 6
KEY_SIGNALS_MIN, KEY_SIGNALS_MAX = 3, 5
UNAVAILABLE_TITLE = "[unavailable]"
LOOKUP_BATCH_SIZE = 50
TRANSCRIPT_LIMIT = 3000
TAG_DISPLAY_LIMIT = 15
TOP_CATEGORIES = 6
TOP_CHANNELS = 5
# Export markers.
BLOCK_SEPARATOR = 'class="outer-cell'
CONTENT_CELL_OPEN = 'class="content-cell mdl-cell mdl-cell--6-col mdl-typography--body-1">'
CHANNEL_MARKER = "youtube.com/channel"
AD_MARKER = "From Google Ads"
EXPORT_TS_FORMAT = "MMM d, yyyy, h:mm:ss a"
# Percentile anomaly thresholds (strict).
HIGH_LIKE_PCT, LOW_ENGAGEMENT_PCT = 99, 5
TREND_MIN_SPAN_DAYS, TREND_FACTOR = 60, 1.5
# --- end of fixed values ----------------------------------------------------

# An anchor with nothing but its target, and plain text up to the next tag.
LINK_RE = r'<a\s+href="([^"]+)"\s*>([^<]+)</a\s*>'
# A time as EXPORT_TS_FORMAT writes it, then one word for the zone. Any
# horizontal space may stand around AM/PM (exports use U+202F).
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = r"[0-9]{1,2}(?::[0-9]{2}){2}\h(?:AM|PM)"
EXPORT_TS_RE = rf"({_MONTH} [0-9]{{1,2}}, [0-9]{{4}}, {_CLOCK}\h[\p{{L}}\p{{N}}_]+)"
ZONE_RE = r"\h+[A-Z]{2,5}$"

WATCH = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("video_url", T.StringType()),
    T.StructField("video_id", T.StringType()),
    T.StructField("channel_name", T.StringType()),
    T.StructField("channel_url", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("type", T.StringType()),
])

META = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("api_title", T.StringType()),
    T.StructField("api_channel_title", T.StringType()),
    T.StructField("channel_id", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("default_language", T.StringType()),
    T.StructField("default_audio_language", T.StringType()),
    T.StructField("duration_iso", T.StringType()),
    T.StructField("duration_seconds", T.LongType()),
    T.StructField("definition", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("view_count", T.LongType()),
    T.StructField("like_count", T.LongType()),
    T.StructField("comment_count", T.LongType()),
    T.StructField("topic_categories", T.ArrayType(T.StringType())),
])

# One item of a metadata-service response (all statistics are strings).
RESPONSE_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("snippet", T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("channelTitle", T.StringType()),
        T.StructField("channelId", T.StringType()),
        T.StructField("publishedAt", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("categoryId", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("defaultLanguage", T.StringType()),
        T.StructField("defaultAudioLanguage", T.StringType()),
    ])),
    T.StructField("contentDetails", T.StructType([
        T.StructField("duration", T.StringType()),
        T.StructField("definition", T.StringType()),
        T.StructField("caption", T.StringType()),
    ])),
    T.StructField("statistics", T.StructType([
        T.StructField("viewCount", T.StringType()),
        T.StructField("likeCount", T.StringType()),
        T.StructField("commentCount", T.StringType()),
    ])),
    T.StructField("topicDetails", T.StructType([
        T.StructField("topicCategories", T.ArrayType(T.StringType())),
    ])),
])
RESPONSE = T.StructType([T.StructField("items", T.ArrayType(RESPONSE_ITEM))])
