"""Default parameters.  Every operator takes its own value as an argument;
these are only the defaults a caller gets."""

from __future__ import annotations

# Thresholds of the ranking and assignment rules.
MIN_SCORE = 50.0
HIGH_QUALITY_SCORE = 90.0
GENERATION_TRIGGER = 75.0
SIMILARITY_FLOOR = 0.75
VERIFICATION_FLOOR = 0.20
TARGET_IMAGE_RATIO = 0.65
MEDIA_BIAS_SLOPE = 20.0
MEDIA_BIAS_CAP = 8.0
REUSE_CAP = 1
PER_PAGE = 5
MAX_ALTERNATES = 5
POOL_SIZE = 8
SELECTION_MARGIN = 0.05
TIE_EPSILON = 0.01
THIN_CANDIDATES = 1
THIN_WARN_RATIO = 0.15
LIBRARY_BONUS = 10.0
LIBRARY_SOURCE = "local_library"
CALLS_PER_MINUTE = 30

# Timeline pacing.
WORDS_PER_SECOND = 2.0
MIN_CLIP_SECONDS = 3.0
MAX_CLIP_SECONDS = 5.0
MIN_SPOKEN_SECONDS = 2.0
EXHAUSTED_SECONDS = 3.0
MAX_ON_SCREEN_SECONDS = 5.0
TAIL_EPSILON = 0.5
CHUNK_WORDS = 400

# Captions and frames.
FPS = 30
CAPTION_WIDTH = 42
CAPTION_LINES = 2
WORDS_PER_CAPTION_LINE = 7
FRAME_WIDTH, FRAME_HEIGHT = 1920, 1080
DURATION_EPSILON = 0.05
TOTAL_TOLERANCE = 0.25
SPEED_MIN, SPEED_MAX = 0.7, 1.4
MIN_DIMENSION = 480
RATIO_TOLERANCE = 0.05
EXACT_RATIO_TOLERANCE = 1e-3

# Transcript alignment.
ALIGN_ACCEPT = 0.55
ALIGN_SLACK = 6
ALIGN_EXTRA = 4
AUDIT_WARN = 0.85
AUDIT_MAX_SPANS = 20

# Near-duplicate thresholds.
DUPLICATE_REPORT = 0.75
DUPLICATE_APPLY = 0.9

# Provider order, first searched first.
PROVIDERS_DEFAULT = (
    "local_library", "pexels", "pixabay", "coverr",
    "pexels_images", "pixabay_images", "internet_archive", "nasa",
)
PROVIDERS_HISTORICAL = (
    "local_library", "internet_archive", "nasa", "pexels", "pixabay",
    "coverr", "pexels_images", "pixabay_images",
)
ARCHIVE_SOURCES = ("internet_archive", "wikimedia", "nasa")
POOL_SOURCES = ("pexels", "pixabay", "pexels_images", "pixabay_images")

# The visual types a beat may carry, and the two eras.
VISUAL_TYPES = (
    "Archive", "Cinematic", "Sports", "Exercise Demo", "Documents", "Laboratory",
    "B-roll", "Animation", "Map", "Military", "Emotion", "Industry", "Historical",
    "Interview", "Montage", "Nature", "Technology", "Combat",
)
DEFAULT_VISUAL_TYPE = "B-roll"
HISTORICAL_TYPES = ("Archive", "Historical", "Military", "Documents")
MODERN_TYPES = ("Industry", "Technology", "Sports", "Exercise Demo")

# Fixed values: (effect, transition) by visual type, and the default pair.
EDIT_EFFECTS = {
    "Archive": ("film grain, dust overlay, slow zoom", "cross dissolve"),
    "Documents": ("Ken Burns, parallax", "cross dissolve"),
    "Sports": ("speed ramp, punch-in zoom, motion blur", "hard cut"),
    "Exercise Demo": ("speed ramp, punch-in zoom, motion blur", "hard cut"),
    "Laboratory": ("light leaks, slow push-in", "cross dissolve"),
    "Emotion": ("slow motion, fade to black", "fade to black"),
}
DEFAULT_EFFECT = ("slow zoom", "cross dissolve")

# Frames of a boundary effect by pacing.
TRANSITION_FRAMES = {"fast": 6, "medium": 12, "slow": 20}

# Relevance weights.
WEIGHTS = {
    "semantic": 0.27,
    "keyword": 0.18,
    "era": 0.135,
    "quality": 0.135,
    "cinematic": 0.108,
    "motion": 0.072,
    "duration": 0.10,
}
COMFORTABLE_VIDEO_SECONDS = 2.0
RARITY_CEILING = 7.0

# Words without signal in a search phrase, and spoken fillers.
LOW_SIGNAL_WORDS = ("the", "a", "an", "in", "on", "at", "of", "for", "with", "and", "or")
FILLER_WORDS = ("um", "uh", "like", "you", "know", "so", "well", "actually", "basically", "literally")

# Open-licence prefixes.
OPEN_LICENCES = (
    "https://creativecommons.org/publicdomain",
    "http://creativecommons.org/publicdomain",
    "https://creativecommons.org/licenses/by/",
    "http://creativecommons.org/licenses/by/",
    "https://creativecommons.org/licenses/publicdomain/",
    "http://creativecommons.org/licenses/publicdomain/",
)

QUARANTINE_DIR = "_duplicates_removed"
VIDEO_EXTENSIONS = ("mp4", "mov", "webm", "mkv")
