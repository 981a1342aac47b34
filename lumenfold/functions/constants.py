"""Lists, tables and patterns that results depend on, in their natural order."""

from __future__ import annotations

# Filler words that cuts remove.
FILLERS = ("um", "uh", "uhm", "ah", "er", "erm", "like", "you know", "i mean", "sort of", "kind of", "basically", "literally")

# Words masked by default.
PROFANITY = ("fuck", "fucking", "shit", "bitch", "asshole", "bullshit", "dick")

# Trend phrases of the score.
TRENDS = (
    "how to", "tutorial", "tips", "tricks", "hack", "secrets", "revealed",
    "best", "worst", "top 10", "top 5", "must know", "you need to",
    "never", "always", "mistake", "avoid", "warning", "alert",
    "money", "income", "profit", "earn", "save", "invest", "wealth",
    "productivity", "focus", "motivation", "mindset", "success",
    "ai", "chatgpt", "automation", "viral", "trending", "growth",
    "health", "fitness", "diet", "workout", "mental health",
    "relationship", "friendship", "love", "communication",
)

# Patterns of a strong opening, and weights of the score's parts.
HOOKS = (r"\?", r"^(how|why|what|when|who|never|always|stop|start|you need)", r"\d+")
WEIGHTS = {"hook": 0.30, "value": 0.25, "emotion": 0.15, "audio": 0.15, "trend": 0.15}

# Hosts of each platform, in the order they are tried.
HOSTS = {
    "youtube": ("youtube.com", "youtu.be"),
    "facebook": ("facebook.com", "fb.watch"),
    "tiktok": ("tiktok.com",),
    "instagram": ("instagram.com", "instagr.am"),
}

# Least score of each grade.
GRADES = ((90, "A"), (80, "A-"), (70, "B+"), (60, "B"), (50, "B-"))

# Caption presets (font size, colour, highlight colour).
PRESETS = {
    "static": (42, "#ffffff", None),
    "hormozi": (56, "#ffffff", "#fff200"),
    "mrbeast": (64, "#ffffff", "#ff0066"),
    "karaoke": (48, "#ffffff", "#22d3ee"),
    "boldpop": (60, "#ffffff", "#7c3aed"),
    "subtle": (36, "#ffffff", None),
}

# Named length ranges in seconds.
LENGTH_RANGES = {"0-1m": (0, 60), "1-3m": (60, 180), "3-5m": (180, 300), "5-10m": (300, 600), "10-15m": (600, 900)}

# Event types.
EVENT_TYPES = (
    "VideoRequested", "FolderCreated", "VideoDownloaded", "ChaptersDetected", "ChapterClipExtracted", "ChapterTranscribed",
    "CaptionsGenerated", "SubtitleImageRendered", "ClipRendered", "ThumbnailGenerated", "SegmentsProposed", "SegmentScored",
    "UploadReceived", "SocialContentGenerated", "ExportCompleted", "ManifestCreated", "StageSkipped", "JobCompleted", "JobFailed",
)
TERMINAL_TYPES = ("JobCompleted", "JobFailed")

# Stages in order, with the event types that complete them and the artifact that shows it.
STAGES = (
    ("folder", ("FolderCreated",), None),
    ("download", ("VideoDownloaded",), None),
    ("chapters", ("ChaptersDetected",), None),
    ("extract", ("ChapterClipExtracted",), "clip_path"),
    ("transcribe", ("ChapterTranscribed",), "transcript"),
    ("caption", ("CaptionsGenerated",), "captions_path"),
    ("render", ("ClipRendered",), "output_path"),
    ("finalise_chapters", ("ThumbnailGenerated", "SocialContentGenerated"), None),
    ("export", ("ExportCompleted", "ManifestCreated"), None),
    ("complete", ("JobCompleted",), None),
)
CHAPTER_STAGES = ("extract", "transcribe", "caption", "render", "finalise_chapters")
STEPS = ("folder", "download", "chapters", "completed")
STATUS_RANK = {"pending": 0, "extracting": 1, "transcribing": 2, "captioning": 3, "rendering": 4, "completed": 5, "failed": 5}

# How far a job is after each of its own events (none known: the least), and a chapter after each step.
JOB_PROGRESS = {"VideoRequested": 0.02, "FolderCreated": 0.08, "VideoDownloaded": 0.20, "ChaptersDetected": 0.25, "JobCompleted": 1.00, "JobFailed": None}
LEAST_PROGRESS = 0.02
STEP_PROGRESS = {"ChapterClipExtracted": 0.20, "ChapterTranscribed": 0.40, "CaptionsGenerated": 0.60, "SubtitleImageRendered": 0.80, "ClipRendered": 1.00}

# Options, and the stages each switches.
OPTION_STAGES = {
    "transcription": ("transcribe", "caption"),
    "captions": ("caption",),
    "render": ("extract", "render", "finalise_chapters"),
    "thumbnail": ("finalise_chapters",),
    "segment_proposer": ("chapters",),
    "reframe": (),
    "broll": (),
}

# What a wipe is called by the video tool.
TRANSITIONS = {"fade": "fade", "slide-left": "slideleft", "slide-right": "slideright", "zoom": "zoomin"}

# Track kinds of a timeline.
TRACK_KINDS = ("video", "caption", "text-overlay")

# Patterns of text features, and the entries of a video page's URL.
HOW_TO = r"(how|steps?|tips?|ways?|methods?)"
NOUN_PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
VIDEO_ID = r"(?:v=|youtu\.be/)([a-zA-Z0-9_-]{11})"
SHORTS = r"(?i)^https?://(?:[^/]+\.)?(?:youtube\.com|youtu\.be)/shorts/"

# Days that a cached search is good for.
SEARCH_DAYS = 7

# What a workspace may do, all of it, and its limits (none).
CAPABILITIES = (
    "animated_captions", "multi_aspect_reframe", "voiceover", "filler_removal", "transitions", "brand_templates", "brand_vocabulary",
    "profanity_filter", "custom_clip_length", "reprompt", "publish_youtube", "publish_tiktok", "publish_instagram", "publish_linkedin",
    "publish_x", "multi_profile", "scheduler", "bulk_schedule", "xml_export", "bulk_export", "share_links", "workspace", "folders",
    "auto_save", "analytics", "webhooks", "api_tokens",
)
LIMITS = ("max_clips_per_export", "max_brand_fonts", "max_voiceover_seconds")
TIER = "business"

# Options of the modes, and of short videos.
OPTIONS = ("transcription", "captions", "render", "segment_proposer", "reframe", "broll", "thumbnail")
CHAPTER_MODE_OFF = ("segment_proposer",)
SHORT_FORM_ON = ("render",)
