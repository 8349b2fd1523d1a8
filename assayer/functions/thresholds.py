"""Thresholds, closed domains and phrases on which results depend."""

SHARP_LOW, SHARP_HIGH = 40.0, 350.0
EYES_LOW, EYES_SPAN, BOX_LOW, BOX_SPAN = 40.0, 120.0, 80.0, 240.0
SMALL_SIDE, SMALL_CAP = 256.0, 0.4
LIGHT_MEAN, LIGHT_SIGMA, DARK_PIXEL, BRIGHT_PIXEL, CLIP_WEIGHT, SPLIT_WEIGHT = 128.0, 55.0, 15.0, 240.0, 8.0, 2.5
YAW_RANGE, PITCH_RANGE, POSE_FLOOR = 75.0, 40.0, 0.35
CLOSE_FACE, MEDIUM_FACE, CLOSE_EYES, MEDIUM_EYES = 0.38, 0.16, 0.14, 0.06
FRONT_YAW, PROFILE_YAW = 18.0, 48.0
CROWD_COUNT, CROWD_SHARE, CROWD_LEAST = 4, 0.30, 3
PICKS, QUOTAS = 10, {"closeup": 7, "medium": 2, "full": 1}
USABLE, STRONG, WEAKEST_TERM = 8, 20, 0.35
LOW_RESOLUTION, LIKELY_EMPTY_BYTES = 1024, 100 * 1024
SAME_BOX, CONSENSUS_SHARE, CONSENSUS_LEAST = 0.35, 0.35, 2

SHOTS = ("front", "three-quarter", "profile", "full-body")
CONCEPTS = ("identity", "generic", "pose_motion", "clothing", "background", "style")
POSES = ("front", "three-quarter-left", "three-quarter-right", "profile-left", "profile-right")
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "gif")
VIDEOS = ("mp4", "webm", "mov", "mkv", "avi", "m4v")
EDGES = ("top", "bottom", "left", "right")
ACTIONS = ("skipped", "kept", "moved", "copied", "replaced")
#: Poses that a set needs as close-ups, then those that are nice to have.
NEEDED, NICE = POSES[:3], POSES[3:]
