"""Fixed reference tables. All values here are constants of the data contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

# Motion classes: extractor backend and applicator.
MOTION_CLASSES = {
    "articulated": ("pose_mediapipe", "skeletal"),
    "cloth": ("flow_raft", "wave"),
    "fluid": ("flow_raft", "flow_field"),
    "flock": ("flow_raft", "flock_drift"),
    "rigid_path": ("track_bytetrack", "path_travel"),
    "oscillation": ("parametric", "oscillate"),
}
# Which payload kind each applicator reads.
APPLICATOR_NEEDS = {"skeletal": "skeleton", "wave": "texture", "flow_field": "texture", "flock_drift": "texture",
                    "path_travel": "path", "oscillate": "texture"}
SWATCH_KINDS = ("texture", "skeleton", "path")
KIND_DEFAULT = {"skeleton": "skeletal", "path": "path_travel", "texture": "oscillate"}
MESH_CLASSES = ("cloth", "fluid")

# The eight dials: lowest, highest, wraps around, largest step of one correction.
PARAMS = {
    "frequency": (0.0, 6.0, False, 0.5), "amplitude": (0.0, 1.0, False, 0.2), "direction": (0.0, 360.0, True, 45.0),
    "turbulence": (0.0, 1.0, False, 0.2), "damping": (0.0, 1.0, False, 0.15), "phaseSpread": (0.0, 1.0, False, 0.2),
    "driftX": (-1.0, 1.0, False, 0.2), "driftY": (-1.0, 1.0, False, 0.2),
}
PARAM_KEYS = tuple(PARAMS)

JUDGE_VERDICTS = ("good", "tune", "wrong_class")
JUDGE_SCORE_OF = ("match_to_reference", "class_plausibility")
JUDGE_AXES = ("speed", "amplitude", "direction", "character")
JUDGE_MAX_ITERS, JUDGE_GOOD, JUDGE_MIN_GAIN = 3, 0.8, 0.03
CONFIDENCE_MIN = 0.35
MAX_LAYERS = 12

SUBJECTS = ("pose", "hands", "face")
VIEWPOINTS = ("front", "side", "unknown")
CONFIDENCE_OF = {"pose": "mean_visibility", "hands": "handedness_score", "face": "detection_ratio"}
GENERATED_CONFIDENCE = "generation_only"
SWATCH_CONFIDENCE_OF = {"texture": "gated_motion_amplitude", "skeleton": "", "path": "tracked_fraction"}
MASK_ENCODINGS = ("rle", "png_b64", "polygon")
CAMERA_MODELS = ("none", "affine", "homography")

# Limb roles: the two joints of each bone, the parent limb, and the segment below it.
LIMB_BONES = {
    "arm-l": ("l_sho", "l_elb"), "arm-r": ("r_sho", "r_elb"), "forearm-l": ("l_elb", "l_wri"), "forearm-r": ("r_elb", "r_wri"),
    "leg-l": ("l_hip", "l_knee"), "leg-r": ("r_hip", "r_knee"), "shin-l": ("l_knee", "l_ank"), "shin-r": ("r_knee", "r_ank"),
    "head": ("@sho", "nose"), "torso": ("@hip", "@sho"),
}
LIMB_PARENT = {"arm-l": "torso", "arm-r": "torso", "head": "torso", "leg-l": "torso", "leg-r": "torso",
               "forearm-l": "arm-l", "forearm-r": "arm-r", "shin-l": "leg-l", "shin-r": "leg-r"}
LIMB_CHILD = {"arm-l": "forearm-l", "arm-r": "forearm-r", "leg-l": "shin-l", "leg-r": "shin-r"}
DEPTH_ROLES = ("leg-l", "leg-r", "shin-l", "shin-r")

# Routing rules: class, rule number, subject type, count, has text prompt (null = any), engines in order of preference.
ROUTE_RULES = [
    ("articulated", 0, "human", None, True, ["momask", "wham", "pose_mediapipe", "keypointrcnn"]),
    ("articulated", 1, "human", "many", None, ["keypointrcnn", "pose_mediapipe"]),
    ("articulated", 2, "human", None, None, ["wham", "pose_mediapipe", "keypointrcnn"]),
    ("articulated", 3, "animal", None, True, ["mmpose_animal", "pose_mediapipe", "keypointrcnn"]),
    ("articulated", 4, "animal", None, None, ["mmpose_animal", "pose_mediapipe", "keypointrcnn"]),
    ("articulated", 5, None, None, None, ["pose_mediapipe", "keypointrcnn"]),
    ("cloth", 0, None, None, None, ["searaft", "raft_large", "raft_small"]),
    ("fluid", 0, None, None, None, ["searaft", "raft_small"]),
    ("flock", 0, None, "one", None, ["cotracker3", "tapir", "raft_small"]),
    ("flock", 1, None, None, None, ["tapir", "cotracker3", "searaft", "raft_small"]),
    ("rigid_path", 0, None, None, None, ["yolo_bytetrack", "objectron", "cotracker3", "tapir", "raft_small"]),
    ("oscillation", 0, None, "many", None, ["tapir", "cotracker3", "raft_small"]),
    ("oscillation", 1, None, None, None, ["cotracker3", "tapir", "raft_small"]),
]
CLASS_FLOOR = {"articulated": "keypointrcnn", "cloth": "raft_small", "fluid": "raft_small", "flock": "raft_small",
               "rigid_path": "raft_small", "oscillation": "raft_small"}

# Motion presets: id, then the eight dials (drift 0 where a preset names none).
PRESETS = [
    ("waterfall-flow", 2.8, 0.6, 90.0, 0.55, 0.1, 0.7, 0.0, 0.0),
    ("cloud-drift", 0.35, 0.9, 0.0, 0.03, 0.0, 0.1, 0.0, 0.0),
    ("flag-flutter", 3.5, 0.4, 10.0, 0.35, 0.2, 0.85, 0.0, 0.0),
    ("gentle-sway", 0.4, 0.45, 0.0, 0.08, 0.12, 0.5, 0.0, 0.0),
    ("water-ripple", 1.0, 0.2, 0.0, 0.25, 0.15, 0.9, 0.0, 0.0),
    ("sun-pulse", 0.6, 0.4, 90.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("falling-leaves", 0.5, 0.3, 0.0, 0.25, 0.3, 0.8, 0.0, 0.5),
    ("autumn-fall", 0.38, 0.42, 270.0, 0.32, 0.08, 0.85, -0.05, 0.9),
    ("rising-smoke", 0.3, 0.25, 0.0, 0.3, 0.2, 0.6, 0.05, -0.55),
]


def lookup(key: Column, table: dict) -> Column:
    """Constant lookup as a CASE chain: no join, null when the key is not in the table."""
    out = None
    for k, v in table.items():
        if v is not None:
            out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def motion_classes(spark: SparkSession) -> DataFrame:
    rows = [(c, b, a, "mesh" if c in MESH_CLASSES else "rigid") for c, (b, a) in MOTION_CLASSES.items()]
    return spark.createDataFrame(rows, "class string, backend string, applicator string, deforms string")


def param_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PARAMS.items()], "param string, lo double, hi double, circular boolean, step double")


def route_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTE_RULES, "class string, rule_no int, subject_type string, count string, has_text_prompt boolean, engines array<string>")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "id string, " + ", ".join(f"{k} double" for k in PARAM_KEYS))


def backend_of(cls: Column) -> Column:
    return lookup(cls, {k: v[0] for k, v in MOTION_CLASSES.items()})


def applicator_of(cls: Column) -> Column:
    return lookup(cls, {k: v[1] for k, v in MOTION_CLASSES.items()})
