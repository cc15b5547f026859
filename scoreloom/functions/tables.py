"""Fixed value tables. Every value here must equal the published definition, so it is stated plainly."""

# Role keywords, in priority order; the first role with a matching substring wins.
ROLE_KEYWORDS = [
    ("hihat", ["hat", "hihat", "hi-hat", "cymbal", "ride", "crash", "overhead"]),
    ("kick", ["kick", "bd", "bassdrum", "bass drum"]),
    ("drums", ["drum", "snare", "tom", "perc", "clap", "shaker", "tambourine"]),
    ("bass", ["bass", "sub", "808"]),
    ("vocals", ["vocal", "vox", "lead", "voice", "sing", "choir", "harmony"]),
    ("guitar", ["guitar", "gtr", "acoustic", "electric"]),
    ("keys", ["piano", "key", "synth", "organ", "pad", "rhodes", "epiano", "wurli"]),
]

# The coarser role table of the level-policy operators.
POLICY_ROLE_KEYWORDS = [
    ("vocal", ["vocal", "vox", "lead", "voice", "sing"]),
    ("drums", ["drum", "kick", "snare", "hat", "perc", "tom", "cymbal"]),
    ("bass", ["bass", "sub"]),
    ("guitar", ["guitar", "gtr"]),
    ("keys", ["piano", "key", "synth", "organ", "rhodes", "epiano"]),
    ("strings", ["string", "violin", "cello", "viola"]),
    ("brass", ["brass", "horn", "trumpet", "sax", "trombone"]),
]

# Instrument categories of numbered track files.
CATEGORY_KEYWORDS = [
    ("vocal", ["vocal", "voc", "lead", "sing", "rap", "voice"]),
    ("drums", ["drum", "kick", "snare", "hihat", "hat", "tom", "ride", "cymbal", "overhead", "perc"]),
    ("bass", ["bass", "subbass"]),
    ("guitar", ["guitar", "gtr", "gtrs"]),
    ("keys", ["keys", "piano", "synth", "rhodes", "organ", "pad"]),
    ("strings", ["strings", "violin", "viola", "cello"]),
    ("horns", ["horn", "trumpet", "sax", "trombone"]),
    ("fx", ["fx", "sfx", "ambient", "noise"]),
]

# Vocal detection by name and by instrument metadata.
VOCAL_NAME_WORDS = ["vocal", "voc", "lead", "sing"]
VOCAL_INSTRUMENT_WORDS = ["vocal", "voice", "singer", "sing", "lead", "rap"]

# Genre keywords in priority order.
GENRE_KEYWORDS = [
    ("hiphop", ["hip hop", "hip-hop", "rap", "trap"]),
    ("electronic", ["electronic", "techno", "house", "edm", "dance", "disco"]),
    ("jazz", ["jazz"]),
    ("soul", ["funk", "soul", "r&b", "rnb"]),
    ("country", ["country", "folk"]),
    ("pop", ["pop"]),
    ("rock", ["rock", "metal", "punk", "grunge"]),
]

# Level policy in dB per coarse genre and role.
GENRE_POLICY = {
    "pop": {"vocal": 3.0, "drums": 1.0, "bass": 1.0, "keys": -1.0, "guitar": -1.0, "other": -1.0},
    "rock": {"vocal": 2.0, "drums": 2.0, "bass": 1.0, "guitar": 1.0, "keys": -1.5, "other": -1.0},
    "electronic": {"vocal": 1.0, "drums": 2.0, "bass": 3.0, "keys": 0.0, "guitar": -1.0, "other": -0.5},
    "hiphop": {"vocal": 3.0, "drums": 2.0, "bass": 3.0, "keys": -1.0, "guitar": -1.0, "other": -1.0},
    "jazz": {"vocal": 1.0, "drums": 0.0, "bass": 1.0, "keys": 0.5, "brass": 1.0, "other": 0.0},
    "country": {"vocal": 3.0, "drums": 0.5, "bass": 1.0, "guitar": 1.0, "keys": -0.5, "other": -0.5},
    "soul": {"vocal": 3.0, "drums": 1.0, "bass": 2.0, "keys": 0.0, "brass": 1.0, "other": -0.5},
    "default": {"vocal": 2.0, "drums": 1.0, "bass": 1.0, "keys": -0.5, "guitar": 0.0, "other": -0.5},
}

# Loudness target per role (dB).
LEVEL_TARGETS = {"vocals": -15.0, "kick": -16.0, "drums": -16.0, "hihat": -20.0, "bass": -17.0,
                 "guitar": -20.0, "keys": -20.0, "other": -20.0}

# Words that mean "completed".
TRUTHY_WORDS = ["true", "1", "yes", "completed", "complete"]

# Argument limits of the conservative mode, (action, argument, low, high).
ACTION_LIMITS = [
    ("static_eq", "freq", 20.0, 20000.0), ("static_eq", "gain_db", -6.0, 6.0), ("static_eq", "q", 0.1, 10.0),
    ("static_compressor", "threshold_db", -60.0, 0.0), ("static_compressor", "ratio", 1.0, 6.0),
    ("static_compressor", "attack_ms", 0.1, 200.0), ("static_compressor", "release_ms", 1.0, 5000.0),
    ("static_compressor", "knee_db", 0.0, 18.0),
    ("static_gain", "gain_db", -18.0, 12.0),
    ("static_pan", "pan", -1.0, 1.0),
    ("static_width", "width", 0.0, 2.0),
    ("section_gain", "gain_db", -12.0, 12.0),
    ("section_eq", "freq", 20.0, 20000.0), ("section_eq", "gain_db", -6.0, 6.0), ("section_eq", "q", 0.1, 10.0),
    ("master_eq", "freq", 20.0, 20000.0), ("master_eq", "gain_db", -3.0, 3.0), ("master_eq", "q", 0.1, 10.0),
    ("master_compressor", "threshold_db", -30.0, 0.0), ("master_compressor", "ratio", 1.0, 4.0),
    ("master_compressor", "attack_ms", 1.0, 100.0), ("master_compressor", "release_ms", 50.0, 1000.0),
    ("master_limiter", "ceiling_db", -3.0, -0.3), ("master_limiter", "release_ms", 50.0, 500.0),
]

# Limits that the wide mode replaces.
ACTION_LIMITS_WIDE = [("static_eq", "gain_db", -12.0, 12.0), ("static_compressor", "ratio", 1.0, 20.0)]

# Action catalogue, action to scope.
ACTION_SCOPES = {
    "apply_static_eq": "static", "apply_static_compressor": "static", "apply_static_gain": "static",
    "apply_static_pan": "static", "apply_static_width": "static",
    "apply_section_gain": "section", "apply_section_eq": "section", "apply_section_pan": "section",
    "apply_section_width": "section", "apply_section_compressor": "section",
    "apply_master_eq": "master", "apply_master_compressor": "master", "apply_master_limiter": "master",
    "apply_transient_shaper": "transient",
    "apply_gain_automation": "automation", "apply_pan_automation": "automation",
    "apply_width_automation": "automation",
    "apply_dynamic_eq": "dynamic", "apply_multiband_compressor": "dynamic",
    "apply_sidechain_compressor": "dynamic",
    "apply_reverb": "insert", "apply_delay": "insert", "apply_saturation": "insert", "apply_deesser": "insert",
    "evaluate_multi_resolution": "perception", "score_ear": "perception",
    "save_checkpoint": "state", "rollback": "state",
}

# Scopes allowed per declared resolution.
RESOLUTION_SCOPES = {
    "global": ["static", "master", "perception", "state"],
    "section": ["section", "perception", "state"],
    "short_term": ["dynamic", "automation", "perception", "state"],
    "momentary": ["transient", "master", "perception", "state"],
}

# Names that stand for the whole mix, and the master twin of a static action.
PSEUDO_TRACKS = ["all", "master", "mix", "song", "whole", "everything", "all_stems", "all_tracks", "global",
                 "bus", "main"]
STATIC_TO_MASTER = {"apply_static_eq": "apply_master_eq", "apply_static_compressor": "apply_master_compressor"}

# Proposal kinds and probabilities.
ACTION_KIND_PROBS = [("gain", 0.14), ("pan", 0.08), ("width", 0.08), ("eq", 0.24), ("comp", 0.10),
                     ("reverb", 0.10), ("delay", 0.08), ("saturation", 0.10), ("deesser", 0.08)]

# Year ranges [lo, hi) of the experience bands.
YEAR_BANDS = [("none", 0, 1), ("lt1", 0, 1), ("y1_2", 1, 2), ("y2_3", 2, 3), ("y3_5", 3, 5),
              ("y5_10", 5, 10), ("gt10", 10, 71)]

# Order in which the first rejection reason is taken.
REASON_ORDER = ["missing_data", "fail_hearing", "fail_device", "fail_years", "fail_songs", "fail_recency",
                "fail_knowledge", "fail_bogus", "fail_attention"]

# The planned contrasts (name, a, b, side, family).
CONTRASTS = [
    ("H1_topline_noninf", "proposed", "professional", "noninf", "primary_noninf"),
    ("H2_hack", "proposed", "pq_only", "greater", "primary"),
    ("H3_sota", "proposed", "fxnorm", "greater", "primary"),
    ("S1_minvsmean", "proposed", "mean_reward", "two", "secondary"),
    ("check_dry", "proposed", "random_dry", "none", "check"),
]

# Weights of the multi-metric reward.
REWARD_WEIGHTS = {"audiobox.PQ": 1.0, "audiobox.CU": 1.0, "audiobox.CE": 1.0, "stereo.stereo_quality": 0.5}

# Mean and standard deviation that bring those metrics to z units.
REWARD_CALIBRATION = {"audiobox.PQ": (7.7538, 0.5352), "audiobox.CU": (7.5989, 0.354),
                      "audiobox.CE": (7.3938, 0.3741), "stereo.stereo_quality": (0.8088, 0.1917)}

# Scopes that count as aligned with a declared resolution.
ALIGNED_SCOPES = {"global": ["static", "master"], "section": ["section"],
                  "short_term": ["dynamic", "automation"], "momentary": ["transient", "master"]}

# Section labels of the energy segmentation, by order.
SECTION_LABELS = ["verse_1", "chorus_1", "verse_2", "chorus_2", "bridge", "outro"]
