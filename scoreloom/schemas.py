"""Schemas of the native inputs. A key that is absent in older files reads as null."""

SCORE = "struct<pq: double, sb: double, reward: double>"
STEP = ("struct<step: bigint, action: string, args: map<string, string>, track: string, pq: double, sb: double, reward: double, "
        "delta: double, accepted: boolean, note: string>")
CALIBRATION = ("struct<pq_mean: double, pq_std: double, sb_mean: double, sb_std: double, n_samples: bigint, sb_floored: boolean, "
               "pq_floored: boolean>")
PROPOSED = (f"struct<pq: double, sb: double, reward: double, n_accepted: bigint, init_reward: double, best_chain: array<{STEP}>, "
            f"search_log: array<{STEP}>>")
SEED = (f"struct<seed_idx: int, seed: bigint, common_gain: double, stem_gains: map<string, double>, random_dry: {SCORE}, "
        f"proposed_rand: {PROPOSED}, baselines_rand: map<string, {SCORE}>, calibration: {CALIBRATION}>")
RUN_RECORD = (
    "status string, song_id string, song_index bigint, split string, gain_mode string, random_init_gain_range array<double>, "
    "normalize_corrupted_lufs double, random_seeds int, random_base_seed bigint, reward_form string, reward_weight double, "
    f"n_search bigint, search_excerpt_sec double, proposer string, seeds array<{SEED}>")
DURATIONS = "song string, duration double"
TELEMETRY = "ts timestamp_ntz, which string, sec double, ok boolean, err string, qwait double"
