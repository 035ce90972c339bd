"""Reference ranges, score weights, dictionaries."""

# Fixed values: (metric, low, high, better) by default, and (type, metric, low, high, better) instead of them.
RANGES = [
    ("wpm", 100.0, 130.0, "inside"), ("articulation_wpm", 130.0, 170.0, "inside"), ("filled_pauses_per_min", None, 3.0, "lower"), ("crutch_words_per_min", None, 2.0, "lower"),
    ("structural_pauses_per_min", 3.0, 6.0, "inside"), ("hesitation_pauses_per_min", None, 4.0, "lower"), ("talk_ratio", 0.4, 0.7, "inside"), ("mean_sentence_len", None, 22.0, "lower"),
    ("long_sentences_share", None, 0.2, "lower"), ("mtld", 60.0, None, "higher"), ("interruptions_by_me", None, 2.0, "lower"), ("interruptions_by_other", None, None, "lower"),
    ("pitch_range_st", 4.0, None, "higher"), ("phrase_final_decay_db", None, 6.0, "lower"), ("rising_statements_share", None, 0.15, "lower"), ("loudness_drift_db", -3.0, None, "higher"),
]
TYPE_RANGES = [
    ("pitch", "wpm", 110.0, 140.0, "inside"), ("pitch", "filled_pauses_per_min", None, 2.0, "lower"), ("pitch", "talk_ratio", 0.7, 0.8, "inside"),
    ("demo", "wpm", 110.0, 140.0, "inside"), ("demo", "talk_ratio", 0.6, 0.75, "inside"),
    ("sales", "talk_ratio", 0.4, 0.45, "inside"), ("sales", "interruptions_by_me", None, 1.0, "lower"),
    ("interview", "filled_pauses_per_min", None, 2.0, "lower"), ("interview", "talk_ratio", 0.5, 0.7, "inside"), ("interview", "interruptions_by_me", None, 1.0, "lower"),
    ("standup", "wpm", 110.0, 150.0, "inside"), ("standup", "filled_pauses_per_min", None, 4.0, "lower"), ("standup", "crutch_words_per_min", None, 3.0, "lower"), ("standup", "talk_ratio", 0.1, 0.4, "inside"), ("standup", "mtld", None, None, "higher"),
    ("lecture", "wpm", 90.0, 120.0, "inside"), ("lecture", "articulation_wpm", 120.0, 160.0, "inside"), ("lecture", "filled_pauses_per_min", None, 2.0, "lower"), ("lecture", "structural_pauses_per_min", 4.0, 8.0, "inside"), ("lecture", "talk_ratio", 0.85, 1.0, "inside"), ("lecture", "mtld", 70.0, None, "higher"), ("lecture", "pitch_range_st", 5.0, None, "higher"),
    ("one_on_one", "filled_pauses_per_min", None, 4.0, "lower"), ("one_on_one", "crutch_words_per_min", None, 3.0, "lower"), ("one_on_one", "talk_ratio", 0.4, 0.6, "inside"),
    ("training", "filled_pauses_per_min", None, 1.0, "lower"), ("training", "crutch_words_per_min", None, 1.0, "lower"), ("training", "hesitation_pauses_per_min", None, 3.0, "lower"), ("training", "talk_ratio", None, None, "inside"), ("training", "mtld", None, None, "higher"), ("training", "interruptions_by_me", None, None, "lower"),
]
WEIGHTS = [
    ("filled_pauses_per_min", 20.0), ("wpm", 15.0), ("pitch_range_st", 15.0), ("crutch_words_per_min", 10.0), ("hesitation_pauses_per_min", 10.0),
    ("talk_ratio", 10.0), ("phrase_final_decay_db", 5.0), ("rising_statements_share", 5.0), ("long_sentences_share", 5.0), ("interruptions_by_me", 5.0),
]
MEETING_TYPES = ["pitch", "demo", "sales", "interview", "standup", "lecture", "one_on_one", "training", "other"]
VOICE = ["pitch_median_hz", "pitch_range_st", "phrase_final_decay_db", "rising_statements_share", "jitter_pct", "shimmer_pct", "loudness_drift_db", "loudness_mean_db"]
METRICS = [
    "wpm", "articulation_wpm", "filled_pauses_per_min", "crutch_words_per_min", "structural_pauses_per_min", "hesitation_pauses_per_min", "talk_ratio", "mean_sentence_len", "long_sentences_share",
    "mtld", "interruptions_by_me", "interruptions_by_other", *VOICE,
]
# What progress shows, what its charts show, what a speaker may aim at, and what a compressed report keeps.
PROGRESS = [m for m in METRICS if m != "interruptions_by_other"]
CHARTS = ["wpm", "filled_pauses_per_min", "crutch_words_per_min", "pitch_range_st", "hesitation_pauses_per_min", "talk_ratio", "phrase_final_decay_db", "rising_statements_share"]
GOALS = ["filled_pauses_per_min", "crutch_words_per_min", "wpm", "pitch_range_st", "hesitation_pauses_per_min", "talk_ratio", "phrase_final_decay_db", "rising_statements_share", "mean_sentence_len"]
COMPRESSED = ["wpm", "articulation_wpm", "filled_pauses_per_min", "crutch_words_per_min", "structural_pauses_per_min", "hesitation_pauses_per_min", "talk_ratio", "mean_sentence_len", "long_sentences_share", "interruptions_by_me", "pitch_range_st", "phrase_final_decay_db", "rising_statements_share", "loudness_drift_db", "jitter_pct"]

# Dictionaries for the given tables (parameters of the operators).
FILLERS = [("^er+$", "er"), ("^ha+$", "ha"), ("^th$", "th")]
CRUTCHES = [("le de la", False), ("of the", False), ("to the", False), ("in the", False), ("it is", False), ("the", True), ("and", True), ("is", True)]
STARTERS = ["that", "was", "this", "for", "que"]
LONG_STARTERS = ["de la", "in der", "le de"]


# Training tasks (id, metric, seconds) in their order, and the weight of a metric that has none.
TASKS = [
    ("elevator_60", "wpm", 60), ("pause_instead", "filled_pauses_per_min", 120), ("no_crutches", "crutch_words_per_min", 120), ("hold_the_pause", "structural_pauses_per_min", 90),
    ("plan_then_speak", "hesitation_pauses_per_min", 120), ("short_sentences", "long_sentences_share", 120), ("listen_back", "talk_ratio", 180), ("let_them_finish", "interruptions_by_me", 180),
]
OTHER_WEIGHT = 3.0

# Stages of the work (name, share done before it, its own share), by the event types of the given tables.
STAGES = [("signup", 0.0, 10.0), ("view", 10.0, 30.0), ("click", 40.0, 35.0), ("purchase", 75.0, 25.0)]
