"""Schemas of the record types, declared once; nothing is inferred."""

RAW = "ts string, project string, session string, words int, text string"
CURATED = f"{RAW}, raw_words int"
AI_MARKED = f"{CURATED}, excluded string"
SCORES = "struct<technical: double, informal: double, editorial: double>"
TAGGED = f"{CURATED}, register string, register_scores {SCORES}"
SALVAGED = "ts string, project string, source string, words int, register string, text string"
CHAT = "ts bigint, source string, lang string, words int, text string"
EMAIL = "ts string, source string, lang string, words int, text string"
FEEDBACK = "ts string, register string, verdict string, note string"
THREAD = "participants array<struct<name: string>>, messages array<struct<sender_name: string, timestamp_ms: bigint, content: string>>"
MAIL = "source string, archive string, kind string, place long, sender string, sent string, body string"
PROFILE = "bucket string, messages bigint, words bigint, sentence_len struct<mean: double, p50: double, p90: double>, message_len_p50 double, punct_per_1k_words map<string, double>, lowercase_sentence_start_rate double, allcaps_word_per_1k double, emoji_per_1k double, contractions_per_1k double, ellipses_per_1k double, avg_word_len double, unique_word_ratio double, top_sentence_openers array<struct<opener: string, n: bigint>>, connector_use_per_1k map<string, double>, typo_per_1k double"
