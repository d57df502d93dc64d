"""Fixed values of the track-similarity model, stated as they must be for equal results."""

# Largest tempo difference in percent, inclusive.
MAX_TEMPO_PCT = 8.0
# Weights of the three costs, and additive penalties by edge type.
WEIGHTS = {"harmonic": 0.35, "tempo": 0.25, "semantic": 0.40}
PENALTIES = {"double": 0.0, "triplet": 0.0}
# Factors on the second track's tempo, in order, and the edge type each gives.
TEMPO_FACTORS = [(1.0, "direct"), (2.0, "double"), (0.5, "double"), (1.5, "triplet"), (0.75, "triplet")]
EDGE_TYPES = ["direct", "double", "triplet"]
# Semitone of each pitch, and the sharp that a flat equals.
SEMITONES = {"C": 0, "C#": 1, "D": 2, "D#": 3, "E": 4, "F": 5, "F#": 6, "G": 7, "G#": 8, "A": 9, "A#": 10, "B": 11}
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}
# File name endings of audio, in lower case.
AUDIO_EXTENSIONS = [".mp3", ".wav", ".flac", ".ogg", ".m4a", ".aac", ".wma", ".aiff"]
# Share of equal fingerprint bits that makes a duplicate.
FINGERPRINT_ALIKE = 0.8
# Seconds of the shortest, longest and least valid chunk; beats of a phrase;
# upper bounds in seconds of the short and medium buckets.
CHUNK_MIN, CHUNK_MAX, CHUNK_VALID, PHRASE_BEATS = 12.0, 30.0, 1.0, 32
BUCKET_SHORT, BUCKET_MEDIUM = 17.0, 24.0
# First beat that starts an intro test, its look-back, half window and ratio.
INTRO_FROM, INTRO_BACK, INTRO_WINDOW, INTRO_RATIO = 5.0, 30.0, 0.025, 2.0
# Least seconds and loudness of usable audio, and the duration assumed when unknown.
LEAST_SECONDS, LEAST_RMS, DEFAULT_DURATION = 1.0, 1e-4, 210.0
# Attempts of a walk, cheapest candidates it draws from, share of the target
# after which the ending key counts; default and largest k; search results.
ATTEMPTS, SHORTLIST, ENDING_FROM = 60, 10, 0.75
TOP_K, MOST_K, SEARCH_LIMIT = 10, 50, 50
# Neighbours, least distance, components and seed of a reduction.
REDUCE = {"n_neighbors": 15, "min_dist": 0.1, "n_components": 32, "seed": 42}
# Least weight of an edge in the layout, rounds and seed.
LAYOUT = {"least_weight": 1e-6, "rounds": 2000, "seed": 42}
EMBEDDING_SIZE = 768
EMBED_RATE, ANALYSIS_RATE = 24_000, 44_100
