"""Fixed values that results depend on.

FIXED VALUES -- these must stay equal to the behaviour being reproduced.
They are stated once here, in natural order, and used everywhere else.
"""

# --- enumerations -----------------------------------------------------------
ITEM_TYPES = ["movie", "book", "song", "course", "product"]
INTERACTION_TYPES = ["view", "click", "like", "dislike", "purchase", "rating", "bookmark"]
STRATEGIES = ["content_based", "collaborative", "hybrid"]

# --- interaction strength weights (rating with a value uses value / 10) -----
INTERACTION_WEIGHTS = {
    "view": 0.1,
    "click": 0.2,
    "like": 0.7,
    "dislike": -0.5,
    "purchase": 1.0,
    "rating": 1.0,
    "bookmark": 0.5,
}
DEFAULT_WEIGHT = 0.1
RATING_SCALE = 10.0

# --- positive signals ("liked" list) -----------------------------------------
POSITIVE_TYPES = ["like", "purchase", "bookmark"]
HIGH_RATING = 7.0

# --- validation limits -------------------------------------------------------
ID_MAX_LEN = 100
TITLE_MAX_LEN = 500
DESCRIPTION_MAX_LEN = 5000
VALUE_MIN = 0.0
VALUE_MAX = 10.0

# --- content model defaults --------------------------------------------------
MAX_FEATURES = 5000
MIN_DF = 1
NGRAM_MAX = 2
DEFAULT_TEXT_FIELDS = ["title", "description"]
DEFAULT_CATEGORICAL_FIELDS = ["item_type"]
UNKNOWN_CATEGORY = "unknown"
# runs of two or more letters, digits or underscores
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# --- collaborative model defaults --------------------------------------------
N_FACTORS = 50
N_FACTORS_CAP = 100
N_ITERATIONS = 20

# --- blending ----------------------------------------------------------------
CONTENT_WEIGHT = 0.4
COLLAB_WEIGHT = 0.6
COLD_START_CONTENT_WEIGHT = 0.8
COLD_START_COLLAB_WEIGHT = 0.2
COLD_START_THRESHOLD = 5
SIMILAR_OVERFETCH = 2
BLEND_OVERFETCH = 3
COLLAB_NEIGHBOUR_DISCOUNT = 0.8
FALLBACK_SCORE = 0.5

EXPLAIN_SIMILAR_CONTENT = "Similar content features"
EXPLAIN_USERS_ALSO_LIKED = "Users also liked"
EXPLAIN_CONTENT = "Based on your preferences"
EXPLAIN_COLLAB = "People like you enjoyed"
EXPLAIN_BOTH = "Recommended for you"
EXPLAIN_FALLBACK = "Popular item"

# --- ranking tie rule: score rounded to this many places, then id ascending --
RANK_PLACES = 9
OUT_PLACES = 6

# --- request limits, latency histogram ----------------------------------------
MAX_RECOMMENDATIONS = 100
LATENCY_BUCKETS_S = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
RESULT_TTL_S = 3600

# --- English stop words: Spark ML's default English list (StopWordsRemover),
# --- used because the original list lives in a library absent here.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't "
    "didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's "
    "how's let's ought that's there's what's when's where's who's why's would"
).split()
