"""Fixed values that results depend on."""

from __future__ import annotations

RETRIEVAL_TOP_K = 12
FEATURE_VERSION = "v1"

SOURCE_TYPES = ("prose", "code", "table", "other")
NUMERIC_FEATURES = (
    "tfidf_similarity",
    "retrieval_rank",
    "score_margin",
    "query_token_overlap_ratio",
    "exact_phrase_overlap",
    "title_or_heading_overlap",
    "entity_overlap",
    "normalized_chunk_length",
    "neighbor_relevance",
)
CATEGORICAL_FEATURES = ("source_type",)

# Retention presets: name -> (threshold, min_context, token_budget).
PRESETS = {
    "conservative": (0.35, 3, 3000),
    "balanced": (0.5, 2, 2000),
    "aggressive": (0.65, 1, 1200),
}
DEFAULT_PRESET = "balanced"
MESSAGE_PRESET = "conservative"
BOUNDARY_MARGIN = 0.05

# Session calibration bounds and steps.
MIN_THRESHOLD = 0.15
MAX_THRESHOLD = 0.85
MAX_MIN_CONTEXT = 6
MAX_TOKEN_BUDGET = 6000
THRESHOLD_STEP_DOWN = 0.05
THRESHOLD_STEP_UP = 0.02
MIN_CONTEXT_STEP = 1
TOKEN_BUDGET_STEP = 200
STREAK_FOR_RELAXATION = 3

# Guards of the per-session model update.
MAX_COEF_DISTANCE = 3.0
CANARY_MIN_RECALL = 0.5
CANARY_MAX_RECALL_DROP = 0.15
CANARY_SIZE = 20
WEIGHT_BY_PROVENANCE = {"explicit_user_mark": 1.0, "counterfactual_restore": 0.5}
DEFAULT_LABEL_WEIGHT = 0.25
UPDATE_RATE = 0.05
UPDATE_L2 = 1e-4

# Answer validation.
COVERAGE_THRESHOLD = 0.3
SENTENCE_SUPPORT_THRESHOLD = 0.3
ANSWER_GROUNDED_THRESHOLD = 0.5

SPLIT_NAMES = ("train", "val", "test")
SPLIT_RATIOS = (0.6, 0.2, 0.2)

# Delimiters of prunable context inside a message.
MARKER_OPEN = "<gleaner:context>"
MARKER_CLOSE = "</gleaner:context>"

# Phrases that a report may not contain, in the order they are looked for.
BANNED_PHRASES = (
    "slashes cost by",
    "guarantees",
    "guaranteed",
    "proves correct",
    "100% accurate",
    "always correct",
    "risk-free",
    "no downside",
)

# Prompt wording.
SYSTEM_INSTRUCTION = (
    "You are a helpful assistant answering questions using only the "
    "provided context. If the context does not contain the answer, say "
    "you don't know rather than guessing."
)
EMPTY_CONTEXT = "(no context retrieved)"

# The English stop-word list (318 words, alphabetical).
STOP_WORDS = tuple(
    """
a about above across after afterwards again against all almost alone along
already also although always am among amongst amoungst amount an and another
any anyhow anyone anything anyway anywhere are around as at back be became
because become becomes becoming been before beforehand behind being below
beside besides between beyond bill both bottom but by call can cannot cant
co con could couldnt cry de describe detail do done down due during each eg
eight either eleven else elsewhere empty enough etc even ever every everyone
everything everywhere except few fifteen fifty fill find fire first five for
former formerly forty found four from front full further get give go had has
hasnt have he hence her here hereafter hereby herein hereupon hers herself
him himself his how however hundred i ie if in inc indeed interest into is
it its itself keep last latter latterly least less ltd made many may me
meanwhile might mill mine more moreover most mostly move much must my myself
name namely neither never nevertheless next nine no nobody none noone nor
not nothing now nowhere of off often on once one only onto or other others
otherwise our ours ourselves out over own part per perhaps please put rather
re same see seem seemed seeming seems serious several she should show side
since sincere six sixty so some somehow someone something sometime sometimes
somewhere still such system take ten than that the their them themselves
then thence there thereafter thereby therefore therein thereupon these they
thick thin third this those though three through throughout thru thus to
together too top toward towards twelve twenty two un under until up upon us
very via was we well were what whatever when whence whenever where
whereafter whereas whereby wherein whereupon wherever whether which while
whither who whoever whole whom whose why will with within without would yet
you your yours yourself yourselves
""".split()
)
