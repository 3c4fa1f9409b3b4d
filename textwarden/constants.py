"""Word lists, limits, names and messages the results depend on."""

# --- fixed values: text rules -------------------------------------------------
LISTED_WORDS = ("kill", "die", "hate", "stupid", "idiot")
MIN_SCORED_LENGTH = 3
DEMO_MAX_LENGTH = 1000
TOO_SHORT_REASON = "Text too short for meaningful analysis"

# Characters that count as white space when text is stripped or split.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Default English stop words of the term extractor; pass another list to replace it.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been
    before being below between both but by can cannot could did do does doing down during
    each either else ever every few for from further get give go had has have having he
    hence her here hers herself him himself his how however i if in into is it its itself
    just keep less made many may me might mine more most much must my myself neither never
    no nor not now of off often on once only or other otherwise our ours ourselves out over
    own perhaps per rather same see seem seems several she should since so some still such
    than that the their theirs them themselves then there therefore these they this those
    though through thus to together too toward towards under until up upon us very via was
    we well were what whatever when where whether which while who whoever whole whom whose
    why will with within without would yet you your yours yourself yourselves""".split()
)

# --- fixed values: risk rules -------------------------------------------------
RISK_REVIEW_ABOVE = 5
RISK_LONG_ABOVE = 1000
RISK_SHORT_BELOW = 5
RISK_EXCLAMATIONS_ABOVE = 3

# --- fixed values: score policies ---------------------------------------------
BORDERLINE = (0.3, 0.8)
TOXIC_ABOVE = 0.5
VERDICT_WEIGHT = 0.6
MODEL_WEIGHT = 0.4
CAPS_BUMP = 0.05
PUNCTUATION_BUMP = 0.03
ACTIONS = ("allow", "review", "block")

# --- fixed values: second-opinion answers -------------------------------------
VERDICT_SCHEMA = (
    "contextual_toxicity_score DOUBLE, recommended_action STRING, confidence STRING, "
    "reasoning STRING, harm_categories ARRAY<STRING>, context_factors ARRAY<STRING>, "
    "is_sarcasm BOOLEAN, is_false_positive BOOLEAN, severity_level STRING, "
    "target_audience_risk STRING, cultural_sensitivity STRING, explanation_for_user STRING"
)
MISSING_REASONING = "Analysis incomplete - using fallback values"
DEFAULT_EXPLANATION = "Content flagged by automated system"
MODEL_ONLY_REASONS = {
    "block": "High toxicity score from ML model",
    "review": "Moderate toxicity score - needs human review",
    "allow": "Low toxicity score from ML model",
}
ROUTE_REASONS = {
    "block": "High toxicity score detected",
    "review": "Content requires human review",
    "allow": "Low toxicity score detected",
    "fallback": "Second opinion failed, defaulting to human review",
}
REVIEW_REASON = "Content requires human review based on enhanced analysis"
BLOCK_REASON = "Content blocked based on enhanced toxicity analysis"
ALERT_SUBJECT = "Content Blocked - High Toxicity Detected"
NO_TEXT_ERROR = "No text provided for prediction"
NOTHING_LEFT_ERROR = "Text is empty after cleaning"

# --- fixed values: labelled sentences and reports -----------------------------
# before, case and after of each variant
VARIANTS = {
    "toxic": (("", "upper", ""), ("", "same", "!!!"), ("Really, ", "lower", "")),
    "benign": (("Please, ", "lower", ""), ("", "same", " Please."), ("I think ", "lower", "")),
}
ISSUES = {
    "missing": "Missing values: train=%d, test=%d",
    "small": "Training data too small: %d samples",
    "skewed": "Imbalanced dataset: toxic ratio = %.3f",
}

# --- fixed values: monitoring -------------------------------------------------
ALARMS = (
    # name, metric, statistic, operator, threshold, periods, period seconds, dimensions
    ("HighErrorRate", "InvocationErrors", "Sum", ">", 10.0, 2, 300, {}),
    ("HighLatency", "ToxicityPredictionLatency", "Average", ">", 2000.0, 3, 300, {"Environment": "Production"}),
    ("LowConfidence", "HighConfidencePredictions", "Average", "<", 70.0, 5, 300, {"Environment": "Production"}),
    ("HighFalsePositiveRate", "FalsePositiveRate", "Average", ">", 20.0, 5, 900, {"Environment": "Production"}),
)
RETENTION_DAYS = {"prediction": 30, "model-performance": 90, "api-access": 30, "alerts": 7}
TERMINAL_STATES = ("Succeeded", "Failed", "Stopped")
PENDING, APPROVED = "PendingManualApproval", "Approved"
