"""English metrics: word lists and constants. MIT notice: NOTICE.md."""

# Single words of the first tier, weight 1.0.
TIER1 = ["delve", "delves", "delving", "tapestry", "testament", "underscore", "underscores", "underscoring", "leverage", "leverages", "leveraging", "multifaceted", "realm", "interplay", "seamless", "seamlessly", "groundbreaking"]
# Single words of the second tier, weight 0.6.
TIER2 = ["crucial", "pivotal", "vibrant", "robust", "foster", "fosters", "fostering", "enhance", "enhances", "enhancing", "showcase", "showcases", "notably", "moreover", "furthermore", "garner", "bolster", "utilize", "utilizes", "reshaping", "poised", "thrive", "thrives"]
# Phrases, weight 1.0.
PHRASES = ["it's worth noting", "it is worth noting", "it is important to note", "in today's", "rapidly evolving", "the future looks bright", "in conclusion", "cutting-edge", "walks of life", "push the boundaries"]
# Window, short sample, weights and anchors of the composite score, thresholds of findings.
WINDOW, SHORT = 50, 40
WEIGHT_TIER1, WEIGHT_TIER2, WEIGHT_PHRASE = 1.0, 0.6, 1.0
COV_HUMAN, TTR_LOW, TTR_HIGH, REP_MAX, VOCAB_MAX = 0.66, 0.3, 0.72, 0.18, 0.035
WEIGHTS = {"burstiness": 0.28, "diversity": 0.18, "repetition": 0.14, "lexical": 0.4}
FINDING, HIGH = 30, 50
VERDICTS = [(20, "Pristine"), (40, "Mostly human"), (60, "Mixed"), (80, "AI-leaning")]
LAST_VERDICT, NO_TEXT = "Pure AI smell", "No text"
