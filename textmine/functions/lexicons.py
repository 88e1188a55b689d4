"""Fixed values.

Everything in this module is a value that has to equal the studied
workload's constants for results to agree (word lists, dictionary
keys and their patterns, window size).  They are stated once, plainly,
in their natural order.  Patterns are glob patterns: ``*`` = any run of
characters, ``?`` = one character; a space separates the words of a
multi-word pattern.
"""

# ---------------------------------------------------------------- fixed values
# Negation dictionary for window negation tagging (key "neg").  Each entry
# is followed by "*": one mandatory extra token after the negator words.
NEGATION_PATTERNS = [
    "no *", "not *", "*n't *", "never *", "neither *", "nor *", "none *",
    "nobody *", "nowhere *", "nothing *", "cannot *", "can not *",
    "without *", "no one *", "no way *",
]
NEGATION_WINDOW = 15

# Personal pronoun dictionary (first and third person).
PRONOUNS = {
    "FPP": ["I", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves"],
    "TPP": ["he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
            "itself", "they", "them", "their", "theirs", "themselves", "themself"],
}

# Negation word list of the marker/lexicon feature set; the first variant
# starts with the pattern ".+n't" (kept verbatim: as a glob it matches only
# tokens that literally start with ".").
SEM_NEGATION_WITH_NT = [".+n't", "no", "not", "without", "never", "nothing", "none", "nor",
                        "nobody", "contrary", "failure", "fail", "except", "prevent",
                        "neglected", "nowhere", "refused", "absence", "neither"]
SEM_NEGATION = ["no", "not", "without", "never", "nothing", "none", "nor", "nobody",
                "contrary", "failure", "fail", "except", "prevent", "neglected",
                "nowhere", "refused", "absence", "neither"]

# Section dictionary (case-sensitive keys).
SECTIONS = {
    "One": ["Introduction", "Motivation"],
    "Two": ["Background", "Prior Work", "Previous Work"],
    "Three": ["Experiments", "Data", "Results", "Evaluation"],
    "Four": ["Discussion", "Conclusion", "Future Work"],
}

# Universal POS tags looked for by the closest-item features.
CLOSEST_TAGS = ["VERB", "ADJ", "ADV"]

# Citation-marker vocabularies: (target, other, markup).  "tags" markup is
# <X>...</X>; "bare" markup is <X>.
MARKERS_TREF = ("TREF", "REF", "tags")
MARKERS_CIT = ("CIT", "OTH", "bare")

# Class-level top-k used for feature selection.
TOP_K = 1000
# ------------------------------------------------------------ end fixed values


def lexicon_dictionary(negation=SEM_NEGATION_WITH_NT) -> dict[str, list[str]]:
    """Pronoun keys plus the negation key, in that order."""
    d = {k: list(v) for k, v in PRONOUNS.items()}
    d["Negation"] = list(negation)
    return d
