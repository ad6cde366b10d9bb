"""Common function words per language.

Fixed values: plain lists, in natural order.
"""

STOP_WORDS = {
    "de": [
        "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich",
        "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als",
    ],
    "en": [
        "the", "of", "and", "to", "in", "is", "that", "for", "it", "as",
        "with", "was", "on", "are", "by", "be", "this", "from", "or", "an",
    ],
    "es": [
        "el", "la", "los", "las", "de", "del", "y", "en", "que", "un",
        "una", "por", "con", "para", "es", "se", "no", "su", "al", "lo",
    ],
    "fr": [
        "le", "la", "les", "de", "des", "et", "un", "une", "du", "en",
        "que", "qui", "dans", "pour", "par", "sur", "avec", "est", "au", "ce",
    ],
}
