"""Exceptions of the engine."""


class SpanloomError(Exception):
    """Base of all engine errors."""


class LexiconError(SpanloomError):
    """A lexicon is missing, incomplete or not readable."""


class MorphError(SpanloomError):
    """A grammeme or form that the morphology layer cannot use."""


class TokenizerError(SpanloomError):
    """The tokenizer cannot be set up or its input has the wrong shape."""


class GrammarError(SpanloomError):
    """A rule that cannot be compiled or executed."""
