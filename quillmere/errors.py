"""What can go wrong, by name."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class NoResults(EngineError):
    """A search found nothing."""


class NotFound(EngineError):
    """A document isn't in the registry."""


class NotReady(EngineError):
    """A document is registered but not ingested."""


class Unsupported(EngineError):
    """A format that no parser reads."""


class ParseFailed(EngineError):
    """A parser gave an error."""


class EmptyFile(EngineError):
    """A file has no section."""


class EmbeddingFailed(EngineError):
    """No text of a run could be embedded."""


class ExtractionFailed(EngineError):
    """The graph could be extracted from no chunk."""


class ReasoningFailed(EngineError):
    """The model gave no answer."""


class BadConfig(EngineError):
    """A setting is out of its bounds."""


class WrongDimension(EngineError):
    """A vector isn't of the store's dimension."""


class Closed(EngineError):
    """The engine was closed."""


class ProviderFailed(EngineError):
    """A model's server can't be reached or refuses."""
