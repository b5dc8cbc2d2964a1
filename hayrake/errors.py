"""What can go wrong, by kind."""


class HayrakeError(Exception):
    pass


class DimensionMismatch(HayrakeError):
    pass


class ModelMismatch(HayrakeError):
    pass


class NonFiniteScore(HayrakeError):
    pass


class CorruptStore(HayrakeError):
    pass


class StoreStale(HayrakeError):
    pass


class StoreNotEmpty(HayrakeError):
    pass


class SymbolNotFound(HayrakeError):
    pass


class SymbolAmbiguous(HayrakeError):
    """More than one chunk has that file and symbol; `candidates` names them."""

    def __init__(self, message: str, candidates: list[str]) -> None:
        super().__init__(message)
        self.candidates = candidates


class DirtyWorktree(HayrakeError):
    pass


class IndexInProgress(HayrakeError):
    pass


class LexicalOutOfSync(HayrakeError):
    pass


class RevisionMismatch(HayrakeError):
    pass


class SearchFailed(HayrakeError):
    pass
