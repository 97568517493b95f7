"""What goes wrong, as the scalar facade raises it; bulk queries carry an ``error`` column instead."""

from __future__ import annotations


class RegionError(ValueError):
    """A malformed, unknown or out-of-range region."""


class ChromosomeMismatchError(ValueError):
    """An annotation names sequences that the assembly lacks; ``missing`` has all of them."""

    def __init__(self, missing: list[str]) -> None:
        self.missing = missing
        shown = ", ".join(missing[:10]) + (f", and {len(missing) - 10} more" if len(missing) > 10 else "")
        super().__init__(f"the assembly has no {shown}")


class AnnotationNotRegisteredError(KeyError):
    """A path or feature was asked of an annotation that isn't registered."""


class NoGeneCategoriesError(LookupError):
    """No contributor of an annotation ships a gene list."""


class GeneCategoryNotDeclaredError(LookupError):
    """Lists ship, but none declares the category."""


class GeneListAssemblyMismatchError(ValueError):
    """A list of another assembly was asked."""


class ChimeraNamingError(ValueError):
    """Names that make no multi-organism reference, or can't be taken apart again."""


class AmbiguousDefaultAnnotationError(ValueError):
    """A component has annotations and no default among them."""


class ChecksumMismatchError(ValueError):
    """Content whose digest isn't the one expected."""


class RegistrationError(RuntimeError):
    """A registered folder can't be trusted."""


class UnfinishedRegistrationError(RegistrationError):
    """Files without a record."""


class RegistrationMismatchError(RegistrationError):
    """A record that disagrees with what is there."""


class CuratedGeneListError(ValueError):
    """A curated gene list that isn't what one must be."""


class MetadataRowError(ValueError):
    """A row of a metadata table with a cell that can't be read."""


class IndexNotBuiltError(LookupError):
    """An index was asked for that no record says is finished."""


class ClosedGenomeError(RuntimeError):
    """A genome was asked after it was closed."""
