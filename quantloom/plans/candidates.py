"""Research candidates and the split between research sample and holdout."""

from quantloom.config import FAMILY_FEATURES, RESEARCH_EXTRAS

CANDIDATES = (
    *[(f, up, fam) for fam, members in FAMILY_FEATURES.items() for f, up in members.items()],
    *RESEARCH_EXTRAS,
)
SPLIT = "1999-12-31"
