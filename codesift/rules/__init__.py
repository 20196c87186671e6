"""The rule catalogue: all rules in emission order."""

from . import asynchronous, auth, java, lint, pattern, python, semantic
from .model import PENALTY, Rule, Test, has, has_i, lacks, lacks_i

CATALOGUE: list[Rule] = [
    *pattern.RULES, *java.RULES, *python.RULES, *asynchronous.RULES,
    *semantic.RULES, *auth.RULES, *lint.RULES,
]
BY_KEY: dict[str, Rule] = {r.key: r for r in CATALOGUE}

__all__ = ["CATALOGUE", "BY_KEY", "PENALTY", "Rule", "Test", "has", "has_i", "lacks", "lacks_i"]
