"""What a rule is: a few presence tests plus where the finding is reported.

Patterns are fixed values and are written as they are, but for two things that change no finding: a repeated word
character at an edge of a presence test is one word character, and a nested block body is a plain run.  Both spare
backtracking and work alike in both engines.  Linear forms of presence tests are derived in functions/linear.py.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Test:
    pattern: str
    present: bool = True
    fold: bool = False  # ignore case


def has(pattern: str) -> Test:
    return Test(pattern)


def has_i(pattern: str) -> Test:
    return Test(pattern, fold=True)


def lacks(pattern: str) -> Test:
    return Test(pattern, present=False)


def lacks_i(pattern: str) -> Test:
    return Test(pattern, present=False, fold=True)


@dataclass(frozen=True)
class Rule:
    """One row of the rule catalogue.

    ``line`` tests make a line rule (one finding per matching line), otherwise
    the rule is reported once per file.  ``frames`` are (first, last, tests)
    over the joined text of the lines around the matching one.  ``head`` is
    (width, test) over the text window used by the size/validation rules.
    ``at`` says which line a per-file finding points to: the first line that
    passes the test, else ``at_default`` (None: no finding at all).
    """

    key: str
    name: str
    severity: str
    bucket: str
    category: str | None
    message: str
    advice: str
    file: tuple[Test, ...] = ()
    line: tuple[Test, ...] = ()
    frames: tuple[tuple[int, int, tuple[Test, ...]], ...] = ()
    head: tuple[int, Test] | None = None
    in_loop: bool = False
    at: Test | None = None
    at_default: int | None = 1
    at_match: str | None = None
    custom: bool = False

    @property
    def detector(self) -> str:
        return self.key[:2]

    @property
    def number(self) -> int:
        return int(self.key[3:])

    @property
    def stage(self) -> int:
        return STAGES.get(self.detector, 7)  # rules added by users come last

    @property
    def penalty(self) -> float:
        return PENALTY[self.bucket][self.severity]


# fixed values: position of each detector in the emission order
STAGES = {"PT": 1, "JV": 2, "PY": 2, "AY": 3, "SM": 4, "AU": 5, "LT": 6}

# fixed values: score penalty by bucket and severity
PENALTY = {
    "security": {"critical": 15.0, "high": 10.0, "medium": 5.0, "low": 2.0},
    "performance": {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 1.0},
    "style": {"critical": 0.5, "high": 0.5, "medium": 0.5, "low": 0.5},
    "suggestion": {"critical": 8.0, "high": 5.0, "medium": 3.0, "low": 1.0},
}

# fixed values: category to bucket routing of each detector
ROUTES = {
    "JV": {"security": "security", "performance": "performance", "reliability": "security"},
    "PY": {"security": "security", "performance": "performance", "reliability": "security"},
    "AY": {"memory-leak": "performance", "concurrency": "performance"},
    "SM": {
        "reliability": "security",
        "concurrency": "security",
        "memory-leak": "performance",
        "observability": "performance",
        "testability": "performance",
    },
    "AU": {},
}
DEFAULT_ROUTE = {"JV": "style", "PY": "style", "AY": "security", "SM": "style", "AU": "security"}


def routed(key: str, name: str, severity: str, category: str, message: str, advice: str, **kw) -> Rule:
    """A rule whose bucket follows from its detector and category."""
    detector = key[:2]
    bucket = ROUTES[detector].get(category, DEFAULT_ROUTE[detector])
    return Rule(key, name, severity, bucket, category, message, advice, **kw)
