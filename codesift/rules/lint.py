"""Token-level rules for javascript and typescript (our own definitions)."""

from .model import Rule, has

# The patterns below decide what is a finding.
DECLARED = r"(?:^|\W)(?:const|let|var)\s+(\w+)"
WORD = r"\w+"

RULES = [
    Rule("LT-01", "lint/no-eval", "high", "security", None,
         "eval() runs text as code.", "Parse data instead of running it.",
         line=(has(r"(?:^|\W)eval\s*\("),)),
    Rule("LT-02", "lint/no-implied-eval", "high", "security", None,
         "A timer runs text as code.", "Give the timer a function.",
         line=(has(r"set(?:Timeout|Interval)\s*\(\s*['\"`]"),)),
    Rule("LT-03", "lint/no-new-func", "high", "security", None,
         "The Function constructor runs text as code.", "Declare the function.",
         line=(has(r"new\s+Function\s*\("),)),
    Rule("LT-04", "lint/no-await-in-loop", "medium", "performance", None,
         "Each loop turn waits for the one before.", "Start all work and wait once with Promise.all.",
         line=(has(r"(?:^|\W)await(?:\W|$)"),), in_loop=True),
    Rule("LT-05", "lint/no-console", "medium", "style", None,
         "Console output is left in the code.", "Use a logger.",
         line=(has(r"(?:^|\W)console\.\w+\s*\("),)),
    Rule("LT-06", "lint/no-debugger", "high", "style", None,
         "A debugger statement is left in the code.", "Remove it.",
         line=(has(r"^\s*debugger(?:\W|$)"),)),
    Rule("LT-07", "lint/no-unused-vars", "medium", "style", None,
         "'{}' is declared and not used.", "Remove the variable.",
         line=(has(DECLARED),), custom=True),
]
