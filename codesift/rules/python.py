"""Rules for files whose language is python."""

from .model import has, has_i, routed

# The patterns below decide what is a finding.
RULES = [
    routed("PY-01", "python/sql-injection", "critical", "security",
           "SQL text is formatted with a value.", "Pass values as the second argument of execute().",
           line=(has(r"execute\s*\(|executemany\s*\(|raw\s*\("), has(r"%s|%d|\+\s*\w|\.format\s*\(|f[\"']"))),
    routed("PY-02", "python/command-injection", "critical", "security",
           "A shell interprets the command.", "Run a list of arguments without a shell.",
           line=(has(r"os\.system\s*\(|subprocess\.call\s*\(.*shell\s*=\s*True"
                     r"|subprocess\.Popen\s*\(.*shell\s*=\s*True"),)),
    routed("PY-03", "python/unsafe-pickle", "critical", "security",
           "Loading a pickle can run code.", "Use JSON for data from outside.",
           line=(has(r"pickle\.load|pickle\.loads|cPickle\.load"),)),
    routed("PY-04", "python/hardcoded-secret", "critical", "security",
           "A credential is written into the source.", "Read it from the environment.",
           line=(has_i(r"(?:password|secret|api_key|token)\s*=\s*[\"'][^\"']{4,}[\"']"),)),
    routed("PY-05", "python/eval", "critical", "security",
           "eval() runs whatever text it gets.", "Parse literals with ast.literal_eval().",
           line=(has(r"(?:^|\W)eval\s*\("),)),
]
