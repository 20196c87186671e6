"""Concurrency rules, for files that show asynchronous or React code."""

from .model import has, lacks, routed

# The patterns below decide what is a finding.
ASYNC_TOKENS = r"async\s+function|async\s*\(|\.then\(|await\s"
REACT_TOKENS = r"import\s+.*React|useEffect|useState|useRef"
PROMISE_ASSIGNED = r"(\w+)\s*=\s*(?:fetch|axios|new Promise)"
PROMISE_SOURCE = r"\s*=\s*(?:fetch|axios|new Promise)"
AWAITED = r"await\s+"
OVERWRITE_SPAN = 9

RULES = [
    routed("AY-01", "async/foreach-async", "high", "concurrency",
           "forEach does not wait for an async callback.", "Use for...of with await, or Promise.all.",
           line=(has(r"\.forEach\s*\(\s*async"),)),
    routed("AY-02", "async/memory-leak-interval", "medium", "memory-leak",
           "An interval is started and its handle is lost.", "Keep the handle and clear it on clean-up.",
           line=(has(r"setInterval\s*\("), lacks(r"(?:const|let|var)\s+\w+\s*=\s*setInterval"))),
    routed("AY-03", "async/missing-abort-controller", "low", "concurrency",
           "A request cannot be cancelled.", "Pass the signal of an AbortController.",
           line=(has(r"fetch\s*\("),), frames=((-10, 9, (lacks(r"AbortController|signal\s*:"),)),)),
    routed("AY-04", "async/stale-closure", "medium", "concurrency",
           "A timer in an effect without dependencies sees old values.", "List the dependencies or use a ref.",
           file=(has(REACT_TOKENS),), line=(has(r"useEffect\s*\(\s*\(\s*\)\s*=>\s*\{"),),
           frames=((0, 19, (has(r"setTimeout|setInterval"), has(r"\[\s*\]\s*\)"))),)),
    routed("AY-05", "async/infinite-loop", "critical", "concurrency",
           "An endless loop has no exit.", "Add a condition that ends the loop.",
           line=(has(r"while\s*\(\s*true\s*\)|for\s*\(\s*;\s*;\s*\)"),),
           frames=((0, 14, (lacks(r"break\s*;|return\s"),)),)),
    routed("AY-06", "async/promise-overwrite", "high", "concurrency",
           "The promise in '{}' is replaced before anyone waits for it.",
           "Keep each promise in its own variable.",
           line=(has(PROMISE_ASSIGNED),), custom=True),
]
