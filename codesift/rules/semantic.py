"""Rules about logic and design, one or more findings per file."""

from .model import has, has_i, lacks, lacks_i, routed

# The patterns below decide what is a finding.
LISTENER_GATE = r"\.on\s*\(\s*['\"][^'\"]+['\"]\s*,|addEventListener"
LISTENER = r"\.on\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*(?:async\s*)?\(?([^)]*)\)?\s*=>\s*\{?"
LISTENER_GUARD = r"try\s*\{|\.catch\s*\("
LISTENER_WINDOW = 200
LOOP_WAIT = r"while\s*\([^)]+\.length|while\s*\([^)]+\)\s*\{[\s\S]*?await"
LOOP_LOCK = r"running\s*=\s*true|locked\s*=\s*true|mutex|semaphore"
WHILE_HEAD = r"while\s*\(([^)]+)\)"
AFTER_AWAIT = r"await[^;]+;([\s\S]{0,100})"
QUEUE_CHECK = r"\.length|queue\.|pending"
RETRY_COUNT = r"retries?\s*(\+\+|\+\s*=\s*1)|retries?\s*<\s*\d"
RETRY_LINE = r"retries?\s*(\+\+|\+\s*=)|retries?\s*<"
DELAY_WORD = r"setTimeout|delay|sleep|backoff|wait"
CATCH_GATE = r"catch\s*\(\s*(\w+)\s*\)"
CATCH_BODY = r"catch\s*\(\s*(\w+)\s*\)\s*\{([^}]*)\}"
STATE_FIELD = r"this\.(\w+)\s*="
NESTED_ARROWS = r"=>\s*\{[^}]*=>\s*\{[^}]*=>\s*\{"
LIMITER = r"rate.*limit|limiter|throttle|quota"
LIMITER_CONTEXT = r"window|count|request"
MODULE_VALUE = r"(?:const|let|var)\s+\w+\s*=\s*(?:new \w+|\{\}|\[\])"
MODULE_NAME = r"^^(?:const|let|var)\s+(\w+)\s*="
HANDLER = r"function\s+\w*\s*\(.*req|app\.(get|post|put|delete)|router\.|handler"

RULES = [
    routed("SM-01", "semantic/unprotected-listener", "critical", "reliability",
           "The listener for '{}' does not handle errors.", "Catch errors inside the callback.",
           file=(has(LISTENER_GATE),), custom=True),
    routed("SM-02", "semantic/listener-leak", "high", "memory-leak",
           "Listeners are added and never removed.", "Remove listeners on clean-up.",
           file=(has(LISTENER_GATE), has(r"addEventListener|\.on\s*\("),
                 lacks(r"removeEventListener|\.off\s*\(|\.removeListener\s*\("))),
    routed("SM-03", "semantic/async-reentry", "high", "concurrency",
           "Items that arrive while the loop waits may be missed.", "Look at the queue again after each wait.",
           file=(has(LOOP_WAIT), has(WHILE_HEAD), lacks_i(LOOP_LOCK)), at_match=WHILE_HEAD),
    routed("SM-04", "semantic/async-reentry-check", "medium", "concurrency",
           "The queue is not checked after a wait.", "Test the queue length again after await.",
           file=(has(LOOP_WAIT), has(WHILE_HEAD), has_i(LOOP_LOCK), has(AFTER_AWAIT)),
           at_match=WHILE_HEAD, custom=True),
    routed("SM-05", "semantic/retry-storm", "critical", "reliability",
           "Retries follow each other without a pause.", "Wait longer before each further attempt.",
           file=(has(RETRY_COUNT), lacks_i(DELAY_WORD)), at=has(RETRY_LINE)),
    routed("SM-06", "semantic/retry-no-backoff", "medium", "reliability",
           "Retries wait for a fixed time.", "Let the pause grow with each attempt.",
           file=(has(RETRY_COUNT), has_i(DELAY_WORD), lacks_i(r"Math\.pow|exponential|\*\s*2|\*\s*retries")),
           at=has(RETRY_LINE)),
    routed("SM-07", "semantic/retry-starvation", "high", "concurrency",
           "A failing task goes straight back into the queue.", "Send failed tasks to a delayed queue.",
           file=(has(r"\.push\s*\(\s*item\s*\)|\.push\s*\(\s*\{[^}]*retries"), has(r"while\s*\([^)]+\.length")),
           at=has(r"\.push\s*\(.*(?:item|task|job)")),
    routed("SM-08", "semantic/unbounded-queue", "high", "memory-leak",
           "A queue grows without a limit.", "Refuse new items beyond a limit.",
           file=(has(r"\.push\s*\("), has_i(r"queue|buffer|pending|tasks|items"),
                 lacks_i(r"\.length\s*[<>]\s*\d|MAX_|LIMIT|capacity|isFull")),
           at=has_i(r"(?:queue|buffer|pending|tasks)\s*[=:]")),
    routed("SM-09", "semantic/no-shutdown", "medium", "reliability",
           "A long-running process cannot be stopped cleanly.", "Handle the termination signals.",
           file=(has(r"while\s*\(\s*true|setInterval|\.on\s*\("),
                 lacks_i(r"SIGTERM|SIGINT|shutdown|cleanup|dispose|destroy|close\s*\(|stop\s*\("))),
    routed("SM-10", "semantic/error-context", "low", "observability",
           "The caught error '{}' is not kept with its context.", "Record its message and stack.",
           file=(has(CATCH_GATE),), custom=True),
    routed("SM-11", "semantic/async-state-race", "medium", "concurrency",
           "Async methods share {} without a lock.", "Guard the shared state.",
           file=(has(r"class\s+\w"), has(STATE_FIELD), has(r"async\s+\w+\s*\("),
                 lacks_i(r"mutex|lock|semaphore|synchronized")), custom=True),
    routed("SM-12", "semantic/callback-hell", "medium", "maintainability",
           "Callbacks are nested three deep in {} places.", "Name the inner functions or use await.",
           file=(has(NESTED_ARROWS),), custom=True),
    routed("SM-13", "semantic/nondeterministic", "low", "testability",
           "Random behaviour cannot be repeated in a test.", "Inject the random source.",
           file=(has(r"Math\.random\s*\(\)"), has_i(r"retry|backoff|delay|test|spec")),
           at=has(r"Math\.random\s*\(\)"), at_default=0),
    routed("SM-14", "design/fixed-window-limiter", "high", "design",
           "A fixed window lets double bursts through.", "Use a sliding window or a bucket.",
           file=(has(r"Date\.now\(\)|new Date\(\)"), has(r"count\s*[+<>=]|\.count"),
                 lacks_i(r"sliding|token.*bucket|leaky.*bucket|rolling")),
           at=has_i(r"window|start|timestamp")),
    routed("SM-15", "design/no-retry-after", "medium", "design",
           "Refused callers are not told when to come back.", "Send the waiting time along.",
           file=(has_i(r"throw.*Error|return.*false|reject"), lacks_i(r"retry.*after|retryAfter|Retry-After"))),
    routed("SM-16", "design/single-process-limiter", "high", "design",
           "The limiter state lives in one process.", "Keep the counters in a shared store.",
           file=(has(r"this\.\w+\s*=\s*\{\}|this\.\w+\s*=\s*\[\]|new Map\(\)"),
                 lacks_i(r"redis|memcache|database|db\.|cluster|distributed"))),
    routed("SM-17", "design/clock-drift", "medium", "reliability",
           "The wall clock may jump during a measurement.", "Measure with a monotonic clock.",
           file=(has(r"Date\.now\(\)"), has_i(r"[<>]=?\s*\w+\.\w+|diff|elapsed|window"),
                 lacks_i(r"performance\.now|process\.hrtime|monotonic")),
           at=has(r"Date\.now\(\)"), at_default=0),
    routed("SM-18", "design/no-eviction", "high", "memory-leak",
           "Stored entries are never evicted.", "Give entries a life time or bound the store.",
           file=(has_i(r"this\.\w+\s*=\s*\{\}|new Map\(\)|cache|store|registry"),
                 lacks_i(r"delete\s+|\.delete\s*\(|evict|expire|ttl|lru|maxSize|max_size|cleanup"),
                 lacks(r"WeakMap"), has(r"\[\w+\]\s*=")),
           at=has_i(r"=\s*\{\}|new Map\(\)")),
    routed("SM-19", "design/non-atomic-increment", "high", "concurrency",
           "A counter is changed without protection.", "Use an atomic operation or a lock.",
           file=(has(r"\w\s*\+\+|\w\s*\+=\s*1|\w\s*=\s*\+\s*1"),
                 has_i(r"async|Promise|concurrent|parallel|request|handler"),
                 lacks_i(r"mutex|lock|semaphore|atomic|synchronized")),
           at=has(r"\+\+|\+=\s*1"), at_default=None),
    routed("SM-20", "design/global-mutable-state", "high", "concurrency",
           "Request handlers change a module variable.", "Keep state per request.",
           file=(has(MODULE_VALUE), has_i(HANDLER), lacks_i(r"singleton|instance")), custom=True),
    routed("SM-21", "design/no-backpressure", "medium", "reliability",
           "Producers are never slowed down.", "Refuse or pause producers when the queue is full.",
           file=(has_i(r"\.push\s*\(|\.add\s*\(|enqueue"), has_i(r"queue|buffer|pending"),
                 lacks_i(r"reject|throw|isFull|highWaterMark|backpressure|pause|maxSize"))),
]
