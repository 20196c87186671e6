"""Rules about login, token refresh and waiting callers."""

from .model import has, has_i, lacks_i, routed

# The patterns below decide what is a finding.
AUTH_TOKENS = r"refresh|token|auth|login|logout|session|credentials|bearer"
CALLBACK_QUEUE = (r"(?:pending|queue|waiting|subscribers|callbacks)\s*[\[.:]"
                  r"|\.push\s*\(\s*(?:resolve|reject|callback|cb|handler)")
RESOLVES_ALL = r"\.forEach\s*\(\s*(?:\w+\s*=>\s*\w+\s*\(|(?:resolve|reject|cb|callback))"
CLEARS = r"=\s*\[\s*\]|\.length\s*=\s*0|\.splice\s*\(\s*0|\.shift\s*\(\s*\)"
ERROR_PATH = r"catch\s*\(|\.catch\s*\(|if\s*\(\s*(?:error|err|e)\s*\)|error\s*\)\s*\{"
CATCH_BLOCK = r"catch\s*\([^)]*\)\s*\{([^}]*)\}"
BODY_CLEARS = r"=\s*\[\s*\]|\.length\s*=\s*0|\.splice\s*\(0"
BODY_ITERATES = r"\.forEach|\.map\s*\(|while\s*\([^)]*\.length"
IF_HEAD = r"if\s*\([^)]*\)\s*\{"
ELSE_HEAD = r"\s*else\s*\{"
IF_RESOLVES = r"\.forEach\s*\([^)]*(?:resolve|reject)"
ELSE_CLEARS = r"=\s*\[\s*\]"
ELSE_NOTIFIES = r"\.forEach|\.reject"
REFRESH_FLAG = (r"(?:let|var)\s+(is(?:Refreshing|Loading|Fetching|Pending)|refreshing|tokenRefresh\w*)"
                r"\s*=\s*(?:false|true)")
RACE_GUARD = r"mutex|lock|semaphore|atomic|Promise\.race|single.*refresh|once"
FINALLY_FALSE = r"finally\s*\{[^}]*false"
REFRESH_CALL = r"refresh\s*\(|refreshToken|getNewToken|renewToken"
EXPIRED = r"401|Unauthorized|token.*expired|expired.*token"
STATE_NAME = (r"(?:let|var)\s+(token|accessToken|refreshToken|authToken|currentUser|isRefreshing|pendingRequests)"
              r"\s*=")
SCOPE_OPENS = r"function\s*\w*\s*\(|=>\s*\{|\{\s*$"
SCOPE_CLOSES = r"^\s*\}"
QUEUE_FLUSH = r"\.forEach\s*\(\s*(?:\w+\s*=>\s*\w+\s*\.|(?:cb|callback|resolve|req|handler)\s*=>)"

RULES = [
    routed("AU-01", "auth/promise-liveness", "critical", "concurrency",
           "The error path drops waiting callers.", "Reject every waiting caller before clearing.",
           file=(has_i(CALLBACK_QUEUE), has_i(ERROR_PATH)), custom=True),
    routed("AU-02", "auth/lost-requests-on-error", "critical", "concurrency",
           "Only the success branch answers waiting callers.", "Reject them in the other branch too.",
           file=(has_i(CALLBACK_QUEUE), has(IF_RESOLVES), has(ELSE_CLEARS)), custom=True),
    routed("AU-03", "auth/lost-promises", "critical", "concurrency",
           "A callback queue is cleared without telling anyone.", "Call every callback before clearing.",
           file=(has_i(CALLBACK_QUEUE), has(CLEARS), lacks_i(RESOLVES_ALL)),
           at=has(r"=\s*\[\s*\]|\.length\s*=\s*0")),
    routed("AU-04", "auth/unresolved-promises", "critical", "concurrency",
           "Callers are queued and nothing answers them.", "Resolve or reject every queued caller.",
           file=(has_i(CALLBACK_QUEUE), has_i(r"\.push\s*\(\s*(?:new Promise|resolve|reject|\{\s*resolve|\{\s*reject)"),
                 lacks_i(r"\.forEach\s*\([^)]*(?:resolve|reject)"
                         r"|while\s*\([^)]*\.length[^)]*\)[^{]*\{[^}]*(?:resolve|reject)"))),
    routed("AU-05", "auth/refresh-race", "critical", "concurrency",
           "Two callers can pass the check of '{}' together.", "Share one refresh promise.",
           file=(has_i(REFRESH_FLAG), lacks_i(RACE_GUARD)), custom=True),
    routed("AU-06", "auth/stuck-state", "high", "reliability",
           "'{}' is set more often than it is cleared.", "Clear it in a finally block.",
           file=(has_i(REFRESH_FLAG),), custom=True),
    routed("AU-07", "auth/missing-finally", "high", "reliability",
           "'{}' stays set when an error is thrown.", "Clear it in a finally block.",
           file=(has_i(REFRESH_FLAG),), custom=True),
    routed("AU-08", "auth/infinite-refresh", "critical", "reliability",
           "A refused refresh starts the next refresh.", "Limit the attempts.",
           file=(has_i(REFRESH_CALL), has_i(EXPIRED),
                 lacks_i(r"retry\s*(?:count|limit|max)|maxRetries|attempts\s*[<>]|break|return.*null"
                         r"|logout|clearToken|signOut")),
           at=has_i(r"refresh\s*\(|refreshToken")),
    routed("AU-09", "auth/missing-logout", "high", "reliability",
           "A failed refresh does not end the login.", "Log the user out.",
           file=(has_i(REFRESH_CALL), has_i(EXPIRED),
                 lacks_i(r"logout|signOut|clearAuth|clearSession|removeToken"))),
    routed("AU-10", "auth/global-state", "high", "concurrency",
           "Login state is global: {}.", "Keep it in one guarded object.",
           file=(has_i(STATE_NAME),), custom=True),
    routed("AU-11", "auth/thundering-herd", "high", "reliability",
           "All waiting requests start again at once.", "Spread the restarts over time.",
           file=(has_i(QUEUE_FLUSH), has_i(r"pending|queue|waiting|subscribers|callbacks"),
                 lacks_i(r"setTimeout\s*\(\s*\(\s*\)\s*=>[^,]+,\s*i\s*\*|delay|stagger|batch|chunk|throttle"
                         r"|rateLimi|jitter|spread")),
           at=has_i(r"\.forEach\s*\([^)]*(?:resolve|reject|cb|callback|handler|req\s*=>)")),
    routed("AU-12", "auth/retry-storm", "medium", "reliability",
           "Requests are repeated without jitter.", "Add a random pause.",
           file=(has_i(r"retry|requeue|resend|refetch"), has_i(QUEUE_FLUSH),
                 lacks_i(r"backoff|jitter|Math\.random|delay\s*\*|spread"))),
    routed("AU-13", "auth/no-timeout", "high", "reliability",
           "A promise may stay open for ever.", "Race it against a timer.",
           file=(has_i(r"new Promise\s*\(\s*(?:async\s*)?\(?\s*(?:resolve|reject)"),
                 lacks_i(r"timeout|setTimeout.*reject|Promise\.race\s*\(\s*\[|AbortController|timeoutMs")),
           at=has_i(r"new Promise\s*\(")),
    routed("AU-14", "auth/external-resolve", "medium", "reliability",
           "A promise depends on someone else's callback.", "Add a time limit and an error path.",
           file=(has_i(r"return\s+new Promise[^}]*\.push\s*\(\s*(?:resolve|reject|\{[^}]*resolve)"),),
           at=has_i(r"return\s+new Promise")),
]
