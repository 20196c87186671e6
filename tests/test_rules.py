"""Every rule has a snippet that triggers it and one that nearly does."""

import pytest

from codesift.operators import scan as S, score as C
from codesift.rules import BY_KEY, CATALOGUE, Rule, has
from codesift.sources.snippets import ALL


def text(body):
    return body.replace("~", "\n").replace("@", "'")


def found(spark, cases, **kw):
    rows = [(i, name, text(body)) for i, (name, body) in enumerate(cases)]
    files = spark.createDataFrame(rows, "file_id int, file_name string, content string")
    out = {i: [] for i in range(len(cases))}
    for r in S.findings(S.scan(files, **kw)).orderBy("file_id", "position").collect():
        out[r.file_id].append((r.key, r.line, r.detail))
    return out


@pytest.fixture(scope="module")
def snippet_hits(spark):
    return found(spark, [("f" + e, b) for e, b, _ in ALL])


def test_catalogue_is_complete():
    counts = {}
    for r in CATALOGUE:
        counts[r.detector] = counts.get(r.detector, 0) + 1
    assert counts == {"PT": 15, "JV": 13, "PY": 5, "AY": 6, "SM": 21, "AU": 14, "LT": 7}
    assert len({r.name for r in CATALOGUE}) == 81


def test_snippets_trigger_what_they_are_meant_to(snippet_hits):
    for i, (_, body, keys) in enumerate(ALL):
        got = {k for k, _, _ in snippet_hits[i]}
        assert set(keys.split()) <= got, (body, keys, got)


def test_every_rule_is_triggered(snippet_hits):
    got = {k for hits in snippet_hits.values() for k, _, _ in hits}
    assert got == set(BY_KEY)


# rule, file name, body that comes close
NEAR = [
    ("PT-01", "a.js", "exec(@ls@);"), ("PT-02", "a.js", "s += @x@;"), ("PT-02", "a.js", "for (a of b) {~}~s += @x@;"),
    ("PT-03", "a.js", "while (x) {~  if (/^a+b+$/.test(v)) go();~}"), ("PT-04", "a.js", "if (a === b && c == d) {}"),
    ("PT-05", "a.js", "query(@select 1@)"), ("PT-06", "a.js", "el.innerHTML = @x@;"), ("PT-07", "a.js", "password = @short@"),
    ("PT-08", "a.js", "readFile(path)"), ("PT-09", "a.js", "if (a[b] == c) {}"), ("PT-10", "a.js", "const x = Math.random();"),
    ("PT-11", "a.js", "p.catch(() => { log(); })"), ("PT-12", "a.js", "db.find(x)"), ("PT-13", "a.js", "readFile(p)"),
    ("PT-14", "a.js", "out.push(1);"), ("PT-15", "a.js", "~" * 60 + "validate(a);" + "~" * 30 + "x = req.body.a;" + "~" * 0),
    ("JV-01", "A.java", "executeQuery(sql);"), ("JV-02", "A.java", "password = \"abc\";"), ("JV-03", "A.java", "MessageDigest.getInstance(\"SHA-256\")"),
    ("JV-04", "A.java", "Runtime.getRuntime().exec(cmd);"), ("JV-05", "A.java", "readObjects(in)"),
    ("JV-06", "A.java", "Connection c = open();~c.close();"), ("JV-06", "A.java", "Reader r = open();~} finally {"),
    ("JV-07", "A.java", "catch (E e) {~log(e);~}"), ("JV-08", "A.java", "new Thread(job);~for (;;) {}"), ("JV-09", "A.java", "new File(\"x\")"),
    ("JV-10", "A.java", "SAXParserFactory f;~f.setFeature(\"external-general-entities\", false);"),
    ("JV-11", "A.java", "new Random();~~~~~~~token"), ("JV-12", "A.java", "rs.getString(1);~if (v != null) v.x();"),
    ("JV-13", "A.java", "HttpClient c; SSLContext s; // http://a"), ("JV-01", "a.js", "executeQuery(\"a\" + b);"),
    ("PY-01", "a.py", "execute(sql)"), ("PY-02", "a.py", "subprocess.call(c, shell=False)"), ("PY-03", "a.py", "pickle.dump(x)"),
    ("PY-04", "a.py", "password = @abc@"), ("PY-05", "a.py", "medieval(x)"),
    ("AY-01", "a.js", "async () => 1;~x.forEach(y => y)"), ("AY-02", "a.js", "await x;~const t = setInterval(f, 1)"),
    ("AY-03", "a.js", "await x;~fetch(u, { signal: s })"), ("AY-04", "a.js", "useEffect(() => {~  setTimeout(f);~}, [a])"),
    ("AY-05", "a.js", "await x;~while (true) {~  break;~}"), ("AY-06", "a.js", "await x;~p = fetch(u);~await p;~p = fetch(v);"),
    ("AY-03", "a.js", "fetch(u)"),
    ("SM-01", "a.js", "x.on(@a@, (e) => { try { f(); } catch (y) {} })"), ("SM-02", "a.js", "x.on(@a@, f); x.off(@a@)"),
    ("SM-03", "a.js", "let running = true; while (a.length) {}"), ("SM-04", "a.js", "running = true; while (a.length) { await x; if (a.length) {} }"),
    ("SM-05", "a.js", "retries++; sleep(1)"), ("SM-06", "a.js", "retries++; sleep(2 * Math.pow(2, 1))"), ("SM-07", "a.js", "a.push(item)"),
    ("SM-08", "a.js", "queue.push(1); MAX_SIZE"), ("SM-09", "a.js", "setInterval(f); shutdown()"), ("SM-10", "a.js", "catch (e) { log(e.stack) }"),
    ("SM-11", "a.js", "class A { async f() { this.a = mutex } }"), ("SM-12", "a.js", "a => { b => { } c => { } }"),
    ("SM-13", "a.js", "Math.random()"), ("SM-14", "a.js", "limiter; Date.now(); count + 1; sliding"), ("SM-15", "a.js", "limiter; throw new Error(); retryAfter"),
    ("SM-16", "a.js", "limiter; new Map(); redis"), ("SM-17", "a.js", "Date.now() - elapsed; performance.now()"),
    ("SM-18", "a.js", "cache[key] = 1; evict()"), ("SM-19", "a.js", "async f; n++; lock"), ("SM-19", "a.js", "async f; x = x + 1"),
    ("SM-20", "a.js", "function f() {~  const state = {};~  state.x = 1; handler~}"), ("SM-21", "a.js", "queue.push(1); throw x"),
    ("AU-01", "a.js", "token; pending.x; catch (e) { pending.forEach(f); pending = []; }"),
    ("AU-02", "a.js", "token; queue.x; if (ok) { queue.forEach(p => p.resolve()) } else { queue.forEach(p => p.reject()); queue = []; }"),
    ("AU-03", "a.js", "token; queue.x; queue = []; queue.forEach(cb => cb())"), ("AU-04", "a.js", "token; queue.push(resolve); queue.forEach(q => resolve)"),
    ("AU-05", "a.js", "let isRefreshing = false; if (!isRefreshing) { isRefreshing = true; } mutex"),
    ("AU-06", "a.js", "let isRefreshing = false; isRefreshing = true;"), ("AU-07", "a.js", "let isRefreshing = true; try {} finally { isRefreshing = false }"),
    ("AU-08", "a.js", "401; refreshToken(); break"), ("AU-09", "a.js", "401; refreshToken(); signOut()"),
    ("AU-10", "a.js", "function f() {~  let token = 1;~}"), ("AU-11", "a.js", "token; queue.forEach(cb => delay(cb))"),
    ("AU-12", "a.js", "token; retry; queue.forEach(cb => jitter(cb))"), ("AU-13", "a.js", "token; new Promise((resolve) => timeout)"),
    ("AU-14", "a.js", "token; return new Promise((resolve) => {}); list.push(resolve)"),
    ("LT-01", "a.py", "eval(x)"), ("LT-01", "a.js", "medieval(x)"), ("LT-02", "a.js", "setTimeout(f, 1)"), ("LT-03", "a.js", "new Functional()"),
    ("LT-04", "a.js", "await x;"), ("LT-05", "a.js", "myconsole.log(x)"), ("LT-06", "a.js", "// debugger"), ("LT-07", "a.js", "const a = 1; use(a)"),
]


def test_near_misses(spark):
    hits = found(spark, [(n, b) for _, n, b in NEAR])
    wrong = [(k, b) for i, (k, _, b) in enumerate(NEAR) if k in {h[0] for h in hits[i]}]
    assert not wrong
    assert {k for k, _, _ in NEAR} == set(BY_KEY)


def test_guards_do_not_change_results(spark, snippet_hits):
    cases = [("f" + e, b) for e, b, _ in ALL]
    assert found(spark, cases, guards=False) == snippet_hits
    near = [(n, b) for _, n, b in NEAR]
    assert found(spark, near, guards=False) == found(spark, near)


def test_lines_and_details(spark):
    hits = found(spark, [
        ("a.js", "~p = fetch(u);~p = fetch(v);~async function f() {}"),
        ("a.js", "auth; try {} catch (err) {~}~x.on(@data@, (m) => {~});x.on(@end@, (m) => {~});"),
        ("a.js", "const wrap = x => {~  let token = 1;~};~let accessToken = null;~let currentUser = null;"),
        ("A.java", " Connection  c = open();"),
        ("a.js", "retries++;~retries < 3"),
    ])
    assert ("AY-06", 3, "p") in hits[0]
    assert [h for h in hits[1] if h[0] == "SM-01"] == [("SM-01", 3, "data"), ("SM-01", 4, "end")]
    assert ("SM-10", 1, "err") in hits[1]
    assert ("AU-10", 4, "accessToken, currentUser") in hits[2]
    assert ("JV-06", 1, "Connection  c") in hits[3]
    assert ("SM-05", 1, None) in hits[4]


def test_missing_validation_keeps_its_distance(spark):
    lines = ["x = req.body.a;" if i in (0, 4, 9, 10, 15, 20, 21) else "" for i in range(30)]
    hits = found(spark, [("a.txt", "\n".join(lines))])
    assert [line for k, line, _ in hits[0] if k == "PT-15"] == [1, 11, 21]


def test_first_name_wins_for_equal_text_only_in_the_plan(spark):
    """Language rules follow the name, so the same text can give different findings."""
    hits = found(spark, [("a.py", "eval(x)"), ("a.js", "eval(x)")])
    assert [h[0] for h in hits[0]] == ["PY-05"]
    assert [h[0] for h in hits[1]] == ["LT-01"]


def test_large_file_with_many_braces(spark):
    body = "auth(); queue.forEach(p => p.resolve(v)); if (a) {" + "{ }" * 60_000 + "; x = [];"
    loops = "\n".join("for (a of b) {" if i % 3 == 0 else "  s += 'x';" if i % 3 == 1 else "}" for i in range(30_000))
    hits = found(spark, [("a.js", body), ("b.js", loops)], keys=["AU-02", "PT-02"])
    assert hits[0] == [] and len(hits[1]) == 10_000


def test_user_rules(spark):
    rule = Rule("XX-01", "user/marker", "low", "style", None, "m", "a", line=(has(r"TODO"),))
    files = spark.createDataFrame([(1, "a.txt", "x\nTODO y")], "file_id int, file_name string, content string")
    got = C.issues_long(S.findings(S.scan(files, [], extra=[rule])), [rule]).collect()
    assert [(r.line, r.rule, r.penalty) for r in got] == [(2, "user/marker", 0.5)]


def test_score_grade_and_buckets(spark):
    files = spark.createDataFrame([(i, "f" + e, text(b)) for i, (e, b, _) in enumerate(ALL)],
                                  "file_id int, file_name string, content string")
    rows = C.scored(C.with_issues(S.scan(files))).collect()
    for r in rows:
        assert 0 <= r.score <= 100
        assert r.n_security + r.n_performance + r.n_style == r.n_issues == len(r.issues)
        assert r.score == max(0.0, 100 - sum(i.penalty for i in r.issues))
        assert r.grade == next(g for g, least in [("A", 90), ("B", 80), ("C", 70), ("D", 60), ("F", 0)] if r.score >= least)
