"""Our own code snippets: extension, body, rules the body is meant to trigger.

``~`` stands for a line end and ``@`` for a single quote, so that a body can be
written in any SQL dialect.  The first twelve make the ``files`` view; all of
them make ``code_files``, in which every rule has findings and near misses.
"""

BASIC: list[tuple[str, str, str]] = [
    (".js", "function run(n) {~  exec(@ls @ + n);~}", "PT-01 PT-05"),
    (".js", "let s = @@;~for (const r of rows) {~  s += @x@;~}~s += @y@;", "PT-02"),
    (".js", "if (a == b) { go(); }~if (a === b) { go(); }", "PT-04"),
    (".js", "const cfg = { apiKey: @abcd1234efgh@ };~const port = @short@;", "PT-07"),
    (".js", "async function f() {~  items.forEach(async x => g(x));~  while (true) {~    await g(1);~  }~}",
     "AY-01 AY-05 SM-03"),
    (".js", "async function f() {~  p = fetch(u);~  p = fetch(v);~  return await p;~}", "AY-03 AY-06"),
    (".py", "import os~os.system(@ls@)~cur.execute(@select 1 where a = %s@, (v,))~password = @hunter22@",
     "PY-01 PY-02 PY-04 PT-07"),
    (".java", "for (int i = 0; i < 9; i++) {~  new Thread(job).start();~}~catch (E e) {~}", "JV-07 JV-08"),
    (".java", "Connection c = open();~c.run();~MessageDigest.getInstance(\"MD5\");", "JV-03 JV-06"),
    (".ts", "app.on(@data@, (m) => {~  handle(m);~});", "SM-01 SM-02 SM-09"),
    (".go", "let isRefreshing = false;~if (!isRefreshing) { isRefreshing = true; refresh(); }", "AU-05 AU-07 AU-10"),
    (".txt", "plain text without any code", ""),
]

MORE: list[tuple[str, str, str]] = [
    (".js", "while (rows.length) {~  const m = new RegExp(@a@).test(x);~  db.find(x);~  out.push(m);~}~db.find(y);",
     "PT-03 PT-12 PT-14 SM-03"),
    (".js", "el.innerHTML = @<b>@ + name;~fs.readFileSync(p);~readFile(req.query.f, cb);~opts[key] = 1;",
     "PT-05 PT-06 PT-08 PT-09 PT-13"),
    (".js", "const token = Math.random();~p.catch(() => {});~const id = req.body.id;~const b = req.body.b;~~~~~~~~~~q = req.body.q;",
     "PT-10 PT-11 PT-15"),
    (".java", "stmt.executeQuery(\"select \" + id);~String password = \"abcd12\";~Runtime.getRuntime().exec(\"ls \" + dir);"
              "~new ObjectInputStream(in).readObject();~new File(\"/tmp/\" + name);", "JV-01 JV-02 JV-04 JV-05 JV-09"),
    (".java", "DocumentBuilderFactory f = x();~Random r = new Random();~String token = t;~String v = rs.getString(1);"
              "~v.trim();~URL u = new URL(\"http://a\");", "JV-10 JV-11 JV-12 JV-13"),
    (".java", "try (Connection c = open()) {~  c.run();~}~DocumentBuilderFactory f = x();"
              "~f.setFeature(\"disallow-doctype-decl\", true);~if (v != null) { rs.getString(1); }~a.b();", ""),
    (".py", "import pickle~pickle.loads(b)~eval(@1@)~subprocess.call(c, shell=True)", "PY-02 PY-03 PY-05"),
    (".js", "useEffect(() => {~  setInterval(tick, 5);~}, [])", "AY-02 AY-04 SM-09"),
    (".js", "async function g() { const t = setInterval(a, 1); const r = await fetch(u, { signal: s }); for (;;) { break; } }", ""),
    (".js", "target.addEventListener(@x@, h);~app.on(@y@, async (e) => { try { f(e); } catch (err) { log(err.message); } });"
            "~app.off(@y@);", ""),
    (".js", "let running = true;~while (list.length > 0) {~  await step();~  done = 1;~}", "SM-04"),
    (".js", "while (retries < 3) {~  retries++;~  call();~}", "SM-05"),
    (".js", "if (retries < 3) { await sleep(5); retries++; }", "SM-06"),
    (".js", "while (todo.length) {~  todo.push(item);~}", "SM-07 SM-03"),
    (".js", "const queue = [];~function add(x) { queue.push(x); }", "SM-08 SM-21"),
    (".js", "try { a(); } catch (e) { retryLater(); }~try { b(); } catch (err) { log(err.stack); }", "SM-10"),
    (".js", "class Box {~  async save() { this.a = 1; this.b = 2; this.c = 3; this.d = 4; }~}", "SM-11"),
    (".js", "a(() => { b(() => { c(() => { d(); }); }); });", "SM-12"),
    (".js", "function backoff() { return Math.random() * 5; }", "SM-13"),
    (".js", "class Limiter {~  constructor() { this.hits = {}; this.start = Date.now(); }"
            "~  check(limit, count) { if (count > limit) { return false; } }~}", "SM-14 SM-15 SM-16"),
    (".js", "const elapsed = Date.now() - start;~const other = performance.later();", "SM-17"),
    (".js", "const cache = {};~cache[key] = value;", "SM-18 PT-09"),
    (".js", "async function hit() { n++; }", "SM-19"),
    (".js", "const state = {};~app.get(@/@, (req, res) => { state.x = 1; });", "SM-20"),
    (".js", "auth();~pending.push(1);~async function go() { try { await f(); } catch (e) { pending = []; } }", "AU-01 AU-03"),
    (".js", "auth();~if (ok) { queue.forEach(p => p.resolve(v)); queue = []; } else { queue = []; }", "AU-02"),
    (".js", "auth();~if (ok) { if (x) { y(); } queue.forEach(p => p.resolve(v)); } else { queue = []; }", "AU-02"),
    (".js", "auth();~if (ok) { y(); } z(); if (k) { queue.forEach(p => p.resolve(v)); } else { queue.forEach(p => p.reject(e)); queue = []; }", ""),
    (".js", "auth();~callbacks.push({ resolve, reject });", "AU-04"),
    (".js", "let isRefreshing = false;~function r() { if (!isRefreshing) { isRefreshing = true; } try { go(); } finally { isRefreshing = false; } }",
     "AU-05 AU-10"),
    (".js", "var refreshing = true;~refreshing = true;", "AU-06 AU-07"),
    (".js", "if (status === 401) { refreshToken(); }", "AU-08 AU-09"),
    (".js", "if (status === 401) { refreshToken(); logout(); }", ""),
    (".js", "const wrap = x => {~  let token = 1;~};~let accessToken = null;~let currentUser = null;", "AU-10"),
    (".js", "auth(); waiting.forEach(cb => cb());~retry();", "AU-11 AU-12"),
    (".js", "function login() { return new Promise((resolve) => { list.push(resolve); }); }", "AU-13 AU-14"),
    (".ts", "setTimeout(@go()@, 1);~const f = new Function(@a@);~console.log(f);~  debugger;", "LT-02 LT-03 LT-05 LT-06"),
    (".ts", "for (const u of urls) {~  await load(u);~  eval(u);~}~const used = 1;~use(used);~var idle = 2;",
     "LT-01 LT-04 LT-07"),
    (".txt", "public class A { }", ""),
    (".txt", "def f(x):~    pass", ""),
]

ALL = BASIC + MORE
