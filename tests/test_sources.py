import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.engine import Engine
from graphloom.functions import languages as L
from graphloom.functions.parsers import braced_facts, parse_braced, parse_clang, parse_python, parse_ruby, parsed, register_parser, registered, with_symbols
from graphloom.operators.heuristic import calls, heuristic_facts, structures, tokens
from graphloom.operators.parse import parse_files, register_udtf
from graphloom.schemas import FILES, UnsupportedLanguage, conform
from graphloom.sources import files as S
from graphloom.sources.cache import FactCache, load_graph
from graphloom.streaming.incremental import keep_facts, source_stream


def short(facts):
    return [(f[1], f[2]) for f in facts]


def test_python():
    assert short(parse_python("def hello():\n    pass\n")) == [("Function", "hello")]
    nested = parse_python("def outer():\n    def inner():\n        pass\n")
    assert short(nested) == [("Function", "outer"), ("Function", "inner")] and nested[1][8] == 0
    assert short(parse_python("foo(bar(1))")) == [("CallSite", "foo")]
    assert short(parse_python("a.b(1)")) == [("CallSite", "a.b")]
    assert short(parse_python("async def bar(): pass\nx = lambda: 0")) == [("Function", "bar"), ("Function", "lambda")]
    assert short(parse_python("x = y")) == [] and ("Variable", "x") in short(parse_python("x = y", detailed=True))
    flat, chained = parse_python("def a(): pass\ndef b(): pass"), parse_python("def a(): pass\ndef b(): pass", sibling_chaining=True)
    assert (flat[1][8], chained[1][8]) == (None, 0)
    facts, error = parsed(parse_python, "def (")
    assert facts == [] and error.startswith("SyntaxError")
    assert parsed(parse_python, None) == ([], None)


def test_braced_languages():
    assert short(parse_braced("func foo() {}\nfunc (s *S) bar() { foo(); fmt.Println(1) }\ntype MyStruct struct { a int }", "go")) == [
        ("Function", "foo"), ("Function", "bar"), ("CallSite", "foo"), ("CallSite", "fmt.Println"), ("Class", "MyStruct"),
    ]
    rust = parse_braced('struct MyStruct { a: i32 }\nimpl MyStruct { fn bar(&self) { foo(); println!("x {}", 1); } }\nfn foo() {}', "rust")
    assert short(rust) == [("Class", "MyStruct"), ("Class", "MyStruct"), ("Function", "bar"), ("CallSite", "foo"), ("CallSite", "println"), ("Function", "foo")]
    assert [f[8] for f in rust] == [None, None, 1, 2, 2, None]
    cpp = parse_braced("#include <x>\nint foo(int a) { return bar(a); } // baz()\nclass MyClass { void m(); };\ntemplate <typename T> class Container { T t; };", "cpp")
    assert short(cpp) == [("Function", "foo"), ("Parameter", "a"), ("CallSite", "bar"), ("Class", "MyClass"), ("Function", "m"), ("Class", "Container")]
    assert short(parse_braced("void foo() {}", "cpp")) == [("Function", "foo")]
    assert [f[3] for f in with_symbols(iter(cpp))][:4] == ["c:@F@foo#", None, None, "c:@S@MyClass"]
    assert parse_braced("", "go") == [] and short(parse_braced("func f() {", "go")) == [("Function", "f")]


def test_ruby():
    assert short(parse_ruby("def foo\nend\n")) == [("Function", "foo")]
    assert short(parse_ruby("class MyClass\n  def add(a)\n    helper(a)\n  end\nend\nputs 1")) == [("Class", "MyClass"), ("Function", "add"), ("CallSite", "helper"), ("CallSite", "puts")]
    assert short(parse_ruby("-> { 1 }"))[0] == ("Function", "lambda")
    assert ("Function", "block") in short(parse_ruby("items.each do |x|\n  use(x)\nend"))


def test_heuristic_scan(spark):
    def scan(text, **options):
        rows = heuristic_facts(spark.createDataFrame([("f", text)], "path string, content string"), **options).orderBy("fact_id").collect()
        return [(r.kind, r.name, r.start_line) for r in rows]

    assert scan("x = (1)") == [("CallSite", "x", 1)]
    assert scan("a.b()") == [("CallSite", "a.b", 1)]
    assert scan("q.\n a . b.c (1)") == [("CallSite", "q.a.b.c", 2)]
    assert scan("<html>f()</html>") == [] and scan("<html>f()</html>", markup_filter=False) == [("CallSite", "f", 1)]
    assert scan("public static class Foo {\n fn <T, U> bar(x) if (y) }") == [("Class", "Foo", 1), ("Function", "bar", 2), ("CallSite", "bar", 2)]
    assert scan("namespace N { }") == [("Class", "N", 1)]
    assert scan("g() g()") == [("CallSite", "g", 1)]
    assert scan("class") == [] and scan("") == []


@pytest.mark.parametrize("text, kinds", [("class A " * 30_000, {("Class", "A")}), ("<" * 40_000 + " fn f " + "> x " * 40_000, {("Function", "f")}), ("a." * 40_000 + "b()", {("CallSite", "." * 40_000)})])
def test_heuristic_scan_takes_time_in_proportion(spark, text, kinds):
    began = time.perf_counter()
    rows = heuristic_facts(spark.createDataFrame([("f", text)], "path string, content string")).collect()
    short_name = lambda r: "." * r.name.count(".") or r.name
    assert {(r.kind, short_name(r)) for r in rows} == kinds and time.perf_counter() - began < 20


def test_files_without_facts_are_not_scanned(spark, monkeypatch):
    from graphloom.operators import heuristic

    texts = {"prose": "Some words, and more. " * 50, "ident": "classes x_class subclass", "digit": "9class A", "word": "a\nfn b", "call": "f\n (", "empty": "", "none": None}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    every = {(r.path, r.kind, r.name) for t in (structures(tokens(files)), calls(tokens(files))) for r in t.collect()}
    seen = []

    def scan(source):
        seen.extend(r.path for r in source.collect())
        return tokens(source)

    monkeypatch.setattr(heuristic, "tokens", scan)
    assert {(r.path, r.kind, r.name) for r in heuristic.heuristic_facts(files).collect()} == every
    assert sorted(seen) == ["call", "digit", "word"] and {path for path, *_ in every} == set(seen)


def test_noise_words_are_calls_if_asked_for(spark):
    scanned = tokens(spark.createDataFrame([("f", "for (x) a.for (y) b\n .c\n (z)")], "path string, content string"))
    assert sorted(r.name for r in calls(scanned, noise=[]).collect()) == ["a.for", "b.c", "for"]
    assert sorted(r.name for r in calls(scanned).collect()) == ["a.for", "b.c"]


def test_next_names_by_depth(spark):
    """Against a scan of all later tokens: the first name at the word's depth of angle brackets or one less."""
    import random

    rng, texts = random.Random(5), []
    for _ in range(60):
        texts.append(" ".join(rng.choice(["<", ">", "class", "fn", "if", "x", "y", "const", ",", "\n"]) for _ in range(rng.randint(1, 40))))
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    found = {(r.path, r.n): r.name for r in structures(tokens(files)).collect()}
    want = {}
    for i, text in enumerate(texts):
        row, depth, deep = text.split(), 0, []
        for t in row:
            depth += (t == "<") - (t == ">")
            deep.append(depth)
        for n, t in enumerate(row):
            if t in ("class", "fn"):
                later = [k for k in range(n + 1, len(row)) if row[k] in ("class", "fn", "x", "y") and deep[k] in (deep[n], deep[n] - 1)]
                if later:
                    want[str(i), n] = row[later[0]]
    assert found == want


def test_languages(spark):
    assert L.parse_language("cpp") == "CppTreeSitter" and L.parse_language("cpp", "cli") == "Cpp"
    with pytest.raises(UnsupportedLanguage):
        L.parse_language("cobol")
    assert L.chosen_languages([]) is None and L.chosen_languages(["go", "auto"]) is None and L.chosen_languages(["go", "x"]) == ["Go"]
    paths = spark.createDataFrame([("a/b.PY",), ("x.hxx",), (".profile",), ("Makefile",), ("a.b/c",)], "path string")
    loose = [r[0] for r in paths.select(L.language_of(F.col("path"))).collect()]
    strict = [r[0] for r in paths.select(L.language_of(F.col("path"), strict=True)).collect()]
    assert loose == ["Python", "Cpp", "Unknown", "Unknown", "Unknown"] and set(strict) == {"Unknown"}


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


MAIN = "from util import helper\n\ndef main():\n    helper()\n\ndef unused():\n    pass\n"
UTIL = "def helper():\n    return 1\n\nclass User:\n    def name(self):\n        return helper()\n"


def test_engine_on_a_tree(spark, tmp_path):
    write(tmp_path, {"src/main.py": MAIN, "src/util.py": UTIL, "src/bad.py": "def (", "src/bytes.py": b"\xff\xfe", "a.go": "func x() { y() }"})
    engine = Engine.from_path(spark, str(tmp_path))
    assert [r.path for r in engine.errors.collect()] == ["src/bad.py"]
    assert sorted(r.caller for r in engine.callers("helper").collect()) == ["main", "name"]
    assert sorted(r.name for r in engine.dead_code().collect()) == ["name", "unused"]
    assert engine.stats().first().node_count == 7
    assert engine.report().first().total_functions == 4
    assert "unused" in engine.html_report() and '"graph"' in engine.html_report()
    assert engine.diff(engine)[1].count() == 0 and engine.html_diff(engine).startswith("<!doctype")
    engine.save(str(tmp_path / "graph"))
    assert Engine.load(spark, str(tmp_path / "graph")).stats().first() == engine.stats().first()
    assert load_graph(spark, str(tmp_path / "graph"))[0].count() == 7
    nodes, edges = engine.graph(focus="main", show_cycles=True, show_dead=True)
    assert {"is_cycle", "is_dead"} <= set(nodes.columns)
    everything = S.read_sources(spark, str(tmp_path), ["python", "go"])
    assert everything.count() == 4


def declared(source):
    facts = parse_braced(source, "cpp")
    return [(f[1][0], f[2], facts[f[8]][2] if f[8] is not None else None) for f in facts if f[1] in ("Variable", "Parameter")]


def test_cpp_declarators():
    assert declared("int x = g(a), *p, **q = &p, arr[3] = {1, 2}, (*fp)(int) = f, (&r)[3] = arr;") == [("V", n, None) for n in ("x", "p", "q", "arr", "fp", "r")]
    assert declared("static const std::map<int, std::vector<T>> m{}; unsigned long long big; struct stat st; enum Color c = RED; A::B<C>::D e;") == [("V", n, None) for n in ("m", "big", "st", "c", "e")]
    assert declared("auto [a, b] = f(); auto &[c] = g();") == [("V", "a", None), ("V", "b", None), ("V", "c", None)]
    # parameters: defaults, function pointers, arrays, packs, unnamed ones, void
    parameters = "int f(int a, const std::map<int, int> &m = {}, void (*cb)(int, char), char *argv[], Args &&...rest, int, unsigned long, ...) {}"
    assert declared(parameters) == [("P", n, "f") for n in ("a", "m", "cb", "argv", "rest", "", "")]
    assert declared("int f(void) {} int g() { T y(5, h(1)); }") == [("V", "y", "g")]
    # members are no variables, parameters of methods are parameters
    assert declared("class A { int m; static int c; void go(int z); }; A a;") == [("P", "z", "go"), ("V", "a", None)]
    loops = "void f() { for (int i = 0, j; i < n; ++i) {} for (auto &e : v) {} if (T *t = get()) {} while (int k = next()) {} if (a * b) {} switch (x) { case 1: int y = 2; default: int z; } }"
    assert declared(loops) == [("V", n, "f") for n in ("i", "j", "e", "t", "k", "y", "z")]
    # statements that declare nothing
    assert declared("void f() { a = b; a < b; foo(bar); x.y(z); std::cout << x; return q; delete p; goto l; l: i++; a->b(c); using T = int; typedef int I; foo(*x); }") == []
    # what is called in an initialiser is called by the function
    facts = parse_braced("void f() { int x = g(h); auto l = [&](int a) { int z = 1; return q(z); }; T y(k(1)); }", "cpp")
    assert [(f[1][0], f[2], f[8]) for f in facts] == [("F", "f", None), ("V", "x", 0), ("C", "g", 0), ("V", "l", 0), ("V", "z", 0), ("C", "q", 0), ("V", "y", 0), ("C", "k", 0)]
    # macros are not read, literals end declarations, raw places
    facts = parse_braced("#define M(x) \\\n  g(x)\nconst char *s = \"a;b\",\n  c = ';';", "cpp")
    assert [(f[2], f[4:8]) for f in facts] == [("s", (3, 0, 3, 21)), ("c", (3, 0, 4, 9))]


def test_cpp_front_end_places():
    facts = parse_clang("int f(int a)\n{\n  return 0;\n}\nint g();\nclass C {};")
    assert [(f[1], f[2], f[3], f[4:8]) for f in facts] == [
        ("Function", "f", "c:@F@f#", (2, 0, 4, 1)), ("Parameter", "a", None, (1, 6, 1, 11)), ("Function", "g", "c:@F@g#", (5, 0, 5, 7)), ("Class", "C", "c:@S@C", (6, 0, 6, 10)),
    ]


@pytest.mark.parametrize("piece", ["(", "a < ", "f(a<", "int x = [&]{", "a<b,", "int a = b<c, ", "int (*", "T<U> "])
def test_cpp_takes_time_in_proportion(piece):
    began = time.perf_counter()
    parse_braced("int y = " + piece * 20_000, "cpp")
    assert time.perf_counter() - began < 10


def test_walk_depth_and_cpp(spark, tmp_path):
    write(tmp_path, {"a.cpp": "int f() { return 0; }", "d/b.H": "int g();", "d/e/c.cc": "", "x.txt": "x"})
    assert sorted(r.path for r in S.read_cpp_directory(spark, str(tmp_path)).collect()) == ["a.cpp", "d/b.H", "d/e/c.cc"]
    assert sorted(r.path for r in S.walk(spark, str(tmp_path), max_depth=1).select("path").collect()) == ["a.cpp", "x.txt"]
    db = [{"file": "a.cpp", "directory": "/elsewhere", "command": "clang++  -c a.cpp"}, {"file": f"{tmp_path}/d/e/c.cc", "arguments": ["cc", "-c"]}]
    write(tmp_path, {"compile_commands.json": json.dumps(db)})
    commands = S.compile_commands(spark, str(tmp_path / "compile_commands.json"), str(tmp_path))
    assert sorted((r.file, r.arguments) for r in commands.collect()) == [(f"{tmp_path}/a.cpp", ["clang++", "-c", "a.cpp"]), (f"{tmp_path}/d/e/c.cc", ["cc", "-c"])]
    assert sorted(r.path for r in S.files_of_commands(S.walk(spark, str(tmp_path)), commands).collect()) == ["a.cpp", "d/e/c.cc"]


def test_zip_refuses_to_leave(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("p/main.py", MAIN)
        z.writestr("../evil.py", "x")
        z.writestr("/abs.py", "x")
    engine = Engine.from_zip(spark, str(tmp_path / "x.zip"))
    assert {r.name for r in engine.nodes.where("kind = 'Function'").collect()} == {"main", "unused"}


def test_cache_parses_only_changes(spark, tmp_path):
    rows = [("a.py", "Python", MAIN), ("b.py", "Python", UTIL), ("c.py", "Python", "")]
    files = conform(spark.createDataFrame(rows, "path string, language string, content string").withColumn("sha256", F.sha2("content", 256)), FILES)
    cache = FactCache(spark, str(tmp_path / "facts"))
    seen = []

    def parse(new):
        seen.append(sorted(r.path for r in new.collect()))
        return parse_files(new)[0]

    first = cache.facts(files, parse).count()
    changed = files.where("path <> 'b.py'").union(conform(spark.createDataFrame([("b.py", "Python", "def z(): pass", "new")], "path string, language string, content string, sha256 string"), FILES))
    assert cache.facts(files, parse).count() == first
    second = cache.facts(changed, parse)
    assert seen == [["a.py", "b.py", "c.py"], [], ["b.py"]] and second.where("path = 'b.py'").count() == 1


def test_stream_keeps_facts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path, {"in/a.py": MAIN})
    for _ in range(2):
        keep_facts(source_stream(spark, str(tmp_path / "in")), str(tmp_path / "facts"), str(tmp_path / "state"), once=True).awaitTermination()
        write(tmp_path, {"in/b.py": UTIL})
    names = {r.name for r in FactCache(spark, str(tmp_path / "facts")).stored().collect()}
    assert {"main", "User"} <= names


def test_table_function_and_own_parser(spark):
    register_udtf(spark)
    rows = spark.sql("SELECT p.name FROM VALUES ('Go', 'func f() { g() }'), ('Lua', 'f()'), ('Python', 'def (') AS t(l, s), LATERAL parse_source(t.l, t.s) AS p").collect()
    assert [r.name for r in rows] == ["f", "g"]
    register_parser("Lua", lambda s: [(0, "Function", s, None, 1, 0, 1, 1, None)])
    try:
        files = spark.createDataFrame([("x.lua", "Lua", "hi"), ("y.tcl", "Tcl", "go()")], "path string, language string, content string")
        assert sorted((r.language, r.name) for r in parse_files(files)[0].collect()) == [("Lua", "hi"), ("Tcl", "go")]
    finally:
        import graphloom.functions.parsers as P

        P._registry.pop("Lua")
    assert "Lua" not in registered()


def test_system_headers(spark):
    facts = spark.createDataFrame([("/usr/include/vector",), ("a.cpp",), (None,)], "source_file string")
    assert S.without_system(facts).count() == 2


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path, {"p/main.py": MAIN, "p/util.py": UTIL})
    assert cli.main(["analyze", str(tmp_path / "p"), "--save", str(tmp_path / "g")], spark) == 0
    assert cli.main(["query", str(tmp_path / "p"), "--functions", "--callers", "helper", "--callees", "main", "--unused", "--dot", "--cycles", "--dead-code", "--complexity", "--cache", str(tmp_path / "c")], spark) == 0
    shown = capsys.readouterr().out
    assert "digraph CallGraph" in shown and "== dead code" in shown and "unused" in shown
    for command in (["report", str(tmp_path / "p")], ["diff", str(tmp_path / "p"), str(tmp_path / "p")]):
        assert cli.main([*command, "--output", str(tmp_path / "o.html")], spark) == 0
        assert (tmp_path / "o.html").read_text().startswith("<!doctype html>")


def test_errors_of_archives_and_of_cached_files(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    engine = Engine.from_zip(spark, str(tmp_path / "bad.zip"))
    assert [r.path.endswith("bad.zip") for r in engine.errors.collect()] == [True] and engine.nodes.count() == 0
    write(tmp_path, {"src/bad.py": "def (", "src/good.py": "def f():\n    pass\n"})
    for _ in range(2):
        cached = Engine.from_path(spark, str(tmp_path / "src"), ["python"], cache=str(tmp_path / "facts"))
        assert [r.path for r in cached.errors.collect()] == ["bad.py"]


def test_compilation_database_chooses_the_files(spark, tmp_path):
    write(tmp_path, {"p/a.cpp": "int f() { return g(); }", "p/b.cpp": "int h() { return 0; }", "c.json": '[{"file": "a.cpp", "command": "cc -c a.cpp"}]'})
    engine = Engine.from_commands(spark, str(tmp_path / "c.json"), str(tmp_path / "p"))
    assert {r.name for r in engine.nodes.where("kind = 'Function'").collect()} >= {"f"} and engine.nodes.where("name = 'h'").count() == 0


def test_python_in_pieces(monkeypatch):
    import graphloom.functions.parsers as P

    methods = "".join(f"    @d(1)\n    def m{k}(self, é='{k}'):\n        '''long'''\n        é.call{k}(x)\n        if x:\n            pass\n    # c\n    else_ = (1,\n    2)\n" for k in range(40))
    tail = "try:\n    a()\nexcept E:\n    b.c\\\n.d()\nelse:\n    pass\n@dec\nclass Z:\n    y = 1\nw = '''\nclass Q:\n    z()\n'''\n"
    inner = "".join("  " + line + "\n" for line in ["class I:", "    v = f()", "    def g(self): return h()  # end"])
    texts = [
        "import x\n\nclass A(B, k=c()):\n\n" + methods + "\n# end\n" + tail, "class O:\n" + inner * 30 + "\nlast()\n", tail * 20, "class A:\n" + methods + "    x = 1  # end\n\n\n",
        "class A:\n    def f(self):\n        pass\n   x = 1\n" * 9, "def f(:\n" * 50, methods, "class A:\r\n    def f(self):\r\n        g(\r\n1)\r\n" * 9, "class A:\n    '''\n    def f(self):\n    '''\n    h()\n" * 9,
    ]
    for text in texts:
        whole = [parsed(lambda s: parse_python(s, d, d), text) for d in (False, True)]
        monkeypatch.setattr(P, "PIECE", 40)
        assert [parsed(lambda s: parse_python(s, d, d), text) for d in (False, True)] == whole
        monkeypatch.undo()


def test_python_takes_time_in_proportion():
    began = time.perf_counter()
    assert len(parse_python("class A:\n" + "".join(f"    def f{k}(self):\n        g{k}.h(1)\n" for k in range(40_000)))) == 80_001
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize("language, unit", [("cpp", "  int f(int a, const std::vector<int> &v = {{}}) {{ int n = 0, *p = &n; g{k}(1); return n; }}\n"), ("go", "func f(a int) int {{\n  g{k}(1)\n}}\n"), ("rust", "fn f(a: i32) -> i32 {{ g{k}(1); 0 }}\n")])
def test_braced_memory_does_not_grow_with_the_source(language, unit):
    import tracemalloc

    def peak(n):
        source = ("class C { public:\n" if language == "cpp" else "") + "".join(unit.format(k=k) for k in range(n))
        tracemalloc.start()
        count = sum(1 for _ in braced_facts(source, language))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return count, top

    (few, low), (many, high) = peak(1000), peak(5000)
    assert many > 4.9 * few and high < 1.5 * low
