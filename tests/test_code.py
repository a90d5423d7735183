import ast
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions import code_text, code_tree, extraction
from faultline.operators import features


def column(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_sync_constructs(spark):
    cases = {
        "lock": 2,
        "with lock:": 3,
        "m.lock();": 4,
        "synchronized (this) {": 1,
        "threading.RLock()": 2,
        "Semaphore s;": 2,
        "": 0,
    }
    assert column(spark, list(cases), code_text.sync_constructs("t")) == list(cases.values())


def test_sync_constructs_match_the_plain_rule(spark):
    rng = random.Random(1)
    words = "lock Lock RLock with .lock() x.unlock() é_lock élock lock-é synchronized ( void std::mutex \n @lock a@lock event CONDITION Barrier ſemaphore multiprocessing.RLock ReadWriteLock".split(" ")
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(200)]
    listed = schema.SYNC_PATTERNS_PYTHON + schema.SYNC_PATTERNS_JAVA + schema.SYNC_PATTERNS_CPP
    plain = [sum(len(re.findall(p, t, re.I)) for p in listed) for t in texts]
    assert column(spark, texts, code_text.sync_constructs("t")) == plain


def test_tokens_and_lines(spark):
    texts = ["naïve_1 x", "a\n\n\t\nb", "", "a\r\nb\rc\x0bd\u2028e\x85\x1cf\n", "٣ x²"]
    assert column(spark, texts, code_text.token_count("t")) == [len(re.findall(r"\w+", t)) for t in texts]
    assert column(spark, texts, code_text.nloc("t")) == [
        len([x for x in t.splitlines() if x.strip()]) for t in texts
    ]


def plain_nesting(code):
    depth = nested = size = 0
    for line in code.split("\n"):
        if any(re.search(p, line, re.I) for p in schema.LOOP_PATTERNS):
            size += 1
            depth, nested = max(depth, size), nested + (size > 1)
        if size:
            size += line.count("{")
        size = max(0, size - line.count("}"))
    return depth, nested


def test_brace_loop_nesting(spark):
    golden = "for (i) {\nfor (j) {\nx;\n}\n}\nwhile (k) {\n}"
    rng = random.Random(2)
    parts = ["for (a) {", "while(b)", "}", "{", "do {", "x;", "FOREACH (c) {", "} }", "fore (", "é for ("]
    texts = [golden] + ["\n".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(150)]
    got = [(r["max_depth"], r["nested"]) for r in column(spark, texts, code_text.brace_loop_nesting("t"))]
    assert got[0] == (3, 2)
    assert got == [plain_nesting(t) for t in texts]
    fixed = column(spark, [golden], code_text.brace_loop_nesting("t", corrected=True))[0]
    assert (fixed["max_depth"], fixed["nested"]) == (2, 1)


def test_languages(spark):
    df = spark.createDataFrame(
        [("a.hpp", ""), ("b.JSX", ""), ("c.go", "def f("), ("d.go", "public int f ("), ("e.go", "?"), ("f.h", "def f(")],
        "n string, t string",
    )
    got = df.select(code_text.language_of("n", "t"), code_text.language_by_name("n")).collect()
    assert [tuple(r) for r in got] == [
        ("cpp", "python"),
        ("javascript", "python"),
        ("python", "python"),
        ("java", "python"),
        ("python", "python"),
        ("c", "python"),
    ]


def test_line_changes():
    cases = {
        ("a\nb\nc", "a\nx\nc"): (1, 1),
        ("", "a\nb"): (2, 0),
        ("-- c\na", "a"): (0, 0),
        ("a", "a\n++i"): (0, 0),
        ("a\nb", "b\na"): (1, 1),
        ("a", "a"): (0, 0),
    }
    assert {pair: code_tree.line_changes(*pair) for pair in cases} == cases


def test_native_shortcuts_agree_with_line_matching(spark):
    texts = ["", "a", "a\n", "a\n\n", "++x\nb\r\nc", "--y\n-z", "\n"]
    pairs = [(b, a) for b in texts for a in texts]
    df = spark.createDataFrame([(i, b, a, "m") for i, (b, a) in enumerate(pairs)], "i int, before string, after string, message string")
    rows = features.file_features(df).orderBy("i").select("added_lines", "deleted_lines").collect()
    assert [(int(r[0]), int(r[1])) for r in rows] == [code_tree.line_changes(b, a) for b, a in pairs]


def test_complexity_and_loops():
    def score(code):
        return code_tree.change_shape("", code)[3]

    assert score("x = 1") == 0.0
    assert score("def f(:") == 0.0
    assert score("def f():\n  pass") == 1
    assert score("def f(a, b):\n  if a and b:\n    pass\n  return [x for x in a if x]") == 5
    assert score("def f():\n  try:\n    pass\n  except A:\n    pass\n  else:\n    pass") == 3
    assert score("class C:\n  x = 1") == 1
    # two methods of 1 and 2: the class scores int((1 + 3) / 2) + 1
    assert score("class C:\n  def a(self): pass\n  def b(self):\n    if self: pass") == (3 + 1 + 2) / 3
    assert code_tree.loop_nesting(ast.parse("def f():\n  while x:\n    for y in z:\n      pass")) == (2, 1)
    assert code_tree.change_shape("", "x = [i for i in y for j in i]")[4:] == (0, 0)


def test_feature_row_falls_back_to_braces(spark):
    java = "for (a) {\n while (b) {\n }\n}"
    rows = [("", "while a:\n  for b in c:\n    pass", "one two"), ("", java, "m"), ("x", None, None)]
    df = spark.createDataFrame(rows, "before string, after string, message string")
    got = features.file_features(df).select(*schema.SAFE_FEATURES).collect()
    assert (got[0]["max_loop_nesting_depth"], got[0]["nested_loops_count"]) == (2, 1)
    assert (got[1]["max_loop_nesting_depth"], got[1]["nested_loops_count"]) == plain_nesting(java)
    assert got[2].asDict() == dict.fromkeys(schema.SAFE_FEATURES, 0.0) | {
        "deleted_lines": 1.0, "total_changes": 1.0, "net_lines": -1.0, "code_churn": 1.0,
    }


def test_python_functions():
    code = "class A:\n  def m(self, x):\n    def inner(): pass\nclass B:\n  def m(self): pass\nasync def g(y): pass"
    got = [(f["name"], f["start_line"], f["end_line"], f["is_method"], f["class_name"]) for f in extraction.from_python(code)]
    assert got == [
        ("g", 6, 6, False, None),
        ("m", 2, 3, True, "B"),
        ("m", 5, 5, True, "B"),
        ("inner", 3, 3, False, None),
    ]


def test_unparsable_python_uses_signatures():
    code = "def a(x):\n  print 1\n\ndef b():\n  pass\n"
    got = [(f["name"], f["start_line"], f["end_line"], f["is_method"]) for f in extraction.functions_of(code, "python")]
    # the pattern may start on the blank line before a definition
    assert got == [("a", 1, 3, False), ("b", 3, 6, False)]


def test_java_functions():
    code = "public class A {\n  public int f(int a, String b) {\n    if (a > 0) { return 1; }\n    return 2;\n  }\n}"
    got = extraction.from_java(code)
    assert (got[0]["name"], got[0]["start_line"], got[0]["end_line"]) == ("f", 1, 5)
    assert (got[0]["class_name"], got[0]["parameters"], got[0]["is_method"]) == ("A", ["a", "b"], True)


def test_function_matching_and_fallback(spark):
    before = "def f():\n  return 1\ndef f():\n  return 3\n"
    after = "def f():\n  return 2\ndef g():\n  return 1\n"
    df = spark.createDataFrame(
        [("a", before, after, "python", "m"), ("b", "x", "y = 1\nz = 2", "python", "m"), ("c", "x", "", "python", "m")],
        "k string, before string, after string, language string, message string",
    )
    got = features.function_features(df).orderBy("k", "function_start_line").collect()
    rows = [(r.k, r.function_name, r.function_end_line, r.added_lines, r.deleted_lines) for r in got]
    assert rows == [
        ("a", "f", 2, 1.0, 1.0),
        ("a", "g", 4, 2.0, 0.0),
        ("b", "<file_level>", 2, 2.0, 1.0),
        ("c", "<file_level>", 1, 0.0, 1.0),
    ]


def test_both_sides(spark):
    df = spark.createDataFrame([(1, "", "def f():\n  pass", "python")], "k int, before string, after string, language string")
    got = extraction.explode_both_sides(df, "before", "after", "language", ["k"]).select("side", "name").collect()
    assert [tuple(r) for r in got] == [("after", "f")]
    assert df.select(F.size(extraction.functions_in(F.col("before"), F.col("language")))).first()[0] == 0


def test_functions_leave_in_batches_and_by_table_function(spark):
    many = "\n".join(f"def f{i}(a, b):\n    return a" for i in range(2_500))
    texts = [(1, many, "python"), (2, "", "python"), (3, None, None), (4, "class A {\n public int g (int a) { }\n}", None), (5, "no", "go")]
    df = spark.createDataFrame(texts, "k int, content string, lang string")
    got = sorted(tuple(r) for r in extraction.explode_functions(df, "content", "lang", ["k"], rows_per_batch=1_000).collect())
    wanted = [
        (k, lang, i, *(f[n] for n in extraction.FUNCTION.names))
        for k, text, lang in texts
        for i, f in enumerate(extraction.functions_of(text, lang))
    ]
    assert got == wanted and len(got) == 2_501
    extraction.register_table_function(spark)
    df.createOrReplaceTempView("files_to_read")
    rows = spark.sql("SELECT k, lang, f.* FROM files_to_read, LATERAL functions_of(content, lang) f").collect()
    assert sorted(tuple(r) for r in rows) == wanted


def test_long_texts_are_read_once():
    for code, language in [
        (" " * 1_000_000 + "; if(a) {", "java"),
        (" " * 1_000_000 + "; if(a) {", "c"),
        ("word " * 200_000 + "(", "cpp"),
        ("word " * 200_000, "java"),
        ("\n" * 1_000_000 + "x", "python"),
        ("def " * 250_000, "python"),
        ("function " * 100_000, "javascript"),
        ("(" * 1_000_000, "c"),
        ("f(x) { " * 100_000, None),
    ]:
        start = time.perf_counter()
        extraction.functions_of(code, language)
        assert time.perf_counter() - start < 3, (code[:20], language)


def test_signatures_equal_their_patterns():
    patterns = {
        "python": r"^\s*def\s+(\w+)\s*\([^)]*\)\s*:",
        "c": r"[\w\s\[\]<>]+\s+(\w+)\s*\([^)]*\)\s*\{",
        "javascript": r"function\s+(\w+)\s*\([^)]*\)\s*\{",
    }
    tokens = "public |static|private\n| |\n|\n\n|int|foo|(|(|)|)|{|{|}|a, int b|class A|;|[]|<T>|def |def f(|:|function |function g(|\t|é"
    rng = random.Random(1)
    for _ in range(4000):
        code = "".join(rng.choice(tokens.split("|")) for _ in range(rng.randrange(2, 26)))
        for language, pattern in patterns.items():
            found = re.compile(pattern, re.MULTILINE)
            wanted = [(m[1], code.count("\n", 0, m.start()) + 1) for m in found.finditer(code)]
            assert [(f["name"], f["start_line"]) for f in extraction.by_signature(code, language)] == wanted


def test_language_is_detected_when_none_is_given():
    assert [f["name"] for f in extraction.functions_of("int f(a) {\n}\nvoid g() {\n}", None)] == ["f", "g"]
    assert [f["name"] for f in extraction.functions_of("def f(a):\n    pass", None)] == ["f"]
    assert [f["is_method"] for f in extraction.functions_of("class A {\n public int f (a) { } }", None)] == [True]
    assert extraction.functions_of("nothing here", None) == []


def test_one_pass_over_the_tree_measures_as_a_walk_does():
    code = (
        "import a\n@d(x if y else z)\ndef f(a=b or c):\n  if a and b:\n    for i in [j for j in k if j]:\n      while i:\n"
        "        def g():\n          for q in q: pass\n  else:\n    class N:\n      def m(self): return 1 if 2 else 3\n"
        "class C(B if D else E):\n  x = 1 if 2 else 3\n  if x:\n    def m(self):\n      try:\n        pass\n      except A: pass\n"
        "      finally: assert a\n  class I:\n    def n(self): pass\nmatch x:\n  case 1 if a: pass\n  case _: pass\n"
    )
    scores, deepest, nested = code_tree.measures(ast.parse(code))
    # f: if, and, for, comprehension with one condition, while; C: base, x, if and its method m with except and assert
    assert (sorted(scores), deepest, nested) == ([3, 7, 7], 3, 2)
    walked = [n for n in ast.walk(ast.parse(code)) if isinstance(n, (ast.stmt, ast.ExceptHandler, ast.match_case, ast.Module))]
    assert [ast.dump(n) for n in code_tree.statements(ast.parse(code))] == [ast.dump(n) for n in walked]


def test_texts_of_other_languages_are_not_parsed(monkeypatch):
    texts = ["// x\nint f() {}", "  x = 1", "\n //", "function f(a) {\n}"]
    for text in texts:
        with pytest.raises(SyntaxError):
            ast.parse(text)
    assert code_tree.parse("function if x else y") and code_tree.parse("  # only\nx = 1")
    monkeypatch.setattr(code_tree.ast, "parse", lambda code: pytest.fail("parsed"))
    assert [code_tree.parse(text) for text in texts] == [None] * 4


def test_changed_lines_are_those_of_the_features(spark):
    texts = ["", "a\nb\nc", "a\n++x\nc\n--y", "--y\n++x", None, "a\r\nb\x0bc\n\n"]
    pairs = [(b, a, "m") for b in texts for a in texts]
    df = spark.createDataFrame(pairs, "before string, after string, message string")
    both = [f(df).select("before", "after", "added_lines", "deleted_lines") for f in (features.changed_lines, features.file_features)]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))
    assert "_shapes" not in both[0]._jdf.queryExecution().toString()


CLASS = "# rev {}\nclass Order{}:\n    def a(self, n):\n        for i in n:\n            x = 1 if i else 2\n\n    def b(cls):\n        pass\n"
JAVA = "// rev {}\nclass Order{} {{\n    int a(int n) {{\n        for (;;) {{ n++; }}\n    }}\n    void b(String s) {{\n    }}\n}}\n"


def test_methods_that_come_again_are_read_once(monkeypatch):
    python, java = ([t.format(i, i) for i in range(50)] for t in (CLASS, JAVA))
    wanted = [extraction.from_python(t) for t in python], [extraction.from_java(t) for t in java]
    parsed, read, parse, braced = [], [], ast.parse, extraction._braced
    monkeypatch.setattr(code_tree.ast, "parse", lambda code, *more: parsed.append(code) or parse(code, *more))
    monkeypatch.setattr(extraction, "_braced", lambda *of: read.append(of) or braced(*of))
    shapes = [code_tree.change_shape("", t) for t in python]
    assert ([extraction.from_python(t) for t in python], [extraction.from_java(t) for t in java]) == wanted
    assert not any("def" in code for code in parsed) and not read
    assert [f["class_name"] for f in wanted[0][7]] == ["Order7", "Order7"] and wanted[1][7] == extraction._whole_java(java[7])
    assert shapes[7] == (8, 0, True, sum(code_tree.measures(parse(python[7]))[0]) / 3, 1, 0)


def test_texts_in_pieces_are_read_like_whole_texts(monkeypatch):
    odd = [
        "    @d", "        '''", "    x = (", "class B:", "    class C:", "        def inner(a):", "    else:", "\\", "    def c(cls): pass",
        "def top():", "  y = 1", "    }", "}", "{", "(", ")", "    int c(int q)", "++x", "    type X = int", "class Z { int f(int q) { } }",
    ]
    draw, texts = random.Random(3), []
    for i in range(400):
        language, lines = draw.choice([("python", CLASS), ("java", JAVA)])
        lines = lines.format(i, i).split("\n")
        for _ in range(draw.randint(0, 3)):
            lines.insert(draw.randrange(len(lines)), draw.choice(odd))
        texts.append((language, "\n".join(lines)))

    def all_of():
        return [(extraction.functions_of(t, g), code_tree.change_shape("a\n++b", t)) for g, t in texts]

    cut = all_of()
    monkeypatch.setattr(code_tree, "in_members", lambda code: None)
    monkeypatch.setattr(extraction, "in_members", lambda code: None)
    monkeypatch.setattr(extraction, "from_java", extraction._whole_java)
    assert all_of() == cut


def test_lines_are_matched_once_for_texts_of_one_pattern():
    before, after = "a\nb\nc{}\nd", "a\nx{}\nd\ni++"
    code_tree._kept.cache_clear()
    assert {code_tree.line_changes(before.format(i), after.format(i)) for i in range(50)} == {(2, 2)}
    assert code_tree._kept.cache_info().misses == 1
