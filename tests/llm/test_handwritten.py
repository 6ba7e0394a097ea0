from quern.llm import handwritten as hw
from quern.llm import languages as L


def reasons(path, text, libraries=None):
    return hw.judge(path, ("." + path.rsplit(".", 1)[1]) if "." in path else "", text, None, libraries, 0.7)[0]


def test_markers_only_in_comments_of_its_own():
    for c in ("Code generated by x. DO NOT EDIT.", "@generated by x from y.idl", "Autogenerated by x 1.2 -- edit y.tmpl instead", "AUTO-GENERATED FILE, changes will be lost (x 1)", "This file was produced automatically from x.schema", "Output of x --emit y; do not modify by hand", "Automatisch erzeugt mit x, nicht von Hand aendern", "Fichier généré automatiquement par x", "Generado automaticamente por x; no editar a mano"):
        assert reasons("a.go", f"package a\n// {c}\nvar x = 1\n") == ["generated"], c
        assert reasons("a.py", f"# {c}\nx = 1\n") == ["generated"]
        assert reasons("a.php", f"<?php\n/* {c} */\n") == ["generated"]
        assert reasons("a.go", f'package a\nconst b = "// {c}"\n') == []
        assert reasons("a.py", f"H = '# {c}'\n") == []
    for c in ("the mirror is generated elsewhere; prune it here by hand", "generate the report", "Emit the sketch of each digest", "do not edit the list while iterating over it"):
        assert reasons("a.js", f"// {c}\nlet x = 1;\n") == [], c


def test_folders():
    for p in ("vendor/a/b.go", "web/bower_components/x/y.js", "src/3rdparty/a.c", "venv/lib/site-packages/x/y.py", "Pods/a/b.java"):
        assert reasons(p, "x\n") == ["vendored"]
    for p in ("src/vendor_portal/a.go", "lib/external_funnel.py", "src/vendor.py", "app/generated_reports/a.js"):
        assert reasons(p, "x\n") == []


def test_squeezed_data_and_a_long_line():
    squeezed = "".join(f"function f{i}(a,b){{return a.x{i}({i})+b[{i}]}}" for i in range(20))
    plain = "\n".join(f"function name{i}(first, second) {{\n  return first.value{i}({i}) + second[{i}];\n}}\n" for i in range(20))
    assert reasons("a.js", squeezed) == ["squeezed"] and reasons("a.js", plain) == []
    assert reasons("a.js", plain + "const banner = '" + "word and word " * 80 + "';\n") == []
    assert reasons("a.py", "x = [\n" + "    (12345, 0.5, 'abc'),\n" * 60 + "]\n") == ["data"]
    assert reasons("a.json", "[" + "12345,\n" * 200 + "1]") == []
    assert reasons("a.css", ".a{margin:1px;color:#fff}" * 30) == ["squeezed"]


def test_small_files():
    """No size below which a file can't be squeezed or data; constants and docstrings are neither."""
    assert reasons("a.js", "a=1;b=f(a);c(b);d()") == ["squeezed"] and reasons("a.js", "run(a);") == [] and reasons("a.js", "const total = 1;\nshow(total);\nend();\n") == []
    assert reasons("a.py", "x = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]\n") == ["data"] and reasons("a.py", "NAME = 'a name that is not short at all'\n") == []
    assert reasons("a.py", '# head\n"""' + "What it is for. " * 40 + '"""\n') == [] and reasons("a.py", 'x = """' + "4711 " * 80 + '"""\n') == ["data"]
    assert reasons("a.css", "") == [] and reasons("a.js", "\n") == []


def test_the_models_decide(spark):
    """Two files of one layout: the one whose names are mangled is squeezed, the other isn't; a corpus of squeezed files is no excuse."""
    plain = "\n".join(f"function load_report_{i}(path_name) {{\n  return open_file(path_name);\n}}" for i in range(30))
    flat = lambda a, b: "".join(f"function {a}{i}({b}) {{return {a}_file({b}) }}" for i in range(30))
    models = hw.Models([])
    for batch in hw._train(iter([__import__("pyarrow").RecordBatch.from_pydict({"suffix": [".js"] * 40, "content": [plain] * 40})])):
        models = hw.Models(list(zip(*(batch.column(c).to_pylist() for c in ("language", "ids", "counts")))))
    judged = {k: hw.judge("a.js", ".js", t, models, None, 0.7) for k, t in {"mangled": flat("zq$", "wx"), "plain": plain}.items()}
    assert "mangled" in judged["mangled"][1] and judged["plain"][:2] == ([], [])
    assert judged["mangled"][2] > judged["plain"][2] + 1
    squeezed = "".join(f"function f{i}(a,b){{return a.x{i}({i})+b[{i}]}}" for i in range(20))
    rows = [("r", f"a{i}.js", squeezed.replace("x", f"v{i}"), "text") for i in range(6)]
    files = spark.createDataFrame(rows, "repo_name string, file_path string, content string, content_type string")
    assert hw.judged(files.limit(1)).first().reasons == ["squeezed"]


def test_libraries(spark):
    text = "\n".join(f"line number {i} of the library" for i in range(40))
    lib = spark.createDataFrame([("l", "1.0", "f.js", text), ("l", "1.1", "f.js", text + "\nmore of it"), (None, None, None, None)], "lib_name string, version string, file_name string, content string")
    changed = text.replace("\n", "\r\n").replace("number 3 ", "number three ")
    rows = [("r", "a.js", changed), ("r", "a.js", changed), ("r", "b.js", "\n".join(text.split("\n")[:20]) + "\n" + "\n".join(f"own {i} line" for i in range(40))), ("r", "c.js", None), ("r", "d.js", ""), (None, None, "x"), ("r", "e", text)]
    files = spark.createDataFrame(rows, "repo_name string, file_path string, content string").selectExpr("*", "'text' as content_type", "1 as reasons", "2 as library")
    for most in (10**6, 1):
        got = {(x.repo_name, x.file_path, tuple(x.reasons)) for x in hw.judged(files, lib, most_library=most).collect()}
        assert got == {("r", "a.js", ("library",)), ("r", "b.js", ()), ("r", "d.js", ()), (None, None, ()), ("r", "e", ("library",))}
        alone = files.selectExpr("nullif(repo_name, 'r') as repo_name", "nullif(file_path, 'e') as file_path", "content", "content_type").where("file_path is null")
        assert sorted(len(x.reasons) for x in hw.judged(alone, lib, most_library=most).collect()) == [0, 1]
    assert hw.judged(files.limit(0), lib).count() == 0 and hw.judged(files, lib.limit(0)).count() == 6


def test_models(spark):
    rows = [("r", f"a{i}.py", f"def load_report_{i}(path_name):\n    return open_file(path_name)\n") for i in range(50)] + [("r", "m.py", "q_x = zk$ if w9 else vj\n"), ("r", "n.py", "report_path = load_name(open_report)\n")]
    files = spark.createDataFrame(rows, "repo_name string, file_path string, content string").selectExpr("*", "'text' as content_type")
    got = {x.file_path: x for x in hw.judged(files).collect()}
    assert got["m.py"].entropy > got["n.py"].entropy + 1 and got["m.py"].foreign > got["n.py"].foreign


def test_comment_lexing():
    assert L.comments("a = '# no' # yes\n\"\"\"# no\"\"\"\n", "python") == ["# yes"]
    assert L.comments("a = '// no'; // yes\n/* and */", "js") == ["// yes", "/* and */"]


def test_a_small_release_among_larger_ones(spark):
    """Four larger releases hold every line of the file, only the smallest is alike; broadcast and join agree."""
    text = [f"line number {i} of the library" for i in range(40)]
    lib = [("l", f"2.{k}", "f.js", "\n".join(text + [f"added {k} {i} later" for i in range(60)])) for k in range(4)] + [("l", v, "f.js", "\n".join(text[:38])) for v in ("1.0", "1.1")]
    libraries = spark.createDataFrame(lib, "lib_name string, version string, file_name string, content string")
    files = spark.createDataFrame([("r", "a.js", "\n".join(text))], "repo_name string, file_path string, content string").selectExpr("*", "'text' as content_type")
    for most in (10**6, 1):
        assert [(x.reasons, x.library) for x in hw.judged(files, libraries, most_library=most).collect()] == [(["library"], "l 1.1 f.js")]
