from pyspark.sql import functions as F

from conftest import values
from corpusloom.operators import calls as CA
from corpusloom.operators import imports as IM
from corpusloom.operators import lookups as L
from corpusloom.operators import tree as R


def files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def imports(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, specifier string")


def test_relative_imports(spark):
    known = files(spark, "src/a.ts", "src/b.tsx", "src/c/index.js", "src/d.ts", "src/d.js", "src/e.mts")
    asked = imports(spark, ("src/a.ts", "./b"), ("src/a.ts", "./c"), ("src/a.ts", "./d"), ("src/a.ts", "./d.js"), ("src/a.ts", "./e.mjs"), ("src/a.ts", "../../x"), ("src/a.ts", "./none"), ("src/a.ts", "/abs"))
    got = {(r["specifier"]): (r["resolved_path"], r["reason"]) for r in IM.resolve_relative(asked, known).collect()}
    # An emitted .js stands for its source first, so only the extensionless form is ambiguous.
    assert got == {
        "./b": ("src/b.tsx", None), "./c": ("src/c/index.js", None), "./d": ("src/d.ts", None), "./d.js": ("src/d.ts", None), "./e.mjs": ("src/e.mts", None),
        "../../x": (None, "unresolved"), "./none": (None, "unresolved"), "/abs": (None, "unresolved"),
    }


def test_ambiguous_between_separate_candidates(spark):
    known = files(spark, "src/a.ts", "src/m.ts", "src/m/index.ts")
    (row,) = IM.resolve_relative(imports(spark, ("src/a.ts", "./m")), known).collect()
    assert (row["resolved_path"], row["reason"]) == (None, "ambiguous")


def test_aliases_longest_pattern_and_nearest_config(spark):
    known = files(spark, "src/x.ts", "lib/x.ts", "app/own/x.ts", "src/deep/x.ts")
    aliases = spark.createDataFrame(
        [(".", ".", "@/*", ["src/*"]), (".", ".", "@/deep/*", ["src/deep/*"]), ("app", "app", "@/*", ["own/*"]), (".", ".", "two", ["src/x", "lib/x"])],
        "config_dir string, base_path string, pattern string, targets array<string>",
    )
    asked = imports(spark, ("src/a.ts", "@/x"), ("src/a.ts", "@/deep/x"), ("app/a.ts", "@/x"), ("src/a.ts", "two"), ("src/a.ts", "react"))
    got = {(r["path"], r["specifier"]): (r["resolved_path"], r["reason"]) for r in IM.resolve_alias(asked, aliases, known).collect()}
    assert got == {
        ("src/a.ts", "@/x"): ("src/x.ts", None), ("src/a.ts", "@/deep/x"): ("src/deep/x.ts", None), ("app/a.ts", "@/x"): ("app/own/x.ts", None), ("src/a.ts", "two"): (None, "ambiguous"),
    }


def test_workspace_packages(spark):
    known = files(spark, "p/ui/src/index.ts", "p/ui/src/button.ts", "p/core/out.js", "p/core/main.ts")
    packages = spark.createDataFrame(
        [("@o/ui", "p/ui", None, None), ("@o/core", "p/core", {"./sub": "./out.js"}, ["main"])], "name string, package_path string, exports map<string,string>, entries array<string>"
    )
    asked = imports(spark, ("x.ts", "@o/ui"), ("x.ts", "@o/ui/button"), ("x.ts", "@o/core/sub"), ("x.ts", "@o/core"), ("x.ts", "@o/uix"))
    got = {r["specifier"]: (r["resolved_path"], r["reason"]) for r in IM.resolve_package_imports(asked, packages, known).collect()}
    assert got == {"@o/ui": ("p/ui/src/index.ts", None), "@o/ui/button": ("p/ui/src/button.ts", None), "@o/core/sub": ("p/core/out.js", None), "@o/core": ("p/core/main.ts", None), "@o/uix": (None, "external")}


def test_language_imports(spark):
    texts = [
        ("j/A.java", "java", "package com.x;\npublic class A {}"), ("k/B.cs", "c_sharp", "namespace N.M { class B {} }"), ("p/C.php", "php", "namespace P\\Q;\nclass C {}"),
        ("py/pkg/__init__.py", "python", ""), ("py/pkg/m.py", "python", ""), ("rs/src/a/mod.rs", "rust", ""), ("rs/src/lib.rs", "rust", ""), ("g/mod/util/u.go", "go", ""), ("d/lib/w.dart", "dart", ""), ("c/inc/h.h", "c", ""), ("rb/lib/z.rb", "ruby", ""),
    ]
    known = spark.createDataFrame(texts, "path string, language string, text string")
    asked = spark.createDataFrame(
        [
            ("j/U.java", "java", "com.x.A", "."), ("k/U.cs", "c_sharp", "N.M", "."), ("p/U.php", "php", "P\\Q\\C", "."), ("py/pkg/n.py", "python", ".m", "py"), ("py/x.py", "python", "pkg", "py"), ("py/x.py", "python", "numpy", "py"),
            ("rs/src/lib.rs", "rust", "mod:a", "rs"), ("rs/src/b.rs", "rust", "crate::a::Thing", "rs"), ("g/main.go", "go", "ex.com/m/util", "g"), ("d/x.dart", "dart", "package:dd/w.dart", "d"), ("c/x.c", "c", "inc/h.h", "c"), ("rb/x.rb", "ruby", "z", "rb"),
            ("rs/src/b.rs", "rust", "self::nope", "rs"),
        ],
        "path string, language string, specifier string, root string",
    )
    modules = spark.createDataFrame([("go", "ex.com/m", "g/mod"), ("dart", "dd", "d")], "language string, module_name string, module_dir string")
    got = {(r["language"], r["specifier"]): (r["resolved_path"], r["reason"]) for r in IM.resolve_language_imports(asked, known, IM.declared_symbols(known), modules).collect()}
    assert got == {
        ("java", "com.x.A"): ("j/A.java", None), ("c_sharp", "N.M"): ("k/B.cs", None), ("php", "P\\Q\\C"): ("p/C.php", None), ("python", ".m"): ("py/pkg/m.py", None), ("python", "pkg"): ("py/pkg/__init__.py", None), ("python", "numpy"): (None, "external"),
        ("rust", "mod:a"): ("rs/src/a/mod.rs", None), ("rust", "crate::a::Thing"): ("rs/src/a/mod.rs", None), ("go", "ex.com/m/util"): ("g/mod/util/u.go", None), ("dart", "package:dd/w.dart"): ("d/lib/w.dart", None), ("c", "inc/h.h"): ("c/inc/h.h", None),
        ("ruby", "z"): ("rb/lib/z.rb", None), ("rust", "self::nope"): (None, "unresolved"),
    }


def test_header_language_needs_one_language_and_one_target(spark):
    known = files(spark, "a.c", "b.cpp", "inc/x.h", "y.h", "inc/y.h", "shared.h", "only.h")
    units = spark.createDataFrame([("a.c", "c", ["inc"]), ("b.cpp", "cpp", ["inc"])], "path string, language string, include_dirs array<string>")
    includes = imports(spark, ("a.c", "x.h"), ("a.c", "y.h"), ("a.c", "shared.h"), ("b.cpp", "shared.h"), ("inc/x.h", "../only.h"))
    assert values(IM.header_languages(units, includes, known), "path", "language") == [("inc/x.h", "c"), ("only.h", "c")]


FN = "fn_id string, path string, name string, class_name string, parent string, default_export boolean, language string"


def test_call_tiers(spark):
    functions = spark.createDataFrame(
        [
            ("init", "a.ts", "init", "", None, False, "typescript"), ("outer", "a.ts", "outer", "", "init", False, "typescript"), ("inner", "a.ts", "helper", "", "outer", False, "typescript"), ("top", "a.ts", "helper", "", "init", False, "typescript"),
            ("m1", "a.ts", "run", "K", "init", False, "typescript"), ("m2", "a.ts", "stop", "K", "init", False, "typescript"), ("lib1", "b.ts", "load", "", None, False, "typescript"), ("lib2", "b.ts", "whatever", "", None, True, "typescript"),
            ("ctor", "b.ts", "constructor", "Box", None, False, "typescript"), ("far", "c.ts", "far", "", None, False, "typescript"), ("d1", "a.ts", "twice", "", "init", False, "typescript"), ("d2", "a.ts", "twice", "", "init", False, "typescript"),
        ],
        FN,
    )
    scopes = R.ancestors(functions.select(F.col("fn_id").alias("id"), F.col("parent").alias("parent_id")))
    rows = [
        ("1", "a.ts", "outer", "helper"), ("2", "a.ts", "m1", "this.stop"), ("3", "a.ts", "outer", "load"), ("4", "a.ts", "outer", "dflt"), ("5", "a.ts", "outer", "ns.far"), ("6", "a.ts", "outer", "Box"), ("7", "a.ts", "outer", "K.run"),
        ("8", "a.ts", "outer", "twice"), ("9", "a.ts", "outer", "unknown.x"), ("10", "a.ts", "outer", "shadow"),
    ]
    calls = spark.createDataFrame(rows, "call_id string, path string, owner string, callee string")
    bindings = spark.createDataFrame(
        [("a.ts", "load", "load", "./b"), ("a.ts", "dflt", "default", "./b"), ("a.ts", "ns", "*", "./b"), ("a.ts", "Box", "Box", "./b"), ("a.ts", "shadow", "load", "./b")], "path string, local string, original string, specifier string"
    )
    reachable = spark.createDataFrame([("a.ts", "./b", "b.ts", True), ("a.ts", "./b", "c.ts", False)], "path string, specifier string, target string, direct boolean")
    classes = spark.createDataFrame([("a.ts", "K")], "path string, name string")
    shadowed = spark.createDataFrame([("10",)], "call_id string")
    got = {r["call_id"]: (r["target"], r["confidence"], r["candidates"]) for r in CA.resolve_calls(calls, functions, scopes, bindings, reachable, shadowed, classes).collect()}
    assert got == {
        "1": ("inner", "source", 1), "2": ("m2", "source", 1), "3": ("lib1", "source", 1), "4": ("lib2", "source", 1), "5": ("far", "inferred", 1), "6": ("ctor", "source", 1), "7": ("m1", "inferred", 1),
        "8": (None, "unresolved", 2), "9": (None, "unresolved", 0), "10": (None, "unresolved", 0),
    }


def test_initializers_are_not_called(spark):
    rows = [
        ("top", "a.ts", "<module>", "", None, False, "typescript", True), ("f", "a.ts", "run", "", "top", False, "typescript", False), ("m", "a.ts", "stop", "K", "top", False, "typescript", False),
        ("other", "a.ts", "stop", "", "top", False, "typescript", False), ("only", "a.ts", "go", "K", "top", False, "typescript", None),
    ]
    functions = spark.createDataFrame(rows, FN + ", initializer boolean")
    scopes = R.ancestors(functions.select(F.col("fn_id").alias("id"), F.col("parent").alias("parent_id")))
    calls = spark.createDataFrame([("1", "a.ts", "f", "stop"), ("2", "a.ts", "f", "go"), ("3", "a.ts", "top", "run"), ("4", "a.ts", "f", "<module>")], "call_id string, path string, owner string, callee string")
    empty = lambda schema: spark.createDataFrame([], schema)
    none = (empty("path string, local string, original string, specifier string"), empty("path string, specifier string, target string, direct boolean"), empty("call_id string"))
    # A method is no declaration of the file's top level, and the top level itself is nobody's target.
    got = CA.resolve_calls(calls, functions, scopes, *none)
    assert values(got, "call_id", "target") == [("1", "other"), ("2", None), ("3", "f"), ("4", None)]
    from corpusloom.operators import spans as S

    spans = spark.createDataFrame([("s1", "a.ts", None, 5), ("s2", None, "<module>", None)], "span_id string, path string, function_name string, line int")
    placed = spark.createDataFrame([("top", "a.ts", "<module>", "<module>", 1, 99, True), ("f", "a.ts", "run", "run", 4, 6, False)], "fn_id string, path string, label string, name string, line int, end_line int, initializer boolean")
    assert values(S.bind_spans(spans, placed), "span_id", "fn_id") == [("s1", "f"), ("s2", None)]


def test_external_targets_of_one_source_are_flat(spark):
    from corpusloom.operators import bundles as B

    one = spark.createDataFrame([("a", "x"), ("a", "y")], "src string, dst string")
    two = one.unionByName(spark.createDataFrame([("b", "y")], "src string, dst string"))
    assert values(B.external_layout(one, B.external_groups(one)), "dst", "parent", "layout") == [("x", "external", "flat"), ("y", "external", "flat")]
    assert values(B.external_layout(two, B.external_groups(two)), "dst", "parent", "layout") == [("x", "external:source:a", "grouped"), ("y", "external:source:shared", "grouped")]
    assert B.external_layout(one.limit(0), B.external_groups(one.limit(0))).isEmpty()


def test_places_of_a_word(spark):
    from corpusloom.functions import text as XF

    texts = ["a.b a.b\n\na.b", "", None, "a.ba.b", "axb", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", XF.places("t", "a.b").alias("p")).collect()
    assert {r.i: None if r.p is None else [tuple(x) for x in r.p] for r in rows} == {0: [(1, 1), (1, 5), (3, 1)], 1: [], 2: None, 3: [(1, 1), (1, 4)], 4: [], 5: []}


def test_reaching_definitions(spark):
    scopes = R.ancestors(spark.createDataFrame([("f", "g"), ("g", None)], "id string, parent_id string"))
    definitions = spark.createDataFrame(
        [("d1", "f", "x", 10, 0, 100, False), ("d2", "f", "x", 20, 0, 100, True), ("d3", "f", "x", 30, 25, 35, False), ("o", "g", "y", 5, 0, 100, False), ("c", "f", "y", 8, 0, 100, True)],
        "def_id string, owner string, name string, start int, scope_start int, scope_end int, conditional boolean",
    )
    uses = spark.createDataFrame([("u1", "f", "x", 24), ("u2", "f", "x", 32), ("u3", "f", "y", 50), ("u4", "f", "p", 50), ("u5", "f", "x", 5)], "use_id string, owner string, name string, position int")
    parameters = spark.createDataFrame([("par", "g", "p")], "def_id string, owner string, name string")
    assert values(CA.reaching_definitions(uses, definitions, scopes, parameters), "use_id", "def_id") == [("u1", "d1"), ("u1", "d2"), ("u2", "d3"), ("u3", "c"), ("u3", "o"), ("u4", "par")]


def test_instances_copy_any_size_and_summarise_nested(spark):
    chain = [("big", f"b{i}", f"b{i + 1}") for i in range(14)]
    template = spark.createDataFrame([("small", "sp", "sr"), ("small", "sop", "sres"), ("small", "sres", "sr"), *chain], "fn_id string, src string, dst string")
    returns = spark.createDataFrame([("small", "sr"), ("big", "b14")], "fn_id string, id string")
    parameters = spark.createDataFrame([("small", "sp", 0), ("big", "b0", 0)], "fn_id string, id string, position int")
    invocations = spark.createDataFrame([("c1", "small", None, "r1"), ("c2", "big", None, "r2"), ("sop", "big", "small", "sres")], "call_id string, fn_id string, caller string, result_id string")
    arguments = spark.createDataFrame([("c1", 0, "v1"), ("c2", 0, "v2")], "call_id string, position int, value_id string")
    # The nested operation takes part in the slice because its result is returned.
    nodes, edges = CA.instantiate_calls(template, returns, parameters, invocations, arguments)
    shapes = values(nodes.groupBy("call_id", "shape").count(), "call_id", "shape", "count")
    assert ("c1", "copy", 4) in shapes and ("c2", "copy", 15) in shapes
    assert ("sop:context:c1", "summary", 1) in shapes
    found = values(edges, "src", "dst", "kind")
    assert ("v1", "sp:context:c1", "passes-to") in found and ("sr:context:c1", "r1", "returns") in found
    assert ("b14:context:c2", "r2", "returns") in found and ("b0:context:c2", "b1:context:c2", "flow") in found
    assert ("context-return:sop:context:c1", "sres:context:c1", "returns") in found


def test_instances_keep_outer_values_rest_and_unset_defaults(spark):
    template = spark.createDataFrame(
        [("f", "p", "r", "flow"), ("f", "captured", "r", "flow"), ("f", "more", "r", "flow"), ("f", "d", "p", "parameter-default"), ("f", "unused", "aside", "flow")],
        "fn_id string, src string, dst string, kind string",
    )
    local = spark.createDataFrame([("f", i) for i in ("p", "r", "more", "d", "unused", "aside")], "fn_id string, id string")
    returns = spark.createDataFrame([("f", "r")], "fn_id string, id string")
    parameters = spark.createDataFrame([("f", "p", 0, False), ("f", "more", 1, True)], "fn_id string, id string, position int, rest boolean")
    invocations = spark.createDataFrame([("c1", "f", None, "r1"), ("c2", "f", None, "r2")], "call_id string, fn_id string, caller string, result_id string")
    arguments = spark.createDataFrame([("c1", 0, "a"), ("c1", 1, "b"), ("c1", 2, "e")], "call_id string, position int, value_id string")
    nodes, edges = CA.instantiate_calls(template, returns, parameters, invocations, arguments, local)
    assert values(nodes.filter("call_id = 'c1'"), "original") == [("d",), ("more",), ("p",), ("r",)]
    found = values(edges, "src", "dst", "kind")
    assert ("captured", "r:context:c1", "flow") in found and ("captured", "r:context:c2", "flow") in found
    assert [v for v in found if v[2] == "passes-to"] == [("a", "p:context:c1", "passes-to"), ("b", "more:context:c1", "passes-to"), ("e", "more:context:c1", "passes-to")]
    assert [v for v in found if v[2] == "parameter-default"] == [("d:context:c2", "p:context:c2", "parameter-default")]


def test_deep_inheritance_is_expanded(spark):
    models = spark.range(40).select(F.col("id").cast("string").alias("model_id"))
    fields = spark.createDataFrame([("0", "root", "int", 0)], "model_id string, name string, type string, pos int")
    extends = spark.range(1, 40).select(F.col("id").cast("string").alias("model_id"), (F.col("id") - 1).cast("string").alias("base_id"))
    nearest, state = CA.expand_fields(models, fields, extends)
    assert nearest.filter("name = 'root' AND origin = '0'").agg(F.count(F.lit(1)), F.max("distance")).first() == (40, 39)
    assert state.filter("expansion <> 'expanded'").count() == 0
    looped = extends.union(spark.createDataFrame([("0", "20")], "model_id string, base_id string"))
    assert CA.expand_fields(models, fields, looped)[1].filter("expansion = 'partial'").count() == 40


def test_field_expansion_and_cycles(spark):
    models = spark.createDataFrame([("A",), ("B",), ("C",), ("X",), ("Y",), ("U",)], "model_id string")
    fields = spark.createDataFrame([("A", "id", "int", 0), ("A", "name", "text", 1), ("B", "name", "str", 0), ("C", "z", "int", 0), ("X", "x", "int", 0), ("U", "u", "int", 0)], "model_id string, name string, type string, pos int")
    extends = spark.createDataFrame([("B", "A"), ("C", "B"), ("X", "Y"), ("Y", "X"), ("U", "Gone")], "model_id string, base_id string")
    nearest, state = CA.expand_fields(models, fields, extends)
    assert [v for v in values(nearest, "model_id", "name", "type") if v[0] == "C"] == [("C", "id", "int"), ("C", "name", "str"), ("C", "z", "int")]
    assert dict(values(state, "model_id", "expansion")) == {"A": "expanded", "B": "expanded", "C": "expanded", "X": "partial", "Y": "partial", "U": "partial"}


def test_locked_versions(spark):
    dependencies = spark.createDataFrame(
        [("1", "apps/a", "npm", "x", "^1"), ("2", "apps/a", "npm", "y", "^1"), ("3", "apps/a", "npm", "z", "^1"), ("4", "apps/a", "nuget", "N", "*"), ("5", "apps/a", "npm", "q", "^1"), ("6", "apps/a", "npm", "d", "^2")],
        "dependency_id string, project_dir string, ecosystem string, name string, version_range string",
    )
    locks = spark.createDataFrame(
        [
            (".", "npm", "x", "1.0.0", None, None, None), ("apps/a", "npm", "x", "1.2.0", None, None, None), (".", "npm", "y", "1.0.0", None, None, None), (".", "npm", "y", "1.1.0", None, None, None), (".", "npm", "z", "latest", None, None, None),
            (".", "nuget", "n", "8.0.0", None, None, "net8"), (".", "nuget", "n", "9.0.0", None, None, "net9"), (".", "npm", "d", "1.0.0", "^1", None, None), (".", "npm", "d", "2.0.0", "^2", None, None),
        ],
        "lock_dir string, ecosystem string, name string, version string, descriptor string, source_identity string, framework string",
    )
    listed = spark.createDataFrame([(".", e, "apps/a") for e in ("npm", "nuget")], "lock_dir string, ecosystem string, project_dir string")
    got = {r["dependency_id"]: (r["status"], r["resolved_version"]) for r in L.resolve_versions(dependencies, locks, listed).collect()}
    assert got == {"1": ("resolved", "1.2.0"), "2": ("ambiguous", None), "3": ("unsupported", None), "4": ("per-framework", None), "5": ("unlocked", None), "6": ("resolved", "2.0.0")}
    # A root that does not list the project has no say, a configured lock is the only one, and locks can be off.
    got = {r["dependency_id"]: r["status"] for r in L.resolve_versions(dependencies, locks).collect()}
    assert got == {"1": "resolved", "2": "unlocked", "3": "unlocked", "4": "unlocked", "5": "unlocked", "6": "unlocked"}
    chosen = dependencies.withColumn("lock_path", F.lit(".")).withColumn("lock_disabled", F.col("dependency_id") == "6")
    got = {r["dependency_id"]: (r["status"], r["resolved_version"]) for r in L.resolve_versions(chosen, locks, listed).collect()}
    assert got["1"] == ("resolved", "1.0.0") and got["6"] == ("unlocked", None)
