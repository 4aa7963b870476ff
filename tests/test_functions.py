from pyspark.sql import functions as F

from corpusloom.functions import commands as C
from corpusloom.functions import imports as I
from corpusloom.functions import names as N
from corpusloom.functions import paths as P
from corpusloom.functions import secrets as S
from corpusloom.functions import text as T
from corpusloom.functions import traces as TR


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def L(value):
    return F.lit(value)


def test_paths(spark):
    got = one(
        spark,
        P.normalize_path(L("./a\\b//c.d.TS")),
        P.normalize_path(L("./")),
        P.extension(L("a/b/c.d.TS")),
        P.extension(L("a.b/c")),
        P.dir_name(L("a/b/c")),
        P.dir_name(L("c")),
        P.ancestor_dirs(L("a/b/c.ts")),
        P.ancestor_dirs(L("c.ts")),
        P.path_suffixes(L("a/b/c")),
    )
    assert got == ["a/b/c.d.TS", ".", ".ts", "", "a/b", ".", [".", "a", "a/b"], ["."], ["c", "b/c", "a/b/c"]]


def test_joins_and_globs(spark):
    got = one(
        spark,
        P.safe_join(L("a/b"), L("../x/./y")),
        P.safe_join(L("."), L("../x")),
        P.safe_join(L("a"), L("..")),
        P.join_clamped(L("."), L("../x")),
        P.glob_root(L("packages/a/*/b")),
        P.glob_root(L("*/b")),
        P.glob_root(L("packages/core")),
    )
    assert got == ["a/x/y", None, ".", "x", "packages/a", ".", "packages"]
    for glob in ["./apps/*/x.?/**/", "packages/*", "a+b/(c)/**", "lib/?.js"]:
        assert one(spark, P.glob_to_regex(L(glob))) == [P.glob_regex(glob)]
    assert P.glob_regex("./apps/*/x.?/") == "^apps/[^/]*/x\\.[^/]$"


def test_config_scope_boundary(spark):
    cases = {
        "webview/src/**/*.ts": "webview",
        "webview/src": "webview",
        "src/main.ts": "src",
        "src": "src",
        "main.ts": ".",
        ".": ".",
        "tests/unit": None,
        "a/Source/b": "a",
        "*/x": ".",
    }
    assert one(spark, *[P.config_scope_boundary(L(path)) for path in cases]) == list(cases.values())


def test_commands(spark):
    line = L("""a && "b && c" d; e || f 'g;h' --k=v -o w""")
    assert one(spark, C.command_fragments(line)) == [["a", '"b && c" d', "e", "f 'g;h' --k=v -o w"]]
    words = C.argv(L("f 'g;h' --k=v -o w"))
    assert one(spark, words, C.option(words, ["-x", "-o"]), C.option(words, ["--k", "-o"])) == [["f", "g;h", "--k=v", "-o", "w"], "w", "v"]
    purposes = {
        "npm run dev": "start", "npm test": "test", "cargo build": "build", "kubectl apply -f x": "deploy", "pip install x": "install",
        "esbuild a.ts": "build", "esbuild --version": "tool", "pytest -q": "test", "ls": "tool",
    }
    assert one(spark, *[C.command_purpose(C.argv(L(text))) for text in purposes]) == list(purposes.values())


def test_module_references(spark):
    source = '''import a from "x"; // import z from "no"
import type {T} from './t'
export * from "./r"; const s = "import q from 'zz'"; foo.require("n"); require('m'); import("d"); import(path);
/* require("c") */ import "side"
export {a} from './b'
export const y = 1
import {
 k,
 l } from "multi"'''
    (found,) = one(spark, I.module_references(L(source)))
    assert [(r["kind"], r["specifier"], r["computed"]) for r in found] == [
        ("import", "x", False), ("import-type", "./t", False), ("re-export", "./r", False), ("require", "m", False),
        ("dynamic-import", "d", False), ("dynamic-import", None, True), ("import", "side", False), ("re-export", "./b", False),
        ("import", "multi", False),
    ]


def test_masking_keeps_length_and_lines(spark):
    source = 'token = "abc\\"d" x\nAPI_KEY: foo bar , y\nhttps://u:p@h/x?token=123&b=1#f\nname = "kept"\npassword="open'
    (masked,) = one(spark, S.mask_source(L(source)))
    assert len(masked) == len(source) and masked.count("\n") == source.count("\n")
    assert masked.split("\n")[0] == "token = " + "•" * 8 + " x"
    assert masked.split("\n")[1] == "API_KEY: " + "•" * 7 + " , y"
    assert masked.split("\n")[2] == "https://•••@h/x?token=" + "•" * 9
    assert masked.split("\n")[3] == 'name = "kept"'
    assert masked.split("\n")[4] == "password=" + "•" * 5
    assert one(spark, S.public_url(L("https://u:p@ss@h/x?api%5Fkey=123&b=1")), S.public_url(L("https://h/x?sig=1&design=2#token=3"))) == ["https://h/x?api%5Fkey=[redacted]&b=1", "https://h/x?sig=[redacted]&design=2#token=3"]
    assert one(spark, S.mask_url_source(L("see https://u:p@ss@h/x?api%5Fkey=12&b=1#f now"))) == ["see https://••••••@h/x?api%5Fkey=••&b=1#f now"]
    assert one(spark, S.public_url(L("https://u:p@h/x?api_key=123&b=1#f")), S.public_url(L("https://h/x?b=1"))) == [
        "https://h/x?api_key=[redacted]&b=1#f", "https://h/x?b=1",
    ]


def test_positions_and_labels(spark):
    text = L("ab\ncde\n\nf")
    assert one(spark, T.line_at(text, L(5)), T.column_at(text, L(5)), T.line_count(text)) == [2, 3, 4]
    got = one(spark, T.evidence_range(text, L(3), L(8)))[0].asDict()
    assert got == {"start_line": 2, "start_col": 1, "end_line": 4, "end_col": 1, "context_start": 1, "context_end": 4}
    ranges = F.array(F.struct(L(3).alias("start_line"), L(5).alias("end_line")))
    flat = F.array(F.struct(L(3).alias("start_line"), L(3).alias("end_line")))
    empty = F.slice(flat, 2, 1)
    assert one(spark, T.evidence_label(L("p"), ranges), T.evidence_label(L("p"), flat), T.evidence_label(L("p"), empty)) == ["p:3–5", "p:3", "p"]


def test_names(spark):
    got = one(
        spark,
        N.normalize_query(L("  A\\b   C ")),
        N.normalize_identifier(L("pypi"), L(" My_Pkg.X ")),
        N.normalize_identifier(L("npm"), L("Ab")),
        N.language_of(L("a/b.TSX")),
        N.language_of(L("a/b")),
        N.npm_root(L("@s/p/x")),
        N.npm_root(L("p/x")),
        N.npm_root(L("./x")),
        N.normalize_route(L("https://h/a/:id/${x}/?q=1")),
        N.file_route(L("app/(g)/u/[id]/route.ts")),
        N.file_route(L("src/pages/x/[...rest].js")),
        N.file_route(L("lib/x.ts")),
        N.inverse_relation(L("binds-to")),
    )
    assert got == ["a/b c", "my-pkg-x", "Ab", "tsx", None, "@s/p", "p", None, "/a/:param/:param", "/u/:id", "/x/*", None, "bound-from"]
    cases = {
        "src/api/x.ts": "API", "tests/a.ts": "Tests", "src/auth/x.ts": "Authentication", "a/models/u.py": "Data models",
        "a/pages/x.vue": "UI", "db/x.sql": "Persistence", "a/services/x.ts": "Domain services", "infra/x.tf": "Infrastructure", "x.ts": "Shared logic",
    }
    assert one(spark, *[N.responsibility(L(path)) for path in cases]) == list(cases.values())
    assert one(spark, N.responsibility(L("x.ts"), L("signInWithPopup()"))) == ["Authentication"]
    assert one(spark, N.is_generated(L("a.ts"), L("// Code generated by x")), N.is_auxiliary(L("a/fixtures/b.ts"))) == [True, True]


def test_clocks(spark):
    d = TR.duration_ms
    assert one(spark, d(L("1700000000000000000"), L("1700000000001250999")), d(L("2"), L("1")), d(L(None).cast("string"), L("1"))) == [1.25, None, None]
    attributes = F.create_map(L("Authorization"), L("x"), L("k"), F.repeat(L("a"), 1200), L(""), L("z"))
    (clean,) = one(spark, TR.clean_attributes(attributes))
    assert clean["Authorization"] == "••••" and len(clean["k"]) == 1200 and "" not in clean
