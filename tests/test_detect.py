import pytest

from plumbline.operators import detect
from plumbline.sources import catalog


def files(spark, *rows):
    return spark.createDataFrame([(lang, "p", path, text) for lang, path, text in rows], "lang string, project string, path string, content string")


@pytest.fixture(scope="module")
def cat(spark):
    return catalog.builtin(spark).cache()


IMPORTS = [
    ("python", "import os.path\nfrom http.client import X\n", {"os.path", "http.client"}),
    ("node", "const a = require('fs');\nimport x, {y} from \"http\";\nimport 'net';\n", {"fs", "http", "net"}),
    ("go", 'import (\n\t"os/exec"\n\tn "net/http"\n)\n', {"os/exec", "net/http"}),
    ("java", "import static java.net.URL;\n", {"java.net.URL"}),
    ("rust", "pub use std::fs::File;\nextern crate libc;\n", {"std::fs::File", "libc"}),
    ("ruby", "require 'net/http'\n", {"net/http"}),
    ("php", "use GuzzleHttp\\Guzzle\\Client;\n", {"GuzzleHttp\\Guzzle\\Client"}),
    ("dart", "import 'package:http/http.dart';\nimport 'dart:io';\n", {"http", "dart:io"}),
    ("elixir", "alias HTTPoison.Base\n", {"HTTPoison.Base"}),
    ("swift", "import struct Network.X\n@testable import Alamofire\n", {"Network", "Alamofire"}),
    ("dotnet", "using System.Net.Http;\nusing (var x = y) {}\n", {"System.Net.Http"}),
    ("kotlin", "import io.ktor.client\n", {"io.ktor.client"}),
    ("scala", "import org.http4s.client._\n", {"org.http4s.client._"}),
    ("cpp", '#include <openssl/ssl.h>\n# include "x.hpp"\n', {"openssl/ssl.h", "x.hpp"}),
    ("haskell", "import qualified Network.HTTP as H\n", {"Network.HTTP"}),
    ("clojure", "(:require [clj-http.client :as c] [clojure.java.io])\n", {"clj-http.client", "clojure.java.io"}),
    ("erlang", '-include_lib("kernel/include/file.hrl").\n-behaviour(gen_server).\n', {"kernel", "gen_server"}),
    ("ocaml", "open Unix\n", {"Unix"}),
    ("julia", "using HTTP\n", {"HTTP"}),
    ("r", "library(httr)\nfs::dir_ls()\n", {"httr", "fs"}),
    ("perl", "use LWP::UserAgent;\nuse strict;\n", {"LWP::UserAgent"}),
    ("lua", 'local s = require("socket.http")\n', {"socket.http"}),
]


def test_imports(spark):
    got: dict = {}
    for r in detect.imports(detect.scan(files(spark, *[(lang, f"{lang}.x", text) for lang, text, _ in IMPORTS]))).collect():
        got.setdefault(r.lang, set()).add(r.module)
    for lang, _, want in IMPORTS:
        assert got.get(lang) == want, lang


def test_match_rules(spark, cat):
    rows = files(spark, ("java", "a.java", "import java.net.http.HttpClient;\n"), ("rust", "a.rs", "use std::fs::read;\n"), ("python", "a.py", "import http.client\n"), ("ruby", "a.rb", "require 'net/http'\n"), ("elixir", "a.ex", "use HTTPoison\n"), ("cpp", "a.cc", "#include <openssl/ssl.h>\n"), ("php", "a.php", "use Symfony\\Process\\Process;\n"))
    got = {(r.lang, r.key, r.capability, r.confidence) for r in detect.match_imports(detect.imports(detect.scan(rows)), cat).collect()}
    assert ("java", "java.net.http", "network", 0.9) in got and ("java", "java.net", "network", 0.9) not in got
    assert ("rust", "std::fs", "fs:read", 0.9) in got
    assert {k for lang, k, *_ in got if lang == "python"} == {"http", "http.client"}
    assert ("ruby", "net/http", "network", 0.9) in got and ("elixir", "httpoison", "network", 0.9) in got
    assert {k for lang, k, *_ in got if lang == "cpp"} == {"openssl/ssl.h"}
    assert ("php", "symfony/process", "exec", 0.9) in got
    many = {(r.lang, r.key) for r in detect.match_imports(detect.imports(detect.scan(rows)), cat, limit=0).collect()}
    assert many == {(a, b) for a, b, *_ in got}


def test_calls(spark, cat):
    rows = files(spark, ("python", "a.py", "x = 1\nsubprocess.run(['ls'])\n"), ("node", "a.js", "let e = process.env.X\n"), ("go", "a.go", 'import (\n\tex "os/exec"\n)\nfunc f() { ex.Command("ls") }\n'))
    lines = detect.scan(rows)
    got = {(r.lang, r.line, r.capability, r.confidence) for r in detect.match_calls(lines, cat).collect()}
    assert ("python", 2, "exec", 0.6) in got and ("node", 1, "env", 0.6) in got
    assert {(r.line, r.key, r.confidence) for r in detect.go_calls(lines, cat).collect()} == {(4, "exec.Command", 0.75)}


def test_bindings(spark, cat):
    text = "const cp = require('child_process');\nconst { exec: run, spawn } = require('child_process');\nimport fs from 'fs';\nimport { readFile as rf } from 'fs';\nimport * as h from 'http';\ncp.exec('x');\nrun('y');\nh.get('z');\nrequire('net').connect(1);\nfoo('a');\n"
    lines = detect.scan(files(spark, ("node", "a.js", text)))
    bound = detect.bindings(lines)
    assert {(r.local, r.module, r.export) for r in bound.collect()} == {("cp", "child_process", "*"), ("run", "child_process", "exec"), ("spawn", "child_process", "spawn"), ("fs", "fs", "default"), ("rf", "fs", "readFile"), ("h", "http", "*")}
    got = {(r.line, r.key, r.capability, r.confidence) for r in detect.bound_calls(lines, bound, cat).collect()}
    assert got == {(6, "cp.exec", "exec", 0.8), (7, "run", "exec", 0.85), (8, "h.get", "network", 0.8), (9, "connect", "network", 0.8)}


SPANS = [
    ("node", "function a() {\n  return '}';\n}\nconst b = () => {\n  // }\n  a();\n};\n", [("a", 1, 3), ("b", 4, 7)]),
    ("python", "def a():\n    x = 1\n\n    return x\ny = 2\ndef b(): pass\n", [("a", 1, 4), ("b", 6, 6)]),
    ("java", "class X {\n  public void go(int a) {\n    if (a) { b(); }\n  }\n}\n", [("go", 2, 4)]),
    ("go", 'func (s *T) Run(x int) {\n\ty := "{"\n}\n', [("Run", 1, 3)]),
    ("rust", "pub fn f<T>(x: T) -> u8 {\n  { 1 }\n}\n", [("f", 1, 3)]),
    ("ruby", "def a\n  if x\n    y\n  end\nend\ndef b\nend\n", [("a", 1, 5), ("b", 6, 7)]),
    ("lua", "function f(a)\n  if a then\n  end\nend\n", [("f", 1, 4)]),
    ("elixir", "def f(x) do\n  x\nend\n", [("f", 1, 3)]),
    ("clojure", "(defn f [x]\n  (g x))\n(defn h [] 1)\n", [("f", 1, 2), ("h", 3, 3)]),
    ("erlang", "f(X) ->\n  g(X).\n", [("f", 1, 2)]),
    ("julia", "function f(x)\n  for i in x\n  end\nend\n", [("f", 1, 4)]),
    ("haskell", "f x = g x\n  where g = id\nh = 1\n", [("f", 1, 2), ("h", 3, 3)]),
    ("ocaml", "let f x =\n  x + 1\nlet g = 2\n", [("f", 1, 2), ("g", 3, 3)]),
    ("perl", "sub f {\n  1;\n}\n", [("f", 1, 3)]),
    ("r", "f <- function(x) {\n  x\n}\n", [("f", 1, 3)]),
    ("cpp", "int f(int a) {\n  /* } */ return a;\n}\n", [("f", 1, 3)]),
    ("kotlin", "fun f(x: Int): Int {\n  return x\n}\n", [("f", 1, 3)]),
    ("scala", "def f(x: Int) = {\n  x\n}\n", [("f", 1, 3)]),
    ("swift", "func f() {\n}\n", [("f", 1, 2)]),
    ("dart", "void f() {\n}\n", [("f", 1, 2)]),
    ("dotnet", "public static int F(int x) {\n  return x;\n}\n", [("F", 1, 3)]),
]


@pytest.mark.parametrize(("lang", "text", "want"), SPANS, ids=[s[0] for s in SPANS])
def test_function_spans(lang, text, want):
    assert detect.function_spans(text, lang) == want
    for cut in range(0, len(text), 3):
        detect.function_spans(text[:cut], lang)


def test_functions_and_ir(spark, cat):
    text = "def a():\n    b()\n\ndef b():\n    subprocess.run('x')\n"
    f = detect.functions(files(spark, ("python", "m/a.py", text), ("python", "m/none.py", None)), cat)
    rows = {r.name: (r.first, r.last, r.caps, r.calls) for r in f.collect()}
    assert rows["a"] == (1, 2, [], ["a", "b"]) and rows["b"][2] == ["exec"]
    clean = {r.name: r.calls for r in detect.functions(files(spark, ("python", "m/a.py", text)), cat, True).collect()}
    assert clean["a"] == ["b"]
    known, calls, direct = detect.ir(detect.functions(files(spark, ("python", "m/a.py", text)), cat, True))
    assert [(r.caller, r.callee) for r in calls.collect()] == [("p/m.a", "p/m.b")]
    assert [(r.fn, r.capability) for r in direct.collect()] == [("p/m.b", "exec")]


def test_reachable(spark):
    found = spark.createDataFrame([("p", "@s/x/deep"), ("p", "y")], "project string, module string")
    pk = spark.createDataFrame([("p", "@s/x", ["z"]), ("p", "z", []), ("p", "y", []), ("p", "w", ["y"]), ("q", "y", [])], "project string, name string, dependencies array<string>")
    got = {(r.project, r.package): r.reachable for r in detect.reachable(found, pk).collect()}
    assert got == {("p", "@s/x"): True, ("p", "z"): True, ("p", "y"): True, ("p", "w"): False, ("q", "y"): False}


def test_scan_ends_at_an_overlong_line(spark):
    rows = detect.scan(files(spark, ("python", "a.py", "a\n" + "x" * 50 + "\nb"), ("python", "b.py", None)), limit=40).collect()
    assert [(r.path, r.line, r.value) for r in rows] == [("a.py", 1, "a"), ("b.py", 1, "")]
