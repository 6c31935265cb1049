"""Own small sources in every language, with forms that are easily misread."""

import json
import re

import pytest

from graphlens.operators import extract
from graphlens.operators.lexing import apart, block_ends, read_python, use_leaves
from graphlens.session import cut

SOURCES = {
    "yard/crane.py": '''"""import fake_module
def not_here(): pass
"""
import os.path as p; import sys
from . import (
    winch, hook as h,
)
from ..dock import (berth)


@decorated(by=ghost())
class Crane(Base):
    "Lifts."

    async def lift(self, load=default_load()):
        """Up.

        call_in_doc()
        """
        text = f"{weigh(load):>{width(load)}} kg {self.swing(load)!r}"  # commented(out)
        def inner():
            return deep(load)
        return [x for x in sort_of(text)] or \\
            fallback(inner)

    if sys.platform:
        def lower(self): return self.stop(
            1)

def lonely():
    import hidden
    return "not_called()"
''',
    "yard/broken.py": "import half\ndef still_found(x):\n    return used(x)\n\nclass Oops(:\n    pass\n",
    "web/tide.js": '''import { wave } from "./wave"; // import x from "commented"
import sea from 'sea';
/* function ghost() { boo(); } */
export const greet = (name) => {
  const re = /"[{]/g;
  return shout(`${trim(name)} and ${`nested ${deep(name)}`}`);
};
const rise = async function surge(x) { return swell(x); };
const short = n => double(n);
export default class Harbour {
  constructor(size) { this.size = measure(size); }
  static async open({ gate = { wide: 1 } }) {
    if (gate) { lift(gate); }
    return "close(this)";
  }
}
function plain(a, b = makeDefault()) {
  list.map(item => convert(item));
}
''',
    "web/tide.ts": '''import type { Boat } from 'boat';
export const dock = (b: Boat, n: number = 3): string => moor(b);
export function sail(b: Boat): void { leave(b); }
''',
    "src/ship/hull.rs": '''use std::{fmt, io::{self, Read as R, a::{b::{c::{d::{e, f}}}}}};
pub(crate) use crate::keel::Keel;
/* fn ghost() { boo() } */
pub struct Hull<'a> { name: &'a str, c: char }
impl<'a> Hull<'a> {
    pub async fn float(&self) -> bool { let q = '"'; self.check(q) }
}
mod deck { pub fn scrub() { mop("fn fake() { no() }"); println!("x {}", wipe()) } }
''',
    "port/gate.go": '''package port

import (
	"fmt"
	str "strings"
	_ "embed"
)

type Gate struct { name string }

// func ghost() { boo() }
func (g *Gate) Open(by string) (ok bool) {
	raw := `call_in_raw("x") {`
	return fmt.Println(str.ToUpper(raw))
}
''',
    "port/Lock.java": '''package org.port;
import java.util.Map;
import static java.lang.Math.max;
/** class Ghost { void boo() { } } */
public abstract class Lock {
    public static synchronized final strictfp Map<String, java.util.List<int[]>> fill(int level,
            String name) {
        String s = """
            drain(level)
            """;
        return pump(level, max(1, 2));
    }
    Lock() { init(); }
}
''',
    "app/boat.rb": '''require "json"
require_relative "oar"
=begin
def ghost; boo; end
=end
module Sea
  class Boat
    def row(n)
      puts "stroke #{count_of(n)} #{n.succ}"
      push_off n
      self.rest if tired?(n)
      # sink n
    end
    def self.build; new; end
  end
end
''',
    "app/mast.ps1": '''Import-Module Rigging
<# function Ghost { Boo-It } #>
function Set-Sail {
  param($wind)
  $knots = Measure-Wind $wind
  Write-Log "at $(Get-Date)" | Out-File log.txt
  if ($knots) { Raise-Flag($knots) }
}
''',
    "c/pump.c": '''#include <stdio.h>
#include "valve.h"
/* int ghost(void) { return boo(); } */
struct pump { int n; };
static inline unsigned long const volatile int *long_typed(int a,
    int b)
{
    return printf("x { y(%d)", open_valve(a));
}
int declared(int);
''',
    "c/tank.cpp": '''#include <vector>
using std::vector;
namespace tank {
class Tank { public: explicit Tank(int n); int level() const; };
Tank::Tank(int n) : n_(clamp(n)) { fill(n); }
int Tank::level() const { return read_level(); }
}
''',
    "net/Net.cs": '''using System.Text;
namespace Net {
    public class Mesh {
        public async Task<int> Cast(string s) { return Throw($"{Weave(s)} and {{no(s)}}"); }
    }
}
''',
    "k/Buoy.kt": '''package k.buoy
import kotlin.math.abs
class Buoy(val n: Int) {
    suspend fun bob(): String { items.forEach { ring(it) }; return "at ${place(n)}" }
    fun short() = quick(n)
}
''',
    "s/Sail.scala": '''package s
import scala.util.Try
object Sail {
  def hoist(n: Int): String = { xs.foreach { x => tie(x) }; s"up ${knot(n)}" }
}
''',
    "w/Wind.swift": '''import Foundation
struct Wind {
    init(n: Int) { setUp(n) }
    func blow(n: Int) async -> String { return "at \\(speed(n))" }
}
''',
    "p/Pier.php": '''<?php
namespace Pier;
use Other\\Thing;
class Pier {
    # function ghost() { boo(); }
    public function walk($n) { return Thing::step("to {$this->halt($n)}"); }
}
''',
    "l/line.lua": '''local M = require "m"
--[[ function ghost() boo() end ]]
function M.cast(n)
  log "casting"
  reel{ n }
  return M.pull(n)
end
''',
    "j/jib.jl": "using LinearAlgebra\n#= function ghost() boo() end =#\nstruct Jib\n  n\nend\nfunction trim(j)\n  tell(\"at $(angle(j))\")\nend\n",
    "n/nest.nix": "{\n  dep = import ./dep.nix;\n  build = name: wrap name;\n  full = name: pack (name);\n}\n",
    "q/Quay.sol": 'import "./Base.sol";\ncontract Quay {\n    constructor(uint n) { setUp(n); }\n    function tie(uint n) external returns (uint) { return knot(n); }\n}\n',
    "d/drift.dart": "import 'dart:io';\nclass Drift {\n  String go(String n) {\n    return \"to ${find(n)}\";\n  }\n}\n",
    "z/zone.zig": 'const std = @import("std");\nconst Zone = struct {\n    x: i32,\n};\npub fn enter(n: i32) i32 {\n    return pass(n);\n}\n',
    "e/eddy.pl": "package Eddy;\nuse JSON;\n=pod\nsub ghost { boo(); }\n=cut\nsub spin {\n  return turn($_[0]);\n}\n",
    "r/reef.R": "library(dplyr)\ndive <- function(n) {\n  paste(breathe(n))\n}\n",
    "v/Vane.vue": '<template>\n  <b @click="turn"/>\n</template>\n<script lang="ts">\nimport { ref } from \'vue\';\nexport function turn(n: string) { return point(n); }\n</script>\n',
    "v/Veer.svelte": "<script>\n  import { onMount } from 'svelte';\n  const veer = (n) => steer(n);\n</script>\n",
    "b/log.ipynb": json.dumps({
        "metadata": {"kernelspec": {"language": "python"}},
        "cells": [{"cell_type": "markdown", "source": ["# one\n", "two\n"]}, {"cell_type": "code", "source": ["import csv\n", "def note(n):\n", "    return keep(n)\n"]}],
    }),
    "b/other.ipynb": json.dumps({"metadata": {"kernelspec": {"language": "cobol"}}, "cells": [{"cell_type": "code", "source": ["def f(): pass\n"]}]}),
}

EXPECT = {  # functions, classes, (caller, callee), modules: all there are
    "yard/crane.py": (
        {"lift", "lower", "lonely"}, {"Crane"},
        {("lift", c) for c in ("weigh", "width", "swing", "deep", "sort_of", "fallback")} | {("lower", "stop")},
        {"os.path", "sys", "..winch", "..hook", "..dock.berth"},
    ),
    "yard/broken.py": ({"still_found"}, {"Oops"}, {("still_found", "used")}, {"half"}),
    "web/tide.js": (
        {"<anon>", "surge", "constructor", "open", "plain"}, {"Harbour"},
        {("<anon>", c) for c in ("shout", "trim", "deep", "double")}
        | {("surge", "swell"), ("constructor", "measure"), ("open", "lift"), ("plain", "map"), ("plain", "convert")}, {"./wave", "sea"},
    ),
    "web/tide.ts": ({"<anon>", "sail"}, set(), {("<anon>", "moor"), ("sail", "leave")}, {"boat"}),
    "src/ship/hull.rs": (
        {"float", "scrub"}, {"Hull"}, {("float", "check"), ("scrub", "mop"), ("scrub", "println"), ("scrub", "wipe")},
        {"std::fmt", "std::io", "std::io::Read", "std::io::a::b::c::d::e", "std::io::a::b::c::d::f", "crate::keel::Keel"},
    ),
    "port/gate.go": ({"Open"}, {"Gate"}, {("Open", "Println"), ("Open", "ToUpper")}, {"fmt", "strings", "embed"}),
    "port/Lock.java": ({"fill", "Lock"}, {"Lock"}, {("fill", "pump"), ("fill", "max"), ("Lock", "init")}, {"java.util.Map", "java.lang.Math.max"}),
    "app/boat.rb": (
        {"row", "build"}, {"Sea", "Boat"}, {("row", c) for c in ("puts", "count_of", "succ", "push_off", "rest", "tired?")}, {"json", "oar"},
    ),
    "app/mast.ps1": (
        {"Set-Sail"}, set(), {("Set-Sail", c) for c in ("Measure-Wind", "Write-Log", "Get-Date", "Out-File", "Raise-Flag")}, {"Rigging"},
    ),
    "c/pump.c": ({"long_typed"}, {"pump"}, {("long_typed", "printf"), ("long_typed", "open_valve")}, {"stdio.h", "valve.h"}),
    "c/tank.cpp": ({"Tank", "level"}, {"Tank"}, {("Tank", "clamp"), ("Tank", "fill"), ("level", "read_level"), ("Tank", "n_")}, {"vector", "std::vector"}),
    "net/Net.cs": ({"Cast"}, {"Mesh"}, None, {"System.Text"}),
    "k/Buoy.kt": ({"bob", "short"}, {"Buoy"}, {("bob", "forEach"), ("bob", "ring"), ("bob", "place"), ("short", "quick")}, {"kotlin.math.abs"}),
    "s/Sail.scala": ({"hoist"}, {"Sail"}, {("hoist", "foreach"), ("hoist", "tie"), ("hoist", "knot")}, {"scala.util.Try"}),
    "w/Wind.swift": ({"init", "blow"}, {"Wind"}, {("init", "setUp"), ("blow", "speed")}, {"Foundation"}),
    "p/Pier.php": ({"walk"}, {"Pier"}, {("walk", "step"), ("walk", "halt")}, {"Other\\Thing"}),
    "l/line.lua": ({"M.cast"}, set(), {("cast", "log"), ("cast", "reel"), ("cast", "pull")}, {"m"}),
    "j/jib.jl": ({"trim"}, {"Jib"}, {("trim", "tell"), ("trim", "angle")}, {"LinearAlgebra"}),
    "n/nest.nix": ({"build", "full"}, set(), {("build", "wrap"), ("full", "pack")}, {"./dep.nix"}),
    "q/Quay.sol": ({"constructor", "tie"}, {"Quay"}, {("constructor", "setUp"), ("tie", "knot")}, {"./Base.sol"}),
    "d/drift.dart": ({"go"}, {"Drift"}, {("go", "find")}, {"dart:io"}),
    "z/zone.zig": ({"enter"}, {"Zone"}, {("enter", "pass")}, {"std"}),
    "e/eddy.pl": ({"spin"}, set(), {("spin", "turn")}, {"JSON"}),
    "r/reef.R": ({"dive"}, set(), {("dive", "paste"), ("dive", "breathe")}, {"dplyr"}),
    "v/Vane.vue": ({"turn"}, set(), {("turn", "point")}, {"vue"}),
    "v/Veer.svelte": ({"<anon>"}, set(), {("<anon>", "steer")}, {"svelte"}),
    "b/log.ipynb": ({"note"}, set(), {("note", "keep")}, {"csv"}),
    "b/other.ipynb": (set(), set(), set(), set()),
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("r", p, c) for p, c in SOURCES.items()], "repo_id string, path string, content string")
    stored = cut(extract.parsed(files))
    return {
        kind: getattr(extract, f"extract_{kind}")(files, stored).collect() for kind in ("functions", "classes", "call_sites", "imports", "docs")
    }


@pytest.mark.parametrize("path", sorted(EXPECT))
def test_symbols_of_language(found, path):
    names, classes, calls, modules = EXPECT[path]
    of = lambda kind: [r for r in found[kind] if r.file_path == path]
    assert {r.name for r in of("functions")} == names
    assert {r.name for r in of("classes")} == classes
    if calls is not None:
        assert {(re.split(r"::|[.\\]", r.caller_qname)[-1], r.callee_name) for r in of("call_sites")} == calls
    assert {r.module for r in of("imports")} == modules


def test_details(found):
    fn = {(r.file_path, r.name): r for r in found["functions"]}
    lift = fn["yard/crane.py", "lift"]
    assert (lift.qualified_name, lift.class_qname, lift.is_method, lift.is_async, lift.doc) == ("yard.crane.Crane.lift", "yard.crane.Crane", True, True, "Up.\n\n        call_in_doc()")
    assert (lift.start_line, lift.end_line) == (15, 24)
    assert fn["port/gate.go", "Open"].class_qname == "port.gate.Gate" and fn["src/ship/hull.rs", "float"].is_async
    assert fn["c/tank.cpp", "level"].class_qname == "c::tank::Tank" and fn["port/Lock.java", "fill"].qualified_name == "org.port.Lock.fill"
    assert (fn["port/Lock.java", "fill"].start_line, fn["port/Lock.java", "fill"].end_line) == (6, 12)
    assert fn["v/Vane.vue", "turn"].start_line == 6 and fn["b/log.ipynb", "note"].start_line == 5
    assert not fn["web/tide.js", "<anon>"].is_method and fn["web/tide.js", "open"].is_method
    alias = {(r.file_path, r.module): r.alias for r in found["imports"]}
    assert alias["yard/crane.py", "os.path"] == "p" and alias["port/gate.go", "strings"] == "str" and alias["src/ship/hull.rs", "std::io::Read"] == "R"
    relative = {(r.file_path, r.module): r.is_relative for r in found["imports"]}
    assert relative["c/pump.c", "valve.h"] and not relative["c/pump.c", "stdio.h"] and relative["app/boat.rb", "oar"] and relative["yard/crane.py", "..winch"]
    assert {(r.qualified_name, r.doc) for r in found["docs"]} >= {("yard.crane.Crane", "Lifts.")}


def test_texts_keep_their_lines_and_columns():
    for path, code in SOURCES.items():
        for lang in ("javascript", "rust", "ruby", "lua", "python", "c"):
            for made in apart(code, lang):
                assert len(made) == len(code) and [len(x) for x in made.split("\n")] == [len(x) for x in code.split("\n")], path
    assert apart('a("x', "c")[1] == 'a(" ' and apart("", "c") == ("", "")


def test_deep_groups_and_long_declarations(spark):
    tree = "x"
    for k in range(30):
        tree = f"m{k}::{{{tree}, y{k}}}"
    assert len(use_leaves(tree)) == 31 and use_leaves(tree)[0]["module"].count("::") == 30
    words = " ".join(f"word{k}" for k in range(20))
    code = f"public {' '.join(['static', 'final'] * 8)} class Far {{\n    public {words} far_one(int n) {{\n        return near(n);\n    }}\n}}\n"
    rows = extract.extract_functions(spark.createDataFrame([("r", "Far.java", code)], "repo_id string, path string, content string")).collect()
    assert [(r.name, r.end_line) for r in rows] == [("far_one", 4)]


def test_ends_of_blocks():
    text = "f(a = {x}) {\n  if (b) { c }\n}\ng();\nh()\n{\n}\nk(\n"
    assert block_ends(text, [0, 3, 4, 7]) == [2, -1, 6, -1]
    assert read_python("def f(:", "m") is None and read_python("", "m") == {"functions": [], "classes": [], "calls": [], "imports": []}
