"""Small changes and sources with known results, for queries whose outcome is stated by hand.

Each change is a set of new files. The expected rows stand beside them as SQL
values, so that the check compares what the parser and the engine find with
what a reader of these files finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: change -> path -> (text, additions, deletions)
CHANGES: dict[str, dict[str, tuple[str, int, int]]] = {
    # a route that calls a service that calls a store, and a route of its own
    "shop": {
        "src/routes/health.ts": ("""import express from 'express';
const router = express.Router();

export function ping(req: any, res: any) {
    res.json({ up: true });
}

router.get('/ping', ping);
export default router;
""", 1, 1),
        "src/routes/orders.ts": ("""import express from 'express';
import { placeOrder } from '../services/orderService';

const router = express.Router();

export function postOrder(req: any, res: any) {
    const order = placeOrder(req.body);
    res.status(201).json(order);
}

router.post('/orders', postOrder);
export default router;
""", 6, 3),
        "src/services/orderService.ts": ("""import { addOrder } from '../repositories/orderRepo';

export function placeOrder(data: any) {
    const order = { id: Date.now(), ...data };
    return addOrder(order);
}
""", 7, 0),
        "src/repositories/orderRepo.ts": ("""const orders: any[] = [];

export function addOrder(order: any) {
    orders.push(order);
    return order;
}

export function orderById(id: number) {
    return orders.find(o => o.id === id);
}
""", 11, 0),
    },
    # a decorated route whose absolute imports lead nowhere: the others are rescued by directory
    "api": {
        "app/routes/parts.py": ("""from fastapi import APIRouter
from app.services.part_service import make_part

router = APIRouter()

@router.post("/parts")
async def post_part(part):
    return make_part(part)
""", 8, 0),
        "app/services/part_service.py": ("""from app.repositories.part_repo import save_part

def make_part(data):
    part = {"id": 1, "name": data.name}
    save_part(part)
    return part
""", 6, 0),
        "app/repositories/part_repo.py": ("""rows = []

def save_part(part):
    rows.append(part)
    return part
""", 5, 0),
    },
    # no entry point: a shared helper and what imports it, a lone file, and a manifest
    "lib": {
        "lib/text/pad.ts": ("export function pad(s: string) { return s; }\n", 1, 0),
        "lib/jobs/one.ts": ("import { pad } from '../text/pad';\nexport function one() { return pad('1'); }\n", 2, 0),
        "lib/jobs/two.ts": ("import { pad as p } from '../text/pad';\nexport function two() { return p('2'); }\n", 2, 0),
        "other/alone.ts": ("export const alone = 1;\n", 1, 0),
        "package.json": ("{}\n", 1, 0),
    },
    # re-exports, a default import, a namespace import and an import for its effect
    "links": {
        "src/index.ts": ("""import start, { stop } from './barrel';
import * as tools from './tools';
import './setup';

export function run() {
    stop();
    tools.clean();
    start();
}
""", 9, 0),
        "src/barrel.ts": ("export { stop } from './control';\nexport default function start() {}\n", 2, 0),
        "src/control.ts": ("export function stop() { helper(); }\nfunction helper() { db.users.insert({}); }\n", 2, 0),
        "src/tools.ts": ("export function clean() {}\nexport class Tool extends Base {}\nclass Base {}\n", 3, 0),
        "src/setup.ts": ("console.log('ready');\n", 1, 0),
    },
}

#: path -> text; one file for each language
SOURCES: dict[str, str] = {
    "a/view.tsx": """import React, { useState as state, type Kind } from "react";
import * as path from 'path';
import "./polyfill";
export { a as b, default } from "./other";
export * from './all';
export default function View(x: number) { return helper(x, `t${x}`); }
export const load = async (q: string): Promise<void> => { const r = await db.query(q, { a: 1 }); log(r) };
const LIMIT = 5;
export abstract class Service extends Core {
  constructor(private db: Db) { super(); }
  async find<T>(id: string): Promise<T> {
    return this.db.find(id)
  }
}
export interface Shape { area(): number }
type Pair<T> = { a: T };
""",
    "a/main.go": """package main
import (
  "fmt"
  h "net/http"
  . "strings"
  _ "embed"
)
type Server struct { port int }
type Runner interface { Run() }
type Name = string
const (
  A = 1
  B = 2
)
func (s *Server) Run(ctx Context) (int, error) {
  rows, err := s.db.Query(ctx, "x")
  return 0, fmt.Errorf("bad %v", err)
}
func main() { h.HandleFunc("/a", handle) }
""",
    "a/lib.rs": """use std::io;
use std::collections::{HashMap, HashSet as Set};
use crate::store::*;
pub struct Point<'a> { name: &'a str }
pub trait Draw { fn draw(&self); }
impl<'a> Draw for Point<'a> {
    fn draw(&self) { let q = helper(self.name); q.run(1); }
}
pub const MAX: usize = 3;
type Res = Result<(), Error>;
macro_rules! twice { () => {} }
""",
    "a/Shop.java": """package a;
import java.util.List;
import java.util.*;
import static org.junit.Assert.assertEquals;
@RestController
public class Shop extends Base implements Store {
  private final Repo repo = new Repo();
  public Shop(Repo r) { this.repo = r; }
  @GetMapping("/all")
  public List<String> all(int n) throws Bad { var x = repo.findAll(n); return x; }
  enum Color { RED }
}
""",
    "a/Shop.cs": """using System;
using System.Collections.Generic;
namespace N {
public class Shop : ControllerBase {
  public string Name { get; set; }
  private readonly int _x = 1;
  public Shop(int x) : base(x) { }
  public IActionResult Get(int id) { var r = _svc.Load(id); return Ok(r); }
}
public record Point(int X, int Y);
}
""",
    "a/shop.php": """<?php
namespace App;
use App\\Models\\User;
use App\\Services\\UserService as Svc;
require_once 'boot.php';
const LIMIT = 1;
class Shop extends Base { public function index(Request $r) { $u = User::find(1); return view('x', $u); } }
interface Store {}
function helper($x) { return new Cart($x); }
""",
    "a/shop.rb": """require 'sinatra'
require_relative "lib/cart"
module Shop
  LIMIT = 5
  class Cart < Base
    include Comparable
    def total(x)
      if x then add(x) end
      items.each do |i|
        r = price(i)
      end
    end
    def self.make
      new(1)
    end
  end
end
""",
    "a/shop.kt": """package a
import a.b.Cart
import a.b.Item as Thing
import io.ktor.*
const val LIMIT = 3
data class Point(val a: Int) : Base()
object Single { val q = 1 }
typealias Names = List<String>
fun String.twice(n: Int): Int = n + 1
suspend fun main() { val r = repo.find(1) }
""",
    "a/shop.swift": """import Foundation
import Vapor
protocol Store { func all() -> Int }
class Shop: Base, Store {
  let size = 1
  func run(_ a: Int) throws -> String { let r = load(a); return go(r) }
}
typealias Name = String
""",
    "a/shop.c": """#include <stdio.h>
#include "my/list.h"
typedef struct node { int a; } node_t;
enum color { RED };
int count = 3;
static int *add(int a, char c) { int r = mul(a, 'c'); p->visit(r); return 0; }
""",
    "a/shop.cpp": """#include <vector>
namespace shop {
class Cart : public Base { public: void in() { x(); } };
void Cart::run(int a) const { auto r = std::move(a); }
using Names = std::vector<int>;
}
""",
    "a/Shop.scala": """package a
import a.b.Cart
import a.b.{Item, Price => Cost}
import x.y._
trait Store { def all(x: Int): Int }
case class Point(a: Int) extends Store
object Main { val q = load(1); def f(a: Int) = { g(a) }; type Name = String }
""",
    "a/shop.py": """import os
import numpy as np
from .models import User as U, Cart
from lib import *

class Shop(Base):
    @cached
    def total(self, x, *, deep=True):
        r = self.store.sum(x, deep=deep)
        return r

async def main():
    rows = await load(1)
""",
}


# what a reader of SOURCES finds, by file
#: name, kind, first and last line
DEFINITIONS = {
    "view.tsx": [("View", "Function", 6, 6), ("load", "Function", 7, 7), ("r", "Constant", 7, 7), ("LIMIT", "Constant", 8, 8),
        ("Service", "Class", 9, 14), ("constructor", "Function", 10, 10), ("find", "Function", 11, 13), ("Shape", "Interface", 15, 15), ("Pair", "TypeAlias", 16, 16)],
    "main.go": [("Server", "Class", 8, 8), ("Runner", "Interface", 9, 9), ("Name", "TypeAlias", 10, 10), ("A", "Constant", 12, 12),
        ("B", "Constant", 13, 13), ("Run", "Function", 15, 18), ("main", "Function", 19, 19)],
    "lib.rs": [("Point", "Class", 4, 4), ("Draw", "Interface", 5, 5), ("draw", "Function", 5, 5), ("draw", "Function", 7, 7),
        ("MAX", "Constant", 9, 9), ("Res", "TypeAlias", 10, 10), ("twice", "Function", 11, 11)],
    "Shop.java": [("Shop", "Class", 5, 12), ("repo", "Constant", 7, 7), ("Shop", "Function", 8, 8), ("all", "Function", 9, 10), ("Color", "Class", 11, 11)],
    "Shop.cs": [("Shop", "Class", 4, 9), ("Name", "Constant", 5, 5), ("_x", "Constant", 6, 6), ("Shop", "Function", 7, 7), ("Get", "Function", 8, 8),
        ("Point", "Class", 10, 10)],
    "shop.php": [("LIMIT", "Constant", 6, 6), ("Shop", "Class", 7, 7), ("index", "Function", 7, 7), ("Store", "Interface", 8, 8), ("helper", "Function", 9, 9)],
    "shop.rb": [("Shop", "Module", 3, 17), ("LIMIT", "Constant", 4, 4), ("Cart", "Class", 5, 16), ("total", "Function", 7, 12), ("make", "Function", 13, 15)],
    "shop.kt": [("LIMIT", "Constant", 5, 5), ("Point", "Class", 6, 6), ("Single", "Class", 7, 7), ("q", "Constant", 7, 7),
        ("Names", "TypeAlias", 8, 8), ("twice", "Function", 9, 9), ("main", "Function", 10, 10), ("r", "Constant", 10, 10)],
    "shop.swift": [("Store", "Interface", 3, 3), ("all", "Function", 3, 3), ("Shop", "Class", 4, 7), ("size", "Constant", 5, 5),
        ("run", "Function", 6, 6), ("r", "Constant", 6, 6), ("Name", "TypeAlias", 8, 8)],
    "shop.c": [("node_t", "TypeAlias", 3, 3), ("node", "Class", 3, 3), ("color", "Class", 4, 4), ("count", "Constant", 5, 5), ("add", "Function", 6, 6)],
    "shop.cpp": [("shop", "Module", 2, 6), ("Cart", "Class", 3, 3), ("run", "Function", 4, 4), ("Names", "TypeAlias", 5, 5)],
    "Shop.scala": [("Store", "Interface", 5, 5), ("all", "Function", 5, 5), ("Point", "Class", 6, 6), ("Main", "Class", 7, 7),
        ("q", "Constant", 7, 7), ("f", "Function", 7, 7), ("Name", "TypeAlias", 7, 7)],
    "shop.py": [("Shop", "Class", 6, 10), ("total", "Function", 7, 10), ("main", "Function", 12, 13)],
}
#: source, names, default, namespace, line
IMPORTS = {
    "view.tsx": [("react", "React, useState as state, Kind", True, False, 1), ("path", "path", False, True, 2), ("./polyfill", "", False, False, 3)],
    "main.go": [("fmt", "fmt", False, True, 3), ("net/http", "http as h", False, True, 4), ("strings", "*", False, False, 5), ("embed", "", False, False, 6)],
    "lib.rs": [("std::io", "io", False, True, 1), ("std::collections", "HashMap, HashSet as Set", False, False, 2), ("crate::store", "store", False, True, 3)],
    "Shop.java": [("java.util", "List", False, False, 2), ("java.util", "*", False, True, 3), ("org.junit.Assert", "assertEquals", False, False, 4)],
    "Shop.cs": [("System", "*", False, True, 1), ("System.Collections.Generic", "*", False, True, 2)],
    "shop.php": [("App\\Models\\User", "User", False, False, 3), ("App\\Services\\UserService", "UserService as Svc", False, False, 4),
        ("boot.php", "", False, False, 5)],
    "shop.rb": [("sinatra", "", False, False, 1), ("lib/cart", "", False, False, 2), ("Comparable", "Comparable", False, False, 6)],
    "shop.kt": [("a.b", "Cart", False, False, 2), ("a.b", "Item as Thing", False, False, 3), ("io.ktor", "*", False, True, 4)],
    "shop.swift": [("Foundation", "Foundation", False, True, 1), ("Vapor", "Vapor", False, True, 2)],
    "shop.c": [("stdio.h", "stdio", False, True, 1), ("my/list.h", "list", False, True, 2)],
    "shop.cpp": [("vector", "vector", False, True, 1)],
    "Shop.scala": [("a.b", "Cart", False, False, 2), ("a.b", "Item, Price as Cost", False, False, 3), ("x.y", "*", False, True, 4)],
    "shop.py": [("os", "os", False, True, 1), ("numpy", "numpy as np", False, True, 2), (".models", "User as U, Cart", False, False, 3), ("lib", "*", False, True, 4)],
}
#: name, default, source of a re-export, line
EXPORTS = {
    "view.tsx": [("b", False, "./other", 4), ("default", True, "./other", 4), ("*", False, "./all", 5), ("View", True, None, 6),
        ("load", False, None, 7), ("Service", False, None, 9), ("Shape", False, None, 15)],
    "main.go": [("Server", False, None, 8), ("Runner", False, None, 9), ("Name", False, None, 10), ("A", False, None, 12), ("B", False, None, 13),
        ("Run", False, None, 15)],
}
#: callee, line, containing function, arguments
CALLS = {
    "view.tsx": [("helper", 6, "View", "x; `t${x}`"), ("db.query", 7, "load", "q; { a: 1 }"), ("log", 7, "load", "r"),
        ("super", 10, "constructor", ""), ("this.db.find", 12, "find", "id")],
    'main.go': [('s.db.Query', 16, 'Run', 'ctx; "x"'), ('fmt.Errorf', 17, 'Run', '"bad %v"; err'), ('h.HandleFunc', 19, 'main', '"/a"; handle')],
    "lib.rs": [("helper", 7, "draw", "self.name"), ("q.run", 7, "draw", "1")],
    "Shop.java": [("Repo", 7, None, ""), ("findAll", 10, "all", "n")],
    "Shop.cs": [("Load", 8, "Get", "id"), ("Ok", 8, "Get", "r")],
    'shop.php': [('find', 7, 'index', '1'), ('view', 7, 'index', "'x'; $u"), ('Cart', 9, 'helper', '$x')],
    'shop.rb': [('require', 1, None, "'sinatra'"), ('require_relative', 2, None, '"lib/cart"'), ('add', 8, 'total', 'x'), ('price', 10, 'total', 'i')],
    "shop.kt": [("find", 10, "main", "1")],
    "shop.swift": [("load", 6, "run", "a"), ("go", 6, "run", "r")],
    'shop.c': [('mul', 6, None, "a; 'c'"), ('visit', 6, None, 'r')],
    "shop.cpp": [("x", 3, None, ""), ("move", 4, None, "a")],
    "Shop.scala": [("load", 7, None, "1"), ("g", 7, "f", "a")],
    "shop.py": [("self.store.sum", 9, "total", "x; deep"), ("load", 13, "main", "1")],
}
#: variable, callee, line, containing function
ASSIGNMENTS = {
    "view.tsx": [("r", "db.query", 7, "load")],
    "main.go": [("rows", "s.db.Query", 16, "Run"), ("err", "s.db.Query", 16, "Run")],
    "lib.rs": [("q", "helper", 7, "draw")],
    "Shop.java": [("x", "findAll", 10, "all")],
    "Shop.cs": [("r", "Load", 8, "Get")],
    "shop.php": [("u", "find", 7, "index")],
    "shop.rb": [("r", "price", 10, "total")],
    "shop.kt": [("r", "find", 10, "main")],
    "shop.swift": [("r", "load", 6, "run")],
    "shop.c": [("r", "mul", 6, None)],
    "shop.cpp": [("r", "move", 4, None)],
    "Shop.scala": [("q", "load", 7, None)],
    "shop.py": [("r", "self.store.sum", 9, "total"), ("rows", "load", 13, "main")],
}
#: type, base
BASES = {
    "view.tsx": [("Service", "Core")],
    "Shop.java": [("Shop", "Base"), ("Shop", "Store")],
    "Shop.cs": [("Shop", "ControllerBase")],
    "shop.php": [("Shop", "Base")],
    "shop.rb": [("Cart", "Base")],
    "shop.kt": [("Point", "Base")],
    "shop.swift": [("Shop", "Base"), ("Shop", "Store")],
    "shop.cpp": [("Cart", "Base")],
    "Shop.scala": [("Point", "Store")],
    "shop.py": [("Shop", "Base")],
}


def imported() -> list[tuple]:
    """A row for each imported name: path, source, kind, local and remote name, line."""
    out = []
    for path, source, names, default, namespace, line in rows(IMPORTS):
        if not names:
            out.append((path, source, "SideEffect", None, None, line))
        for i, name in enumerate(names.split(", ") if names else ()):
            remote, _, local = name.partition(" as ")
            kind = "Namespace" if namespace else "Default" if default and i == 0 else "Named"
            out.append((path, source, kind, local or remote, "default" if kind == "Default" else remote, line))
    return out


#: path -> text; files that one rule or another takes for the start of something
ENTRY_SOURCES = {
    "src/jobs/mail.ts": 'import { Queue } from "effect";\nexport const drain = () => { return Queue.take(q); };\n',
    "src/jobs/night.ts": 'import * as Schedule from "effect/Schedule";\nconst plan = Schedule.cron("0 0 * * *");\n',
    "src/stream.ts": 'import { Stream } from "effect";\nfunction pump() { Stream.runForEach(s, f); }\n',
    "src/check.ts": 'import { it } from "@effect/vitest";\nit.effect("works", () => run());\n',
    "src/idle.ts": 'import { Effect } from "effect";\nfunction idle() { Queue.take(q); }\n',
    "app/modules/git.rs": "pub fn run() {}\n",
    "app/modules/mod.rs": "pub mod git;\n",
    "core/src/lib.rs": "pub struct Core;\n",
    "cmd/tool/main.go": "package main\nfunc main() { run() }\n",
    "web/api.go": 'package web\nimport "net/http"\nfunc Serve() { http.HandleFunc("/a", a) }\n',
    "shop/views.py": "from flask import Flask\n\ndef index():\n    return 1\n\ndef _hidden():\n    return 2\n",
    "src/main/java/a/UserController.java": "import org.springframework.web.bind.annotation.GetMapping;\npublic class UserController {\n  @GetMapping(\"/u\")\n  public String all() { return x; }\n}\n",
    "tests/test_cart.py": "def test_sum():\n    assert True\n",
    "src/Cart.test.ts": "const a = 1;\n",
}
ENTRYPOINTS = [
    ("src/jobs/mail.ts", "drain", "QueueConsumer"), ("src/jobs/night.ts", "Schedule.cron", "CronJob"), ("src/stream.ts", "pump", "EventHandler"),
        ("src/check.ts", "it.effect", "TestFile"),
    ("app/modules/git.rs", "git", "CliCommand"), ("core/src/lib.rs", "lib", "CliCommand"), ("cmd/tool/main.go", "main", "CliCommand"),
        ("web/api.go", "Serve", "HttpRoute"), ("shop/views.py", "index", "HttpRoute"),
    ("src/main/java/a/UserController.java", "all", "HttpRoute"), ("tests/test_cart.py", "test_sum", "TestFile"), ("src/Cart.test.ts", "Cart", "TestFile"),
]


def values(rows, types: str) -> str:
    """Rows as a SQL relation with typed, named columns: ``name TYPE, ..``."""
    def literal(x):
        if x is None:
            return "NULL"
        return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    names = [t.split()[0] for t in types.split(", ")]
    cast = ", ".join(f"CAST({t.split()[0]} AS {t.split()[1]}) AS {t.split()[0]}" for t in types.split(", "))
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


def changes(spark: SparkSession) -> DataFrame:
    rows = [(d, None, p, None, t, a, b) for d, files in CHANGES.items() for p, (t, a, b) in files.items()]
    return spark.createDataFrame(rows, "diff_id string, old_path string, new_path string, old_content string, new_content string, additions long, deletions long")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES.items()), "path string, source string")


def rows(table: dict) -> list[tuple]:
    return [(f"a/{file}", *row) for file, found in table.items() for row in found]


#: change, kind of row, what it is about, what is said of it
ANALYSIS = [
    ("shop", "summary", "typescript", "4 files; Express"), ("api", "summary", "python", "3 files; FastAPI"),
        ("lib", "summary", "typescript", "5 files; "), ("links", "summary", "typescript", "5 files; "),
    *[("shop", "entry", f"src/routes/health.ts::{x}", "HttpRoute") for x in ("ping", "router", "router.get")],
    *[("shop", "entry", f"src/routes/orders.ts::{x}", "HttpRoute") for x in ("postOrder", "router", "router.post")],
    ("api", "entry", "app/routes/parts.py::post_part", "HttpRoute"),
    ("shop", "group", "group_1", "ping (health) route; 1; 0.3125"), ("shop", "group", "group_2", "postOrder (orders) route; 2; 0.3125"),
    ("api", "group", "group_1", "post_part (parts) route; 1; 0.3125"),
    ("lib", "group", "group_1", "jobs (connected); 1; 0.225"), ("lib", "group", "group_2", "other; 2; 0.225"),
    ("links", "group", "group_1", "src (connected); 1; 0.225"), ("links", "group", "group_2", "src; 2; 0.225"),
    ("shop", "file", "src/routes/health.ts", "group_1; 0; Entrypoint; +1 -1"), ("shop", "file", "src/routes/orders.ts", "group_2; 0; Entrypoint; +6 -3"),
    ("shop", "file", "src/services/orderService.ts", "group_2; 1; Service; +7 -0"), ("shop", "file", "src/repositories/orderRepo.ts", "group_2; 2; Repository; +11 -0"),
    ("api", "file", "app/routes/parts.py", "group_1; 0; Entrypoint; +8 -0"), ("api", "file", "app/repositories/part_repo.py", "group_1; 1; Infrastructure; +5 -0"),
    ("api", "file", "app/services/part_service.py", "group_1; 2; Infrastructure; +6 -0"),
    ("lib", "file", "lib/jobs/one.ts", "group_1; 0; Utility; +2 -0"), ("lib", "file", "lib/jobs/two.ts", "group_1; 1; Utility; +2 -0"),
    ("lib", "file", "lib/text/pad.ts", "group_1; 2; Utility; +1 -0"), ("lib", "file", "other/alone.ts", "group_2; 0; Infrastructure; +1 -0"),
    ("links", "file", "src/barrel.ts", "group_1; 0; Infrastructure; +2 -0"), ("links", "file", "src/index.ts", "group_1; 1; Infrastructure; +9 -0"),
    ("links", "file", "src/setup.ts", "group_1; 2; Infrastructure; +1 -0"), ("links", "file", "src/tools.ts", "group_1; 3; Infrastructure; +3 -0"),
    ("links", "file", "src/control.ts", "group_2; 0; Infrastructure; +2 -0"),
    ("shop", "edge", "src/routes/orders.ts -> src/services/orderService.ts::placeOrder", "Imports"),
    ("shop", "edge", "src/routes/orders.ts::postOrder -> src/services/orderService.ts::placeOrder", "Calls"),
    ("shop", "edge", "src/services/orderService.ts -> src/repositories/orderRepo.ts::addOrder", "Imports"),
    ("shop", "edge", "src/services/orderService.ts::placeOrder -> src/repositories/orderRepo.ts::addOrder", "Calls"),
    ("lib", "edge", "lib/jobs/one.ts -> lib/text/pad.ts::pad", "Imports"), ("lib", "edge", "lib/jobs/one.ts::one -> lib/text/pad.ts::pad", "Calls"),
    ("lib", "edge", "lib/jobs/two.ts -> lib/text/pad.ts::pad", "Imports"), ("lib", "edge", "lib/jobs/two.ts::two -> lib/text/pad.ts::pad", "Calls"),
    ("links", "edge", "src/index.ts -> src/barrel.ts::start", "Imports"), ("links", "edge", "src/index.ts -> src/barrel.ts", "Imports"),
    ("links", "edge", "src/index.ts -> src/tools.ts", "Imports"), ("links", "edge", "src/index.ts -> src/setup.ts", "Imports"),
    # a name that its module only re-exports stands for the module when it is called
    ("links", "edge", "src/index.ts::run -> src/barrel.ts", "Calls"), ("links", "edge", "src/index.ts::run -> src/barrel.ts::start", "Calls"),
    ("links", "edge", "src/index.ts::run -> src/tools.ts::clean", "Calls"),
    ("links", "edge", "src/control.ts::stop -> src/control.ts::helper", "Calls"), ("links", "edge", "src/control.ts::helper -> src/control.ts", "Writes"),
    ("lib", "infra", "package.json", "Infrastructure"),
]


# --- edits of a grouping --------------------------------------------------------------

#: group, name, file of the entry point, risk, order
REFINE_GROUPS = [("group_1", "Users", "a/route.ts", 0.5, 1), ("group_2", "Orders", "b/route.ts", 0.4, 2), ("group_3", "Jobs", None, 0.3, 3),
    ("group_4", "Mail", "d/mail.ts", 0.2, 4)]
#: group, path, position, role, additions, deletions
REFINE_FILES = [
    ("group_1", "a/route.ts", 0, "Entrypoint", 3, 1), ("group_1", "a/service.ts", 1, "Service", 2, 0), ("group_1", "a/repo.ts", 2, "Repository", 1, 0),
    ("group_2", "b/route.ts", 0, "Entrypoint", 5, 0), ("group_2", "b/util.ts", 1, "Utility", 1, 1),
    ("group_3", "c/job.ts", 0, "Utility", 4, 0), ("group_4", "d/mail.ts", 0, "Entrypoint", 2, 2), ("group_4", "d/text.ts", 1, "Utility", 1, 0),
    ("infrastructure", "ci.yml", 0, "Infrastructure", 0, 0), ("infrastructure", "c/late.ts", 1, "Infrastructure", 0, 0),
]
REFINE_EDGES = [("group_1", "a/route.ts", "a/service.ts", "Imports"), ("group_2", "b/route.ts", "b/util.ts", "Calls"), ("group_4", "d/mail.ts", "d/text.ts", "Imports")]
#: the operations of a review; some name groups by name, some can't be applied
REFINE_SPLITS = [(0, "Users", 0, "User routes", 0, "a/route.ts"), (0, "Users", 0, "User routes", 1, "a/service.ts"),
    (0, "Users", 1, "User store", 0, "a/repo.ts"), (1, "group_4", 0, "Half", 0, "d/mail.ts"), (2, "group_9", 0, "None", 0, "x.ts")]
REFINE_MERGES = [(0, 0, "group_4", "Post"), (0, 1, " JOBS ", "Post"), (1, 0, "group_2", "No"), (1, 1, "group_8", "No")]
REFINE_RANKS = [(0, "group_2", 1), (1, "group_7", 1)]
REFINE_MOVES = [(0, "b/util.ts", "group_2", "Jobs"), (1, "c/late.ts", "infrastructure", "group_3"), (2, "d/text.ts", "group_4", "infrastructure"),
    (3, "b/util.ts", "group_2", "group_4"), (4, "no.ts", "group_1", "group_2"), (5, "ci.yml", "infrastructure", "group_6")]
#: kind of row, what it is about, what is said of it
REFINED = [
    # the repaired and the dropped
    ("warning", "Split 0", "source Users -> group_1"), ("warning", "Merge 0", "group_id  JOBS  -> group_3"), ("warning", "Reclassify 0", "to_group Jobs -> group_3"),
    ("warning", "Split 1", "split of group_4 leaves out: d/text.ts"), ("warning", "Split 2", "unknown source_group_id group_9"),
        ("warning", "Merge 1", "merge names an unknown group: group_8"),
    ("warning", "ReRank 1", "re-rank names an unknown group: group_7"), ("warning", "Reclassify 4", "reclassify: no.ts is not in group_1"),
        ("warning", "Reclassify 5", "reclassify to an unknown group: group_6"),
    # the new groups and the merged one stand at 0, group_2 was asked to 1
    ("group", "group_4", "Post; d/mail.ts; 0.0; 1"), ("group", "group_refined_1", "User routes; a/route.ts; 0.5; 2"),
        ("group", "group_refined_2", "User store; -; 0.5; 3"), ("group", "group_2", "Orders; b/route.ts; 0.4; 4"),
    ("file", "a/route.ts", "group_refined_1; 0; Entrypoint; 3; 1"), ("file", "a/service.ts", "group_refined_1; 1; Service; 2; 0"),
        ("file", "a/repo.ts", "group_refined_2; 0; Repository; 1; 0"),
    ("file", "b/route.ts", "group_2; 0; Entrypoint; 5; 0"),
    # the third group's files come before the fourth's; what was moved in stands behind
    ("file", "c/job.ts", "group_4; 0; Utility; 4; 0"), ("file", "b/util.ts", "group_4; 1; Utility; 1; 1"),
        ("file", "c/late.ts", "group_4; 2; Infrastructure; 0; 0"), ("file", "d/mail.ts", "group_4; 3; Entrypoint; 2; 2"),
    ("file", "ci.yml", "infrastructure; 0; Infrastructure; 0; 0"), ("file", "d/text.ts", "infrastructure; 1; Infrastructure; 0; 0"),
    ("edge", "b/route.ts -> b/util.ts", "group_2; Calls"), ("edge", "d/mail.ts -> d/text.ts", "group_4; Imports"),
]


def refinement(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    def made(rows, types):
        return spark.createDataFrame([("d", *r) for r in rows], f"diff_id string, {types}")

    ops = {
        "splits": made(REFINE_SPLITS, "ord int, source string, new_pos int, new_name string, file_pos int, path string"),
            "merges": made(REFINE_MERGES, "ord int, pos int, group_id string, merged_name string"),
        "ranks": made(REFINE_RANKS, "ord int, group_id string, new_position long"),
            "moves": made(REFINE_MOVES, "ord int, path string, from_group string, to_group string"),
    }
    return (
        made(REFINE_GROUPS, "group_id string, name string, entry_file string, risk double, review_order long"),
        made(REFINE_FILES, "group_id string, path string, flow_position long, role string, additions long, deletions long"),
        made(REFINE_EDGES, "group_id string, src string, dst string, edge_type string"), ops,
    )


#: what a reviewer may say of three changes: in a fence, bare, and not at all
ANSWERS = [
    ("a", 'Sure.\n```json\n{"splits": [{"source_group_id": "g1", "new_groups": [{"name": "x", "files": ["p", "q"]}, {"name": "y", "files": ["r"]}]}], "merges": [], "re_ranks": [{"group_id": "g2", "new_position": 1}]}\n```'),
    ("b", '{"merges": [{"group_ids": ["g1", "g3"], "merged_name": "m"}], "reclassifications": [{"file": "f", "from_group_id": "g1", "to_group_id": "infrastructure", "reason": "ci"}]}'),
    ("c", "I would leave it as it is."),
]
PARSED_ANSWERS = [
    ("a", "splits", 0, "g1; 0; x; 0; p"), ("a", "splits", 0, "g1; 0; x; 1; q"), ("a", "splits", 0, "g1; 1; y; 0; r"), ("a", "ranks", 0, "g2; 1"),
    ("b", "merges", 0, "0; g1; m"), ("b", "merges", 0, "1; g3; m"), ("b", "moves", 0, "f; g1; infrastructure"), ("c", "none", -1, "I would leave it as it is."),
]
