from __future__ import annotations

import random
import subprocess

import pytest

from symweave.engine import Engine
from symweave.sources import discover
from symweave.sources.typescript_source import module_name, parse_typescript

SERVICE = """\
import React, { useState as us, type FC } from "react";
import { helper } from "./util/helper";
import * as fs from 'fs';
import "../side";

export const LIMIT = 10;
const re = /[{}(]/g;

@Injectable({ a: 1 })
export class Service<T> extends Base.Core<T> implements Api, Other {
  private readonly count: number = start();
  @Input() name?: string;

  constructor(private http: Http) { super(http); this.init(); }

  async load<K>(id: K, opts = { a: 1 }): Promise<T> {
    const x = await this.http.get(`a${id}`);
    if (x) { helper(x); } else { return new Thing(x) }
    return x.map((y) => convert(y));
  }

  get size() { return this.count }
}

interface Shape extends Base { area(): number; side: number }
enum Color { Red, Green }
export default function main(a: string): void {
  function inner(q) { return us(q) }
  inner(a)
}
export const arrow = async (n: number) => { log(n) };
main("x");
"""


def test_symbols():
    p = parse_typescript("src/app/service.ts", SERVICE)
    assert [(s["kind"], s["qualified_name"].removeprefix("src.app.service"), s["start_line"], s["end_line"], s["signature"]) for s in p.symbols] == [
        ("file", "", 1, 32, None), ("variable", ".LIMIT", 6, 6, None), ("variable", ".re", 7, 7, None), ("class", ".Service", 9, 23, None),
        ("variable", ".Service.count", 11, 11, None), ("variable", ".Service.name", 12, 12, None), ("method", ".Service.constructor", 14, 14, "constructor(private http: Http)"),
        ("method", ".Service.load", 16, 20, "load(id: K, opts = { a: 1 })"), ("method", ".Service.size", 22, 22, "size()"), ("class", ".Shape", 25, 25, None), ("method", ".Shape.area", 25, 25, "area()"),
        ("variable", ".Shape.side", 25, 25, None), ("class", ".Color", 26, 26, None), ("function", ".main", 27, 30, "main(a: string)"), ("function", ".main.inner", 28, 28, "inner(q)"),
        ("function", ".arrow", 31, 31, "arrow(n: number)"),
    ]
    assert {s["parent_qualified_name"] for s in p.symbols if s["qualified_name"].endswith((".load", ".count"))} == {"src.app.service.Service"}


def test_references():
    p = parse_typescript("src/app/service.ts", SERVICE)
    assert [(r["kind"], r["src_qualified_name"].removeprefix("src.app.service"), r["target_text"], r["evidence_line"]) for r in p.references] == [
        ("imports", "", "react.useState", 1), ("imports", "", "react.FC", 1), ("imports", "", "src.app.util.helper.helper", 2), ("imports", "", "fs", 3), ("imports", "", "src.side", 4),
        ("references", ".Service", "Injectable", 9), ("inherits", ".Service", "Base.Core", 10), ("inherits", ".Service", "Api", 10), ("inherits", ".Service", "Other", 10),
        ("calls", ".Service", "start", 11), ("references", ".Service.name", "Input", 12), ("calls", ".Service.constructor", "self.init", 14), ("calls", ".Service.load", "self.http.get", 17),
        ("calls", ".Service.load", "helper", 18), ("calls", ".Service.load", "Thing", 18), ("calls", ".Service.load", "x.map", 19), ("calls", ".Service.load", "convert", 19), ("inherits", ".Shape", "Base", 25),
        ("calls", ".main.inner", "us", 28), ("calls", ".main", "inner", 29), ("calls", ".arrow", "log", 31), ("calls", "", "main", 32),
    ]


@pytest.mark.parametrize(("path", "name"), [("a/b.ts", "a.b"), ("a/index.ts", "a"), ("index.tsx", "index"), ("a/types.d.ts", "a.types")])
def test_module_names(path, name):
    assert module_name(path) == name


def test_any_text_is_read():
    rng = random.Random(1)
    parts = ["class ", "function ", "{", "}", "(", ")", "x", "=", "=>", "<", ">", "import ", "'", '"', "`", "/", "@d ", ";", "\n", "const ", ".", "enum ", "extends ", "[", "]", ":", "async "]
    for _ in range(5000):
        assert parse_typescript("a.ts", "".join(rng.choices(parts, k=rng.randint(0, 40)))).symbols[0]["kind"] == "file"


def test_both_languages_in_one_index_from_a_clone(spark, tmp_path):
    origin = tmp_path / "origin"
    (origin / "web").mkdir(parents=True)
    (origin / "a.py").write_text("def f():\n    g()\n\n\ndef g():\n    pass\n")
    (origin / "web" / "util.ts").write_text("export function twice(x) { return x + x }\n")
    (origin / "web" / "app.ts").write_text("import { twice } from './util'\nexport function run() { return twice(2) }\n")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(origin), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    url, folder = f"file://{origin}", str(tmp_path / "clones" / "one")
    assert discover.clone(url, folder) == folder
    engine = Engine(spark, str(tmp_path / "store"))
    done = engine.index(folder, remote_url=url)
    assert (done.files_indexed, done.files_skipped) == (3, 0)
    assert {r["path"]: r["lang"] for r in engine.files(folder).collect()} == {"a.py": "python", "web/util.ts": "typescript", "web/app.ts": "typescript"}
    assert {(r["qualified_name"], r["kind"]) for r in engine.refs(folder, "web.util.twice").collect()} >= {("web.app.run", "calls"), ("web.app", "imports")}
    assert engine.store.table("repo").first()["remote_url"] == url
    (origin / "a.py").write_text("def f():\n    pass\n")
    run("commit", "-qam", "two")
    assert discover.clone(url, folder) == folder and engine.index(folder, remote_url=url).files_unchanged == 2
    for bad in ("--upload-pack=x", f"file://{tmp_path}/none"):
        with pytest.raises(ValueError, match="repository|could not read"):
            discover.clone(bad, str(tmp_path / "other"))
