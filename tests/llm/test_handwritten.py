"""Files not written by hand, by example."""

from __future__ import annotations

import random

import numpy as np

from corpusmith.llm import handwritten
from corpusmith.llm.handwritten import BANDS, BINS, SIMILAR, head_lines, head_of, layout, masked, minhash, not_handwritten

HAND = "def load(path, limit=3):\n    with open(path) as f:\n        rows = [parse(x) for x in f]\n    if not rows: raise ValueError('none')\n    total = sum(r.size for r in rows[:limit])\n    return rows, total / len(rows)\n"


def files():
    r = random.Random(1)
    stub = "".join(f"  getField{i}() {{ return this.raw.f{i}[{i}]; }}\n  setField{i}(v) {{ this.raw.f{i}[{i}] = v; }}\n" for i in range(20))
    data = "T = (\n" + "".join('    "' + "".join(r.choice("abcdefXYZ0189+/") for _ in range(80)) + '"\n' for _ in range(30)) + ")\n"
    mini = ";".join(f"var a{i}=function(b,c){{return b.d{i}(c,{i})}}" for i in range(60))
    return {
        "src/hand.py": HAND, "src/stub.ts": stub, "src/other.ts": stub.replace("Field", "Name"), "src/table.py": data, "web/app.js": mini, "third_party/lib/x.py": HAND.replace("load", "other"), "src/vendors/vendor_pay.py": HAND.replace("rows", "bills"),
        "src/kit.py": "# Copied unchanged from upstream oakkit at 1f2e3d\n" + HAND, "src/licensed.py": "# Licensed under the terms of this tree.\n" + HAND, "src/made.go": "// Code generated by toolx. DO NOT EDIT.\npackage a\n", "tools/generator.py": HAND + 'out.write("// Code generated by me. DO NOT EDIT.")\n',
        "src/careful.py": "# Please do not edit the limits below without asking for review\n" + HAND, "docs/list.md": "".join(f"- item {i} of the list of things\n" for i in range(40)),
    }


def test_files(spark):
    own = files()
    rows = [("w", p, f"{i}", 1, t) for i, (p, t) in enumerate(own.items())]
    chunks = spark.createDataFrame(rows + rows[:2] + [("w", "src/null.py", "n", 1, None), ("w", "src/empty.py", "e", None, "")], "workspace_id string, path string, id string, start_line int, content string").selectExpr("*", "1 as size", "'k' as kind")
    manifest = spark.createDataFrame([("w", p) for p in [*own, "src/null.py", "node_modules/a/b.js", None]] + [("w", "src/stub.ts")], "workspace_id string, path string")
    got = {r.path: r.reason for r in not_handwritten(manifest, chunks).collect()}
    assert got == {"src/stub.ts": "generated", "src/other.ts": "generated", "src/table.py": "data", "web/app.js": "minified", "third_party/lib/x.py": "third_party", "src/kit.py": "copied", "src/made.go": "generated", "node_modules/a/b.js": "third_party"}
    assert not_handwritten(manifest.limit(0), chunks.limit(0)).count() == 0


def test_masks():
    assert masked('x = foo(1.5, "a b")\n') == "i=i(0,S)\n"
    assert (minhash(masked("a = b(1)\nc = d(2)")) == minhash(masked("x1 = y2(77)\nlong = other(5)"))).all()
    assert len(minhash("")) == len(minhash("i")) == 32
    assert head_of("// <auto-generated>\nx") == (True, False) and head_of("# SPDX-License-Identifier: MIT -- oaklib 2.1 bundled copy") == (False, True) and head_of("") == (False, False)
    assert not layout(HAND)["regular"]


SCHEMA = "workspace_id string, path string, id string, start_line int, content string"


def reasons(spark, rows):
    chunks = spark.createDataFrame(rows, SCHEMA)
    return {(r.workspace_id, r.path): r.reason for r in not_handwritten(chunks.select("workspace_id", "path"), chunks).collect()}


def test_notices_at_the_edges_of_files(spark):
    licence = "/*\n" + "".join(f"   permission is granted to everyone, clause {i}\n" for i in range(20))
    made = "// Code generated by stubsmith. DO NOT EDIT."
    body = HAND.replace("def", "function")
    rows = [
        ("w", "src/last.py", "1", 1, HAND * 3 + "\n# @generated\n\n"), ("w", "src/behind.js", "2", 1, licence + "*/\n" + made + "\n" + body), ("w", "src/block.js", "3", 1, body + "/* a\n This file was produced by the schema emitter\n*/\n"),
        ("w", "src/two.js", "4", 1, licence), ("w", "src/two.js", "5", 22, "more of it\n*/\n" + made + "\n" + body), ("w", "src/end.js", "6", 1, body * 3), ("w", "src/end.js", "7", 19, body + made),
        ("w", "src/foreign.js", "8", 1, body + "// Copied unchanged from upstream oakkit at 1f2e3d"),
        # templates and remarks amid hand-written code
        ("w", "src/tool.py", "9", 1, HAND * 2 + 'T = """\n' + made + '\npackage a\n"""\n' + HAND), ("w", "src/part.js", "10", 1, body * 3), ("w", "src/part.js", "11", 19, made + "\n" + body), ("w", "src/part.js", "12", 26, body),
        ("w", "docs/a.md", "13", 1, "# Title\n" + "a text about things\n" * 12 + "* generated by hand each week\n"),
    ]
    got = reasons(spark, rows)
    assert {p: r for (_, p), r in got.items()} == {"src/last.py": "generated", "src/behind.js": "generated", "src/block.js": "generated", "src/two.js": "generated", "src/end.js": "generated", "src/foreign.js": "copied"}


def test_families_dealt_in_one_workspace(spark):
    stub = lambda x: f'export class {x}Client extends Base {{\n  constructor(private http: Http, opts: Options) {{ super(opts, "{x}") }}\n  get(id: string) {{ return this.http.get(`/{x}/${{id}}`, {{ retry: 3 }}) }}\n}}\n'
    names = [f"Thing{chr(97 + i)}" for i in range(24)]
    assert not layout(stub("A"))["regular"]
    rows = [("one", f"src/{x}.ts", f"a{x}", 1, stub(x)) for x in names]
    # copies of one content, members in as many workspaces, and short or spoken ones are nobody's template
    rows += [("two", f"src/{x}.ts", f"b{x}", 1, stub("Same")) for x in names] + [(f"w{x}", "src/a.ts", f"c{x}", 1, stub(x)) for x in names]
    rows += [("three", f"src/{x}.ts", f"d{x}", 1, f"export * from './{x}';\n") for x in names] + [("four", f"src/{x}.ts", f"e{x}", 1, "\n".join(f"  a{i}: {i}, // what {x} is worth to us in all" for i in "4827")) for x in names]
    assert reasons(spark, rows) == {("one", f"src/{x}.ts"): "generated" for x in names}


def test_bands_find_families_at_the_limit():
    assert 1 - (1 - SIMILAR ** (BINS / BANDS)) ** BANDS > 0.98


def test_families_are_found_beside_others(spark, monkeypatch):
    """Masks that agree with each other, but in every band meet a first one that they don't agree with."""
    r = np.random.default_rng(4)
    common = r.integers(0, 2**31, BINS)
    sketches = {}
    for b in range(BANDS):  # with the smallest ids and forms
        sketches[f"a{b}"] = [*r.integers(0, 2**31, 4 * b), *common[4 * b : 4 * b + 4], *r.integers(0, 2**31, BINS - 4 * b - 4)]
    for i in range(11):
        sketches[f"b{i}"] = [*common[: 26 if i else 32], *r.integers(0, 2**31, 6 if i else 0)]
    rows = [
        ("w", f"src/{k}.ts", k, 100, n, n, k > "b" and k != "b10", False, 0.0, 0.2, 10.0, 1, False, [], [int(x) for x in s]) for n, (k, s) in enumerate(sketches.items())
    ]
    kind = "workspace_id string, path string, id string, size int, print long, form long, regular boolean, coded boolean, literal float, space float, line float, start int, whole boolean, heads array<struct<words:array<string>,made:boolean,foreign:boolean,place:int>>, sketch array<int>"
    table = spark.createDataFrame(rows, kind)
    monkeypatch.setattr(handwritten, "features", lambda chunks: chunks)
    got = {x.path for x in not_handwritten(table.select("workspace_id", "path"), table).collect()}
    assert got == {f"src/b{i}.ts" for i in range(11)}  # b10 by its family


def test_own_statements_arent_outvoted(spark):
    rows = [("w", f"src/a{i}.py", f"a{i}", 1, f"# {x}\n{HAND}") for i, x in enumerate(["reads lines para nosotros", "turns this off the path", "有关路径的说明", "loads the small table"] * 4)]
    said = {"es": "Archivo generado por protoc", "idl": "compiled from the idl", "zh": "自动生成请勿编辑", "de": "Automatisch generiert", "fr": "Fichier généré par outil"}
    rows += [("w", f"src/{k}.py", k, 1, f"# {x}\n{HAND}") for k, x in said.items()]
    # lines whose masks were once the same as those of the statements
    rows += [("w", f"src/b{i}.py", f"b{i}", 1, f"# {x}\n{HAND}") for i, x in enumerate(["Ficha escrita para nosotros", "taken from the sky", "sorted from the top", "路径", "Sortiert alles"] * 3)]
    assert reasons(spark, rows) == {("w", f"src/{k}.py"): "generated" for k in said}


def test_words_said():
    words = lambda text: head_lines(text)[0][0][0]
    assert words("# Archivo generado por protoc 3.2") == ["archivo", "generado", "por", "protoc"] and words("# 自动生成") == ["自动", "动生", "生成"] and words("// @generated don't") == ["@generated", "don't"]


def test_families_of_lines_are_learned(spark):
    """Words that open files which layout gives away tell of files that have none, without any list."""
    stub = lambda i: "".join(f"  getField{i}{k}() {{ return this.raw.f{k}[{k}]; }}\n  setField{i}{k}(v) {{ this.raw.f{k}[{k}] = v; }}\n" for k in range(12))
    note = "// spun out of model{} by loomtool, hands off"
    rows = [(f"w{i % 2}", f"src/a{i}.ts", f"a{i}", 1, note.format(i) + "\n" + stub(i)) for i in range(4)]
    rows += [("w3", f"src/b{i}.ts", f"b{i}", 1, note.format(i) + "\n" + HAND) for i in range(3)] + [("w4", f"src/c{i}.ts", f"c{i}", 1, f"// hands over the model{i} of the tool\n" + HAND) for i in range(9)]
    assert set(reasons(spark, rows)) == {(f"w{i % 2}", f"src/a{i}.ts") for i in range(4)} | {("w3", f"src/b{i}.ts") for i in range(3)}
    chunks = spark.createDataFrame(rows, SCHEMA)
    assert not_handwritten(chunks.select("workspace_id", "path"), chunks, lists=False).count() == 7
