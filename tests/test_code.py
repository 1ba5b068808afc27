import pytest

from fiberloom.operators import classes
from fiberloom.plans import detectors
from fiberloom.scratch import settle
from fiberloom.sources import code
from tests.code_fixture import ROWS


@pytest.fixture(scope="module")
def tables(spark):
    modules = settle(code.modules_from_rows(spark.createDataFrame(ROWS, "path string, source string")), "modules")
    return settle(code.facts(modules), "facts"), modules


def test_bases_are_resolved_and_closed(tables):
    got = {(r.symbol, r.base): (r.resolved, r.how) for r in classes.resolved_bases(tables[0]).collect()}
    assert got["pkg.pumps.Pump", "Drive"] == ("pkg.engine.Geared", "import")
    assert got["pkg.pumps.PumpOf", "Drive"] == ("pkg.engine.Geared", "import")
    assert got["pkg.fans.Fan", "works.Motor"] == ("pkg.engine.Motor", "import")
    assert got["pkg.mills.Mill", "Motor"][0] == "pkg.engine.Motor" and got["pkg.engine.Geared", "Motor"] == ("pkg.engine.Motor", "module")
    up = {(r.descendant, r.ancestor): r.depth for r in classes.lineage(tables[0]).collect()}
    assert up["pkg.pumps.Pump", "pkg.engine.Motor"] == 2 and up["pkg.pumps.Pump", "pkg.engine.Geared"] == 1
    assert {d for d, a in up if a == "pkg.engine.Motor"} == {"pkg.engine.Geared", "pkg.pumps.Pump", "pkg.pumps.PumpOf", "pkg.fans.Fan", "pkg.mills.Mill"}


def found(tables, *only):
    return {(r.detector, r.subject): r for r in detectors.findings(*tables, only=list(only)).collect()}


def test_mirror(tables):
    got = found(tables, "semantic_mirror", "manual_family_roster")
    assert any("HANDLERS" in s and s.endswith("pkg.handlers.Handler") for _, s in got)
    assert ("manual_family_roster", "ALL < pkg.handlers.Handler") in got


def test_environment(tables):
    assert [s for _, s in found(tables, "environment_authority_drift")] == ["elsewhere.$B"]


def test_others(tables):
    got = found(tables, "repeated_method_shape", "blank_line_run", "mirrored_constant", "injective_type_registry", "manual_registration", "string_dispatch", "attribute_probes", "syntax_errors")
    by = {}
    for d, s in got:
        by.setdefault(d, []).append(s)
    shape = next(r for k, r in got.items() if k[0] == "repeated_method_shape")
    assert shape.n == 2 and [e.symbol for e in shape.evidence] == ["AlphaHandler._go", "BetaHandler._went"]
    assert by["blank_line_run"] == ["pkg/spaced.py:2"] and got["blank_line_run", "pkg/spaced.py:2"].n == 6
    assert by["mirrored_constant"] == ["LIMIT | 7"] and by["injective_type_registry"] == ["pkg/more.py:REGISTRY"] and by["manual_registration"] == ["REGISTRY"]
    assert by["string_dispatch"] == ["pick.kind"] and by["attribute_probes"] == ["pkg/more.py"] and len(by["syntax_errors"]) == 1


def test_shapes(tables):
    got = found(tables, "protocol_contract", "manual_public_api", "prefixed_field_bundle", "constant_property_hook", "property_alias", "alternate_constructors", "suffix_axis_surface", "reflective_attribute_hook", "pass_through_wrapper", "optional_parameter_branch", "locals_call", "packed_line", "identity_keyword_forwarding", "repeated_type_cases", "classvar_only_leaves", "repeated_base_bundle", "reflective_self_access")
    by = {}
    for d, s in got:
        by.setdefault(d, []).append(s)
    assert by == {
        "protocol_contract": ["P"], "manual_public_api": ["__all__"], "prefixed_field_bundle": ["pkg.shapes.Box/left & pkg.shapes.Box/right"], "constant_property_hook": ["kind"],
        "property_alias": ["pkg.shapes.Box"], "alternate_constructors": ["pkg.shapes.Box"], "suffix_axis_surface": ["pkg.shapes.Box | json,yaml"], "reflective_attribute_hook": ["Box.__getattr__"],
        "pass_through_wrapper": ["wrap"], "optional_parameter_branch": ["a"], "locals_call": ["opt.locals"], "packed_line": ["pkg/shapes.py:49"], "identity_keyword_forwarding": ["opt.make"],
        "repeated_type_cases": ["int,str"], "classvar_only_leaves": ["Root"], "repeated_base_bundle": ["L1,L2"], "reflective_self_access": ["Box.__getattr__.getattr"],
    }


def test_all_run_and_are_stable(tables):
    one, two = (sorted(r.finding_id for r in detectors.findings(*tables).collect()) for _ in range(2))
    assert one == two and len(set(one)) == len(one)
    scoped = detectors.in_scope(detectors.findings(*tables, only=["mirrored_constant"]), ["pkg/more"])
    assert scoped.count() == 1 and detectors.in_scope(scoped, ["other"]).count() == 0


def test_evidence_targets(spark, tables):
    e = spark.createDataFrame([("pkg/handlers.py", 8, "AlphaHandler._go"), ("pkg/handlers.py", 17, "nowhere"), ("pkg/more.py", 7, "zzz")], "path string, at long, symbol string")
    got = {(r.at, r.qualname, r.kind) for r in classes.evidence_targets(e, classes.targets(tables[0])).collect()}
    assert (8, "AlphaHandler._go", "method") in got and (17, "pkg.handlers", "module") in got and (7, "pick", "function") in got


def test_scan_of_a_tree(spark, tmp_path):
    for path, source in [*ROWS, (".hidden/x.py", "x = 1"), ("build/y.py", "y = 1"), ("tests/test_z.py", "z = 1")]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(source)
    got = {r.path: r.module for r in code.modules(spark, [str(tmp_path)]).collect()}
    assert set(got) >= {p for p, s in ROWS if s} | {"tests/test_z.py"} and got["pkg/engine.py"] == "pkg.engine"
    assert not [p for p in got if p.startswith((".hidden", "build"))]
    assert "tests/test_z.py" not in {r.path for r in code.modules(spark, [str(tmp_path), str(tmp_path / "pkg")], tests=False).collect()}
    assert detectors.analyze(spark, [str(tmp_path)], only=["mirrored_constant"]).count() == 1


def settled(spark, rows):
    modules = settle(code.modules_from_rows(spark.createDataFrame(rows, "path string, source string")), "modules")
    return settle(code.facts(modules), "facts"), modules


def test_a_scope_is_asked_of_all_places(spark):
    """Nine modules with one constant: more than evidence holds, and a folder is not another that its name begins."""
    tables = settled(spark, [(f"p{i}/m.py", "LIMIT = 7\n") for i in range(9)])
    got = detectors.findings(*tables, only=["mirrored_constant"])
    assert got.first().n == 9 and len(got.first().evidence) == detectors.EVIDENCE
    assert detectors.in_scope(got, ["p8"]).count() == 1 and detectors.in_scope(got, ["p8/m.py"]).count() == 1
    assert detectors.in_scope(got, ["p"]).count() == 0 and detectors.in_scope(got, ["p8/mm"]).count() == 0


def test_pairs_of_classes_have_places(spark):
    tables = settled(spark, [("pkg/a.py", "class A:\n    x: int\n    y: int\n    p: int\nclass B:\n    x: int\n    y: int\n    q: int\n")])
    (r,) = detectors.in_scope(detectors.findings(*tables, only=["repeated_field_family"]), ["pkg"]).collect()
    assert [(e.path, e.line) for e in r.evidence] == [("pkg/a.py", 1), ("pkg/a.py", 5)]


def test_a_module_too_deep_is_a_fact(spark):
    tables = settled(spark, [("deep.py", "x = " + " + ".join(["1"] * 20_000)), ("fine.py", "LIMIT = 7\n")])
    assert [r.path for r in tables[0].where("family = 'syntax_error'").collect()] == ["deep.py"]
    assert tables[0].where("path = 'fine.py' and family = 'constant'").count() == 1


def test_a_parse_lists_no_node_twice_and_writes_like_bodies_once(monkeypatch):
    import ast
    import hashlib
    from collections import Counter

    from fiberloom.sources import shapes

    listed, written = Counter(), []
    walk, unparse = ast.iter_child_nodes, ast.unparse
    monkeypatch.setattr(ast, "iter_child_nodes", lambda node: (listed.update([node]), walk(node))[1])
    monkeypatch.setattr(ast, "unparse", lambda node: (written.append(node), unparse(node))[1])
    source = "".join(f"class A{i}:\n    def f{i}(self, a{i}):\n        if a{i} > {i}:\n            return self.g{i}(a{i}, k='v{i}')\n        return [x{i} async for x{i} in a{i}] + [-{i}.5]\n" for i in range(5))
    facts = [r for r in code.parse(source) if r[0] == "method"]
    assert max(listed.values(), default=0) <= 1 and len(facts) == 5
    assert len({r[6] for r in facts}) == 1 and len([n for n in written if isinstance(n, ast.Module)]) <= 1

    def plain(f):
        return hashlib.md5(ast.dump(code.Shape().visit(ast.parse(unparse(ast.Module(body=code.body_of(f), type_ignores=[]))))).encode()).hexdigest()

    bodies = ["return 1", "return 'a'", "return -1", "return 1j", "return None", "return f'{a!r:>{b}} c'", "return f'{1}' 'x'", "'said'\nreturn x.y", "x = 1, 2", "x: int = 3", "global z\nz = 1", "match a:\n  case [1, *b]: pass\n  case {'k': v, **w}: pass", "from a import b as c", "return lambda p, *q, r=1, **s: (p, q)", "f(*a, **b, c=1)", "f(d=1)", f"return 0x{'f' * 300}"]
    for text in bodies + bodies:
        f = ast.parse("def f():\n" + "\n".join(f"  {line}" for line in text.split("\n"))).body[0]
        assert code.fingerprint(f) == plain(f), text
    f = ast.parse("def f(a):\n  return a.b(c) if a else [d for d in a if -d]").body[0]
    assert [x for x in shapes.inside(f, ast.Call, ast.Name)] == [x for x in ast.walk(f) if isinstance(x, (ast.Call, ast.Name))]
