"""Findings in a source tree that is written from a table, so that SQL can say what has to be found.

For each detector CASES has the files of a key that it must report, those of a key that it must not, and the finding's
subject and number of places.  ``tree`` writes the files for every supplier: the first kind for even keys, the second for
odd ones.  A detector reads its own folder, and the queries give (detector, subject, places).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberloom.plans import registry
from fiberloom.plans.detectors import DETECTORS, LIMITS, of_detector
from fiberloom.scratch import settle
from fiberloom.sources import code

#: name: (files of a reported key, files of one that is not, subject, places).
#: ``{k}`` is the key, ``{p}`` the file m{k}.py, ``{m}`` its module, ``{d}`` the folder.
CASES: dict[str, tuple[dict[str, str], dict[str, str], str, int]] = {}


def case(name: str, yes: str | dict, no: str | dict, subject: str, places: int = 1) -> None:
    whole = lambda x: x if isinstance(x, dict) else {"m{k}.py": x}
    for short, long in (("{p}", f"{name}/m{{k}}.py"), ("{m}", f"{name}.m{{k}}"), ("{d}", name)):
        subject = subject.replace(short, long)
    CASES[name] = whole(yes), whole(no), subject, places


def cls(name: str, *lines: str, bases: str = "", above: str = "") -> str:
    """A class with the lines as its body; lines of a method are indented further."""
    return f"{above}class {name}{f'({bases})' if bases else ''}:\n" + "".join(f"    {x}\n" for line in lines or ("pass",) for x in line.split("\n"))


def fn(head: str, *lines: str, above: str = "") -> str:
    return f"{above}def {head}:\n" + "".join(f"    {x}\n" for line in lines or ("pass",) for x in line.split("\n"))


def method(head: str, *lines: str, above: str = "") -> str:
    return fn(head, *lines, above=above).rstrip("\n")


def prop(name: str, value: str) -> str:
    return method(f"{name}(self)", f"return {value}", above="@property\n")


RECORD = "@dataclass\n"
THREE = ("a = x + 1", "b = a * 2", "return b")


def like(*lines: str) -> str:
    """The fingerprint of a body."""
    import ast

    return code.fingerprint(ast.parse(fn("f(self, x)", *lines)).body[0])


def twice(a: str, b: str) -> tuple[str, str]:
    """Both, and the first alone."""
    return a + b, a


# records and their fields
three = lambda name, *f, above="": cls(name, *[f"{x}{{k}}: int" for x in f], above=above)
case("carrier_reuse", {"m{k}a.py": three("Alpha{k}", "r", "s", "t", above=RECORD), "m{k}b.py": three("Beta{k}", "r", "s", "t", above=RECORD)}, {"m{k}a.py": three("Alpha{k}", "r", "s", "t", above=RECORD), "m{k}b.py": three("Beta{k}", "r", "s", "u", above=RECORD)}, "{m}a.Alpha{k} & {m}b.Beta{k}", 3)
case("parallel_primitive_carrier", three("A{k}", "r", "s", "t") + three("B{k}", "r", "s", "t"), three("A{k}", "r", "s", "t") + three("B{k}", "r", "s", "u"), "{m}.A{k} & {m}.B{k}", 3)
case("renamed_slices", cls("A{k}", "a: int", "b: str", "c: float", above=RECORD) + cls("B{k}", "x: int", "y: str", "z: float", above=RECORD), cls("A{k}", "a: int", "b: str", "c: float", above=RECORD) + cls("B{k}", "x: str", "y: int", "z: float", above=RECORD), "{p} | int,str,float", 2)
case("repeated_field_family", three("A{k}", "r", "s", "p") + three("B{k}", "r", "s", "q"), three("A{k}", "r", "s", "p") + three("B{k}", "r", "v", "q"), "{m}.A{k} & {m}.B{k}", 2)
case("prefixed_field_bundle", cls("Box{k}", *[f"{s}_{x}: int" for s in ("left", "right") for x in "xyz"]), cls("Box{k}", *[f"{s}_{x}: int" for s in ("left", "right") for x in "xy"]), "{m}.Box{k}/left & {m}.Box{k}/right", 3)
case("authority_reuse", {"m{k}a.py": cls("Store{k}", "r{k}: int", "s{k}: int", "t{k}: int", bases="ABC"), "m{k}b.py": three("Copy{k}", "r", "s", "t")}, {"m{k}a.py": cls("Store{k}", "r{k}: int", "s{k}: int", "t{k}: int", bases="ABC"), "m{k}b.py": three("Copy{k}", "r", "s")}, "{m}b.Copy{k} & {m}a.Store{k}", 3)
case("authority_retreat", {"m{k}a.py": cls("Store{k}", "r{k}: int", "s{k}: int", bases="ABC"), "m{k}b.py": three("JsonStore{k}", "r", "s")}, {"m{k}a.py": cls("Store{k}", "r{k}: int", "s{k}: int", bases="ABC"), "m{k}b.py": "from authority_retreat.m{k}a import Store{k}\n" + cls("JsonStore{k}", "r{k}: int", "s{k}: int", bases="Store{k}")}, "{m}b.JsonStore{k} & {m}a.Store{k}", 2)
both = ("r{k}: int", "s{k}: int", method("one{k}(self)"), method("two{k}(self)"))
case("duplicate_surface", cls("A{k}", *both) + cls("B{k}", *both), cls("A{k}", *both) + cls("B{k}", *both, bases="A{k}"), "{m}.A{k} & {m}.B{k}", 4)
case("companion_records", three("Order{k}", "r", "s", above=RECORD) + three("Order{k}Draft", "r", "s", above=RECORD), three("Order{k}", "r", "s", above=RECORD) + three("Parcel{k}", "r", "s", above=RECORD), "Order{k} & Order{k}Draft", 2)
case("option_records", *twice(cls("A{k}", "a: int = 1", "b: int = 2", above=RECORD), cls("B{k}", "a: int = 3", "b: int = 4", above=RECORD)), "{p} | a,b", 2)
case("witness_family", "".join(cls(f"{n}{{k}}Hit", f"{n.lower()}_line: int", f"{n.lower()}_path: str", f"{n.lower()}_kind: str", above="@dataclass(frozen=True)\n") for n in "ABC"), "".join(cls(f"{n}{{k}}Hit", f"{n.lower()}_line: int", f"{n.lower()}_path: str", f"{n.lower()}_kind: str", above="@dataclass(frozen=True)\n") for n in "AB"), "{p} | Hit", 3)
case("restated_defaults", cls("Rec{k}", "a: int = 1", above=RECORD) + "Rec{k}(a=1)\n", cls("Rec{k}", "a: int = 1", above=RECORD) + "Rec{k}(a=2)\n", "Rec{k}.a=1")
case("schema_registry_mirror", cls("Rec{k}", "a{k}: int", "b{k}: int", above=RECORD) + "TABLE{k} = {'a{k}': 1, 'b{k}': 2}\n", cls("Rec{k}", "a{k}: int", "b{k}: int", above=RECORD) + "TABLE{k} = {'a{k}': 1, 'c{k}': 2}\n", "TABLE{k}~Rec{k}")
case("record_mechanics_by_hand", *twice(cls("A{k}", method("to_dict(self)"), method("merge(self, o)"), above=RECORD), cls("B{k}", method("to_dict(self)"), method("merge(self, o)"), above=RECORD)), "{p} | merge,to_dict", 2)
case("role_surface_drift", cls("Box{k}", "left{k}: int") + fn("f(b)", "make(wide{k}=b.left{k})") + fn("g(b)", "make(wide{k}=b.left{k})"), cls("Box{k}", "left{k}: int") + fn("f(b)", "make(wide{k}=b.left{k})") + fn("g(b)", "make(left{k}=b.left{k})"), "left{k} | wide{k}", 2)
case("distributed_boundary_fanout", cls("A", "w{k}: int") + cls("B", "w{k}: int") + fn("f(x)", "make(w{k}=x.w{k})", "make(w{k}=x.w{k})"), cls("A", "w{k}: int") + cls("B", "w{k}: int") + fn("f(x)", "make(w{k}=x.w{k})"), "w{k}", 4)
case("boundary_local_wrappers", fn("wrap{k}(v)", "return Rec(w{k}=v)") + fn("f(x)", "go(w{k}=x)", "go(w{k}=x)", "go(w{k}=x)"), fn("wrap{k}(v)", "return Rec(w{k}=v)") + fn("f(x)", "go(w{k}=x)"), "wrap{k}")
case("namespace_mirror", cls("Conf{k}", method("from_namespace(cls, ns)", "return cls(a{k}=ns.a{k}, b{k}=ns.b{k})", above="@classmethod\n")) + "ARGS{k} = [Arg('--a{k}'), Arg('--b{k}')]\n", cls("Conf{k}", method("from_namespace(cls, ns)", "return cls(a{k}=ns.a{k}, b{k}=ns.b{k})", above="@classmethod\n")) + "ARGS{k} = [Arg('--a{k}'), Arg('--z{k}')]\n", "Conf{k}")
case("parameter_thread_family", fn("f{k}(a{k}, b{k}, c{k}, d{k}, e{k})", *["x = 1"] * 41) + fn("g{k}(a{k}, b{k}, c{k}, d{k}, e{k})"), fn("f{k}(a{k}, b{k}, c{k}, d{k}, e{k})", *["x = 1"] * 41) + fn("g{k}(a{k}, b{k}, c{k}, d{k})"), "{p}:1:f{k} | {p}:43:g{k}", 5)

# properties and methods of a class
case("property_alias", cls("C{k}", prop("a", "self.x"), prop("b", "self.y")), cls("C{k}", prop("a", "self.x"), prop("b", "self.y + 1")), "{m}.C{k}", 2)
case("property_alias_class", cls("C{k}", prop("a", "self.x"), prop("b", "self.y")), cls("C{k}", prop("a", "self.x"), prop("b", "self.y"), method("go(self)")), "C{k}")
case("property_alias_method", cls("C{k}", prop("a", "self.x")), cls("C{k}", method("a(self)", "return self.x + 1")), "C{k}.a")
case("constant_property_hook", *twice(cls("A{k}", prop("kind{k}", "'a'")), cls("B{k}", prop("kind{k}", "'b'"))), "kind{k}", 2)
case("constant_property_bundle", cls("C{k}", prop("a", "1"), prop("b", "2")), cls("C{k}", prop("a", "1"), prop("b", "self.go()")), "{m}.C{k}", 2)
case("projection_properties", *twice(cls("A{k}", prop("view", "View{k}(a=self.a)")), cls("B{k}", prop("view", "View{k}(a=self.a)"))), "{p} | view | View{k} | a", 2)
case("path_properties", cls("C{k}", prop("a", "self.root / 'a'"), prop("b", "Path(self.root)")), cls("C{k}", prop("a", "self.root / 'a'"), prop("b", "self.root")), "{m}.C{k}", 2)
case("collection_projections", cls("C{k}", prop("a", "tuple(x.a for x in self.rows)"), prop("b", "tuple(x.b for x in self.rows)")), cls("C{k}", prop("a", "tuple(x.a for x in self.rows)"), prop("b", "tuple(x.b for x in self.cols)")), "{m}.C{k} | rows", 2)
case("stream_materialisation", cls("C{k}", method("a(self)", "return tuple(x for x in self.rows)"), method("b(self)", "return list(f(x) for x in self.rows)")), cls("C{k}", method("a(self)", "return tuple(x for x in self.rows)")), "{m}.C{k} | rows", 2)
case("location_property", cls("C{k}", prop("at", "SourceLocation(self.a, self.b, self.c)")), cls("C{k}", prop("at", "SourceLocation(self.a, 1, self.c)")), "C{k}.at")
case("zipped_location_property", cls("C{k}", prop("at", "tuple(SourceLocation(p, a, b) for a, b in zip(self.x, self.y))")), cls("C{k}", prop("at", "tuple(SourceLocation(p, a, 1) for a in self.x)")), "C{k}.at")
case("template_payloads", cls("C{k}", method("a(self)", "return 'x\\ny\\nz'"), method("b(self)", "return 'x\\ny\\nw'")), cls("C{k}", method("a(self)", "return 'x\\ny\\nz'"), method("b(self)", "return 'x'")), "{m}.C{k}", 2)
case("alternate_constructors", cls("C{k}", *[method(f"from_{x}(cls, v)", "return cls()", above="@classmethod\n") for x in "abc"]), cls("C{k}", *[method(f"from_{x}(cls, v)", "return cls()", above="@classmethod\n") for x in "ab"]), "{m}.C{k}", 3)
case("constructor_variants", cls("C{k}", method("a(self)", "return Rec{k}(x=1)"), method("b(self)", "return Rec{k}(y=2)")), cls("C{k}", method("a(self)", "return Rec{k}(x=1)"), method("b(self)", "return Row{k}(y=2)")), "{m}.C{k} | Rec{k}", 2)
case("sparse_constructor_variants", cls("C{k}", *[method(f"of_{x}(cls, v)", f"return cls({x}=v)", above="@classmethod\n") for x in "ab"]), cls("C{k}", *[method(f"of_{x}(cls, v)", "return cls(a=v)", above="@classmethod\n") for x in "ab"]), "{m}.C{k}", 2)
folded = ("acc = Fold{k}()", "for x in xs:\n    acc.step(x)", "return acc.result()")
case("accumulator_folds", cls("C{k}", method("a(self, xs)", *folded), method("b(self, xs)", *folded)), cls("C{k}", method("a(self, xs)", *folded)), "{m}.C{k} | Fold{k}", 2)
case("regex_group_extractors", cls("C{k}", *[method(f"{x}(self, s)", "m = self.p.match(s)", "return m.group(1)") for x in "ab"]), cls("C{k}", *[method(f"{x}(self, s)", "m = self.p.match(s)", f"return m.group({x == 'a' and 1 or 2})") for x in "ab"]), "{m}.C{k} | 1", 2)
case("schema_accessors", cls("C{k}", method("a(self)", "return self.need(Key{k}.A)"), method("b(self)", "return self.need(Key{k}.B)")), cls("C{k}", method("a(self)", "return self.need(Key{k}.A)"), method("b(self)", "return self.need(Lock{k}.B)")), "{m}.C{k} | Key{k}", 2)
case("field_projections", cls("C{k}", method("a(self)", "return clean{k}(self.a)"), method("b(self)", "return clean{k}(self.b)")), cls("C{k}", method("a(self)", "return clean{k}(self.a)")), "{m}.C{k} | clean{k}", 2)
case("suffix_axis_surface", cls("Box{k}", *[method(f"{o}_{x}(self)") for o in ("load", "dump") for x in ("json", "yaml")]), cls("Box{k}", *[method(f"load_{x}(self)") for x in ("json", "yaml")]), "{m}.Box{k} | json,yaml", 2)
case("class_role_quotient", cls("Big{k}", *[method(f"_{r}_{x}(self)") for r in ("load", "save", "check") for x in "ab"]), cls("Big{k}", *[method(f"_{r}_{x}(self)") for r in ("load", "save") for x in "ab"]), "{m}.Big{k}", 6)
case("facade_only", cls("Facade{k}", method("a(self)", "return _a(self)"), method("b(self)", "return _b(self)")), cls("Facade{k}", method("a(self)", "return _a(self)"), method("b(self)", "return _b(self)"), method("c(self)", "return 1")), "{m}.Facade{k}", 2)
case("alias_catalog", cls("Alias{k}", "a = staticmethod(f)", "b = staticmethod(g)"), cls("Alias{k}", "a = staticmethod(f)", "b = 2"), "Alias{k}")
case("self_naming_builders", cls("C{k}", *[f"{x} = field('{x}', n=1)" for x in "abc"]), cls("C{k}", *[f"{x} = field('{x}', n=1)" for x in "ab"]), "{p} | C{k} field", 3)
case("manual_fiber_tag", cls("C{k}", method("__init__(self, kind)", "self.kind = kind", "self.size = 1"), method("go(self)", "if self.kind == 'a':\n    return 1", "if self.kind == 'b':\n    return 2")), cls("C{k}", method("__init__(self, kind)", "self.kind = kind", "self.size = 1"), method("go(self)", "if self.kind == 'a':\n    return 1")), "C{k}")
case("stale_derived_views", cls("C{k}", method("__init__(self, xs)", "self.xs = xs", "self.size = len(self.xs)"), method("put(self, ys)", "self.xs = ys")), cls("C{k}", method("__init__(self, xs)", "self.xs = xs", "self.size = len(self.xs)"), method("put(self, ys)", "self.xs = ys", "self.size = len(ys)")), "C{k}")
case("visitor_stack", cls("V{k}", method("__init__(self)", "self.stack = []"), method("visit_Name(self, n)", "self.stack.append(n)"), bases="ast.NodeVisitor"), cls("V{k}", method("__init__(self)", "self.stack = []"), method("visit_Name(self, n)", "self.stack.append(n)")), "V{k}")
case("duplicate_visitor_method", cls("V{k}", method("visit_A(self, x)", *THREE), method("visit_B(self, y)", "c = y + 3", "d = c * 4", "return d")), cls("V{k}", method("visit_A(self, x)", *THREE), method("visit_B(self, y)", "return y")), "{m}.V{k} | " + like(*THREE), 2)
case("reflective_attribute_hook", cls("C{k}", method("__getattr__(self, n)", "return 1")), cls("C{k}", method("get(self, n)", "return 1")), "C{k}.__getattr__")
case("reflective_self_access", cls("C{k}", method("go(self)", "return getattr(self, 'x')")), cls("C{k}", method("go(self, o)", "return getattr(o, 'x')")), "C{k}.go.getattr")
case("dynamic_self_fields", cls("C{k}", method("go(self, n)", "return getattr(self, n)")), cls("C{k}", method("go(self, n)", "return getattr(self, 'n')")), "C{k}.go")
case("string_backed_lookup", cls("C{k}", method("go(self)", "return globals()[self.kind]")), cls("C{k}", method("go(self)", "return globals()['kind']")), "C{k}.go")
case("typed_cast_first", cls("C{k}", method("go(self, c)", "x = cast(Rec{k}, c)", "return x.a")), cls("C{k}", method("go(self, c)", "x = read(c)", "return x.a")), "C{k}.go")
case("collector_boilerplate", cls("C{k}", method("go(self, module)", "return _find_candidates(module)")), cls("C{k}", method("go(self, module)", "return _find_candidates(module, 1)")), "C{k}.go")
case("direct_finding_renderer", cls("C{k}", method("go(self, x)", "return self.build_finding(x, a=1)")), cls("C{k}", method("go(self, x)", "y = x", "return self.build_finding(y, a=1)")), "C{k}.go")
case("finding_spec_build", cls("C{k}", method("go(self)", "return self.finding_spec.build(self.detector_id, 1)")), cls("C{k}", method("go(self)", "return self.finding_spec.build(1)")), "C{k}.go")
case("step_owns_apply", cls("My{k}Step", method("apply(self, a, b)", "if a is None:\n    return None", "if b is None:\n    return None", "return a")), cls("My{k}Rule", method("apply(self, a, b)", "if a is None:\n    return None", "if b is None:\n    return None", "return a")), "My{k}Step.apply")
case("finding_assembly", *twice(*[cls(f"{n}{{k}}", method("go(self, out)", "for c in collect(self):\n    out.append(make{k}(c))")) for n in "AB"]), "{p} | make{k}", 2)
case("guarded_delegator", *twice(*[cls(f"{n}{{k}}", method("run(self, x)", "if not x:\n    return None", "return serve{k}(x)")) for n in "AB"]), "{p} | serve{k}", 2)
case("catalog_mixins", *twice(*[cls(f"{n}{{k}}", method("__init_subclass__(cls)", "cls.cat{k} = []")) for n in "AB"]), "{p} | cat{k}", 2)
case("helper_backed_classes", *twice(*[cls(f"{n}{{k}}", method("run(self)", "return help(self)"), bases="Base{k}") for n in "AB"]), "{p} | Base{k}", 2)
case("repeated_keyed_family", *twice(*[cls(f"{n}{{k}}", "_registry = {}", method("get_{k}(self)")) for n in "AB"]), "get_{k}", 2)
case("manual_keyed_records", "".join(cls(f"{n}{{k}}", "_registry = {}", method("register(self)"), method("get_{k}(self)")) for n in "AB"), "".join(cls(f"{n}{{k}}", "_registry = {}", method("get_{k}(self)")) for n in "AB"), "{p} | get_{k}", 2)
checks = lambda *f: method("validate(self, x)", *[f"if x.{g}:\n    raise ValueError" for g in f])
case("validate_guard_family", "".join(cls(f"{n}{{k}}", checks("ndim != {k}", "shape != 2", "shape[0] > {k}")) for n in "AB"), cls("A{k}", checks("ndim != {k}", "shape != 2", "shape[0] > {k}")) + cls("B{k}", checks("ndim != {k}", "shape != 3", "shape[0] > {k}")), "{m}.A{k},{m}.B{k}", 2)
case("inline_tree_predicates", cls("C{k}", method("go(self, t)", "for n in t:\n    isinstance(n, ast.A), isinstance(n, ast.B), isinstance(n, ast.C)")), cls("C{k}", method("go(self, n)", "isinstance(n, ast.A), isinstance(n, ast.B), isinstance(n, ast.C)")), "C{k}.go")
case("identity_keyword_forwarding", fn("f{k}(a, b, c)", "return make(a=a, b=b, c=c)"), fn("f{k}(a, b, c)", "return make(a=a, b=c, c=b)"), "f{k}.make")

# like bodies
case("repeated_method_shape", cls("A{k}", method("_a(self, x)", *THREE)) + cls("B{k}", method("_b(self, y)", "c = y + 7", "d = c * 9", "return d")), cls("A{k}", method("_a(self, x)", "a = x + 1", "return a")) + cls("B{k}", method("_b(self, y)", "c = y + 7", "return c")), "1 | 2 | " + like(*THREE), 2)
pair = lambda n, *names, bases="": cls(n, *[method(f"{m}{{k}}(self, x)", *THREE) for m in names], bases=bases)
case("hierarchy_candidate", pair("A{k}", "one", "two") + pair("B{k}", "one", "two"), pair("A{k}", "one", "two") + pair("B{k}", "one", "six"), "{m}.A{k},{m}.B{k}", 2)
case("sibling_overlap", pair("A{k}", "one", bases="Base{k}") + pair("B{k}", "one", bases="Base{k}"), pair("A{k}", "one", bases="Base{k}") + pair("B{k}", "one", bases="Other{k}"), "Base{k} | one{k} | " + like(*THREE), 2)
case("sibling_overlap_family", pair("A{k}", "one", "two", bases="Base{k}") + pair("B{k}", "one", "two", bases="Base{k}"), pair("A{k}", "one", "two", bases="Base{k}") + pair("B{k}", "one", bases="Base{k}"), "Base{k} | {m}.A{k},{m}.B{k}", 2)
case("inheritance_lattice", pair("A{k}", "one", "two", bases="Base{k}") + pair("B{k}", "one", "two", bases="Base{k}") + pair("C{k}", "one", bases="Base{k}"), pair("A{k}", "one", "two", bases="Base{k}") + pair("B{k}", "one", "two", bases="Base{k}"), "Base{k}")
case("private_helper_shadow", {"m{k}a.py": fn("helper{k}(x)", *THREE), "m{k}b.py": fn("_mine{k}(y)", "c = y + 7", "d = c * 9", "return d")}, {"m{k}b.py": fn("_mine{k}(y)", "return y")}, "_mine{k}")
case("abstraction_reuse", {"m{k}a.py": fn("authority{k}(x)", *[f"{c}{{k}}(x)" for c in "abcde"]), "m{k}b.py": "from abstraction_reuse.m{k}a import authority{k}\n" + fn("local{k}(x)", *[f"{c}{{k}}(x)" for c in "abcde"])}, {"m{k}a.py": fn("authority{k}(x)", *[f"{c}{{k}}(x)" for c in "abcde"]), "m{k}b.py": fn("local{k}(x)", *[f"{c}{{k}}(x)" for c in "abcde"])}, "local{k} & authority{k}", 5)
case("unreferenced_private_function", fn("_f{k}()", *["x = 1"] * 8), fn("_f{k}()", *["x = 1"] * 8) + "_f{k}()\n", "_f{k}")
case("orchestration_hub", fn("hub{k}(x)", *["if x:\n    go(x)"] * 75), fn("hub{k}(x)", *["if x:\n    go(x)"] * 40), "hub{k}")
case("branch_cluster", fn("cluster{k}(x)", *["if x:\n    go(x)"] * 40), fn("cluster{k}(x)", *["if x:\n    go(x)"] * 20), "cluster{k}")
case("private_cohort", "".join(fn(f"_red{{k}}_blue{{k}}_{x}()") for x in ("one", "two", "three", "four")) + "\n" * 600, "".join(fn(f"_red{{k}}_blue{{k}}_{x}()") for x in ("one", "two", "three", "four")), "{p} | blue{k}_red{k}", 4)
case("lifecycle_stage_sequence", "".join(fn(f"{n}{{k}}()", *[f"s{i}{{k}}()" for i in range(6)]) for n in "abcd"), "".join(fn(f"{n}{{k}}()", *[f"s{i}{{k}}()" for i in range(6)]) for n in "ab"), ">".join(f"s{i}{{k}}" for i in range(6)), 4)
case("result_assembly", *twice(*[fn(f"{n}{{k}}()", f"{n}1{{k}}()", "p{k}()", "q{k}()", "r{k}()") for n in "ab"]), "{p} | p{k}>q{k}>r{k}", 2)

# dispatch, cases and tables
case("string_dispatch", fn("f{k}(kind)", "if kind == 'a':\n    return 1", "elif kind == 'b':\n    return 2"), fn("f{k}(kind)", "if kind == 'a':\n    return 1"), "f{k}.kind")
case("numeric_dispatch", fn("f{k}(kind)", "if kind == 1:\n    return 1", "elif kind == 2:\n    return 2"), fn("f{k}(kind)", "if kind == 1:\n    return 1"), "f{k}.kind")
case("repeated_strategy_dispatch", *twice(*[fn(f"{n}{{k}}(x)", "if x == 'a{k}':\n    return 1", "elif x == 'b{k}':\n    return 2") for n in "fg"]), "string | a{k},b{k}", 2)
case("bridge_axis_dispatch", *twice(*[fn(f"{n}{{k}}(kind)", "if kind == 'a':\n    return 1", "elif kind == 'b':\n    return 2") for n in "fg"]), "{p} | kind | a,b", 2)
case("role_case_tables", *twice(*[fn(f"{n}_kind{{k}}(x)", "if x == 'a':\n    return 1", "if x == 'b':\n    return 2") for n in ("one", "two")]), "kind{k}", 2)
case("local_role_cases", fn("f{k}(x)", "if x == 'a':\n    return 1", "if x == 'b':\n    return 2"), fn("f{k}(x)", "if x == 'a':\n    return 1"), "f{k}")
case("residual_closed_axis", fn("f{k}(x)", "if x == Axis.B:\n    return 1", "return TABLE[x]"), fn("f{k}(x)", "if x == Axis.B:\n    return 1", "return TABLE[1]"), "f{k}")
case("enum_subset_guard", fn("f{k}(x)", "return x in (Axis.A, Axis.B)"), fn("f{k}(x)", "return x in (Axis.A, Other.B)"), "f{k}")
case("enum_strategy_ladder", fn("f{k}(x)", "if x == Axis.A:\n    return 1", "if x is Axis.B:\n    return 2"), fn("f{k}(x)", "if x == Axis.A:\n    return 1"), "f{k}")
case("split_dispatch", fn("gen{k}(x)", above="@singledispatch\n") + fn("f{k}(x, y)", "Plan.for_key(y)", "return gen{k}(x)"), fn("gen{k}(x)") + fn("f{k}(x, y)", "Plan.for_key(y)", "return gen{k}(x)"), "f{k}")
case("closed_constant_selector", fn("f{k}(x)", "if x:\n    return ONE", "return TWO"), fn("f{k}(x)", "if x:\n    return ONE", "return 2"), "f{k}")
case("fragmented_tables", "ONE{k} = {Axis{k}.A: 1, Axis{k}.B: 2}\nTWO{k} = {Axis{k}.A: 3, Axis{k}.B: 4}\n", "ONE{k} = {Axis{k}.A: 1, Axis{k}.B: 2}\nTWO{k} = {Axis{k}.A: 3, Axis{k}.C: 4}\n", "ONE{k} & TWO{k}", 2)
case("callable_axis_registry", "OPS{k} = {Axis.A: run_a, Axis.B: run_b}\n", "OPS{k} = {Axis.A: 1, Axis.B: 2}\n", "OPS{k}")
case("enum_constructor_table", "OPS{k} = {Axis.A: Make(1), Axis.B: Make(2)}\n", "OPS{k} = {Axis.A: 1, Axis.B: 2}\n", "OPS{k}")
keyed = lambda base, *cases: "".join(cls(f"{base}{c.title()}{{k}}", f"key = Axis{{k}}.{c}", bases=f"{base}{{k}}") for c in cases)
case("closed_axis_branching", keyed("Base", "A", "B") + fn("f{k}(x)", "if x == Axis{k}.A:\n    return 1", "if x == Axis{k}.B:\n    return 2"), keyed("Base", "A", "B") + fn("f{k}(x)", "if x == Axis{k}.A:\n    return 1", "if x == Axis{k}.C:\n    return 2"), "f{k}")
case("parallel_keyed_families", keyed("Base", "A", "B") + keyed("Other", "A", "B"), keyed("Base", "A", "B") + keyed("Other", "A", "C"), "Base{k} & Other{k}", 2)
case("cross_module_families", {"m{k}a.py": keyed("Base", "A", "B"), "m{k}b.py": keyed("Other", "A", "B")}, {"m{k}a.py": keyed("Base", "A", "B"), "m{k}b.py": keyed("Other", "A", "C")}, "Base{k} & Other{k}", 2)
case("keyed_table_and_family", {"m{k}a.py": "TABLE{k} = {Axis{k}.A: 1, Axis{k}.B: 2}\n", "m{k}b.py": keyed("Base", "A", "B")}, {"m{k}a.py": "TABLE{k} = {Axis{k}.A: 1}\n", "m{k}b.py": keyed("Base", "A", "B")}, "TABLE{k} & Base{k}", 2)
case("table_shadows_classes", keyed("Base", "A", "B") + "TABLE{k} = {Axis{k}.A: BaseA{k}, Axis{k}.B: BaseB{k}}\n", keyed("Base", "A", "B") + "TABLE{k} = {Axis{k}.A: 1, Axis{k}.B: 2}\n", "TABLE{k} & Base{k}", 2)
case("enum_metadata_table", cls("Kind{k}", "A = 1", prop("label", "TABLE[self]"), bases="Enum"), cls("Kind{k}", "A = 1", prop("label", "TABLE[1]"), bases="Enum"), "Kind{k}")
case("derived_wrapper_specs", "ONE{k} = Spec{k}(a=1)\nTWO{k} = Spec{k}(a=2)\nWA{k} = Wrap{k}(of=ONE{k})\nWB{k} = Wrap{k}(of=TWO{k})\n", "ONE{k} = Spec{k}(a=1)\nTWO{k} = Spec{k}(a=2)\nWA{k} = Wrap{k}(of=ONE{k})\n", "{p} | Wrap{k}", 2)
case("cross_module_specs", {"m{k}a.py": "X{k} = Spec{k}(a={k}, b=2)\nY{k} = Spec{k}(a={k}, b=5)\n", "m{k}b.py": "X{k} = Plan{k}(a={k}, b=2)\nY{k} = Plan{k}(a={k}, b=5)\n"}, {"m{k}a.py": "X{k} = Spec{k}(a={k}, b=2)\nY{k} = Spec{k}(a={k}, b=5)\n", "m{k}b.py": "X{k} = Plan{k}(a={k}, b=2)\nY{k} = Plan{k}(a={k}, b=6)\n"}, "Spec{k} & Plan{k}", 2)
case("constructor_policy_rows", "".join(f"{x}{{k}} = Row{{k}}(x=1, y=2)\n" for x in "ABC"), "".join(f"{x}{{k}} = Row{{k}}(x=1, y=2)\n" for x in "AB"), "{p} | Row{k} | x,y", 3)
case("uppercase_globals", "CACHE{k} = {}\n", "cache{k} = {}\n", "{p}")
case("module_alias_catalog", "a{k} = Auth{k}.a\nb{k} = Auth{k}.b\n", "a{k} = Auth{k}.a\n", "{p} | Auth{k}", 2)
case("metadata_only_family", *twice(cls("OldRow{k}", "a = 1"), cls("NewRow{k}", "a = 2")), "{p} | Row{k}", 2)
case("registered_union", fn("f{k}()", "return [*One.all(), *Two.all()]"), fn("f{k}()", "return [*One.all(), *Two.any()]"), "f{k}")
case("conversion_matrix", "".join(fn(f"{a}_to_{b}(x)") for a in "ad" for b in "bc"), "".join(fn(f"{a}_to_{b}(x)") for a, b in ("ab", "ac", "db")), "{p}", 4)
case("parallel_keyed_tables", {"m{k}a.py": "T{k} = (Alpha{k}, Beta{k})\n", "m{k}b.py": "U{k} = (Alpha{k}, Beta{k})\n"}, {"m{k}a.py": "T{k} = (Alpha{k}, Beta{k})\n", "m{k}b.py": "U{k} = (Alpha{k}, Gamma{k})\n"}, "{d}/m{k}a.py:1:T{k} & {d}/m{k}b.py:1:U{k}", 2)

# families of classes
leaves = "class Base{k}:\n    pass\nclass Alpha{k}(Base{k}):\n    pass\nclass Beta{k}(Base{k}):\n    pass\n"
case("semantic_mirror", leaves + "NAMES{k} = (Alpha{k}, Beta{k})\n", leaves + "NAMES{k} = (Alpha{k}, Gamma{k})\n", "{p}:7:NAMES{k} ~ {m}.Base{k}", 2)
case("manual_family_roster", leaves + "NAMES{k} = (Alpha{k}, Beta{k})\n", leaves + "NAMES{k} = (Alpha{k}, Gamma{k})\n", "NAMES{k} < {m}.Base{k}", 2)
case("derived_exports", leaves + "NAMES{k} = ['Alpha{k}', 'Beta{k}']\n", leaves + "NAMES{k} = ['Alpha{k}', 'other']\n", "NAMES{k} < Base{k}", 2)
case("derived_index", leaves + "INDEX{k} = {'a': Alpha{k}, 'b': Beta{k}}\n", leaves + "INDEX{k} = {'a': Alpha{k}, 'b': Other{k}}\n", "INDEX{k} < Base{k}", 2)
case("classvar_only_leaves", "".join(cls(f"{n}{{k}}", "a = 1", bases="Root{k}") for n in "ABC"), "".join(cls(f"{n}{{k}}", "a = 1", bases="Root{k}") for n in "AB"), "Root{k}", 3)
case("type_indexed_definitions", *twice(*[cls(f"{n}{{k}}", "a = 1", "b = 2", bases="Root{k}") for n in "AB"]), "{p} | Root{k} | a,b", 2)
case("auto_register_misuse", cls("X{k}", "a = 1", bases="metaclass=AutoRegisterMeta"), cls("X{k}", method("go(self)"), bases="metaclass=AutoRegisterMeta"), "X{k}")
case("empty_leaf_product", "".join(cls(f"{a}{b}{{k}}", bases=f"L{a}{{k}}, R{b}{{k}}") for a in "ab" for b in "cd"), "".join(cls(f"{a}{b}{{k}}", bases=f"L{a}{{k}}, R{b}{{k}}") for a, b in ("ac", "ad", "bc")), "Rc{k},Rd{k}", 4)
case("repeated_base_bundle", *twice(*[cls(f"{n}{{k}}", bases="L{k}, R{k}") for n in "AB"]), "L{k},R{k}", 2)
case("repeated_registry_config", cls("Root{k}", "__registry_key__ = 'x'") + cls("Kid{k}", "__registry_key__ = 'x'", bases="Root{k}"), cls("Root{k}", "__registry_key__ = 'x'") + cls("Kid{k}", "__registry_key__ = 'y'", bases="Root{k}"), "Kid{k}.__registry_key__")
case("explicit_priorities", *twice(cls("A{k}", "priority = 1", bases="Base{k}"), cls("B{k}", "priority = 2", bases="Base{k}")), "Base{k} | priority", 2)
shell = cls("Shell{k}", method("go(self)", "return Target(self.mode{k})")) + cls("A{k}", "mode{k} = 1", bases="Shell{k}")
case("transport_shell", shell + cls("B{k}", "mode{k} = 2", bases="Shell{k}"), shell, "Shell{k}.go")
mixin = cls("T{k}Mixin", method("go(self)", "me = cast(Host, self)", "return me.x")) + cls("A{k}", bases="T{k}Mixin")
case("self_cast_mixin", mixin + cls("B{k}", bases="T{k}Mixin"), mixin, "T{k}Mixin.go")
twin = (method("m(self)"), method("n(self)"))
case("structural_confusability", cls("A{k}", *twin) + cls("B{k}", *twin) + fn("f{k}(p)", "p.m()", "p.n()"), cls("A{k}", *twin, bases="Base{k}") + cls("B{k}", *twin, bases="Base{k}") + fn("f{k}(p)", "p.m()", "p.n()"), "f{k}.p")
case("repeated_declarations", cls("A{k}", "x{k} = 1", "y{k} = 2") + cls("B{k}", "x{k} = 1", "y{k} = 2"), cls("A{k}", "x{k} = 1", "y{k} = 2") + cls("B{k}", "x{k} = 1", "y{k} = 2", bases="A{k}"), "{m}.A{k} & {m}.B{k}", 2)
case("repeated_type_cases", *twice(*[fn(f"{n}{{k}}(v)", "return isinstance(v, (A{k}, B{k}))") for n in "fg"]), "A{k},B{k}", 2)
case("protocol_contract", cls("P{k}", bases="Protocol"), cls("P{k}", bases="ABC"), "P{k}")
case("empty_authority_shell", cls("Empty{k}"), {"m{k}.py": cls("Empty{k}"), "u{k}.py": "use(Empty{k})\n"}, "Empty{k}")
case("single_consumer_matchers", {"m{k}.py": cls("My{k}Matcher", "a = 1"), "u{k}.py": "use(My{k}Matcher)\n"}, {"m{k}.py": cls("My{k}Matcher", "a = 1"), "u{k}.py": "use(My{k}Matcher)\n", "v{k}.py": "use(My{k}Matcher)\n"}, "My{k}Matcher")
case("metadata_only_detector", cls("My{k}Detector", "a = 1", bases="BaseDetector"), cls("My{k}Detector", "a = 1", method("go(self)"), bases="BaseDetector"), "My{k}Detector")
case("static_observation_detector", cls("Thing{k}", "observation_kind = 1", bases="StaticObservationDetector"), cls("Thing{k}", "other = 1", bases="StaticObservationDetector"), "Thing{k}")
case("derivable_ids", cls("My{k}ThingDetector", "detector_id = 'my{k}_thing'"), cls("My{k}ThingDetector", "detector_id = 'other'"), "My{k}ThingDetector.detector_id")
case("derivable_collectors", cls("My{k}ThingDetector", "candidate_collector = _my{k}_thing_candidates"), cls("My{k}ThingDetector", "candidate_collector = _other"), "My{k}ThingDetector.candidate_collector")
case("support_prelude_family", {f"m{{k}}{x}.py": "from support{k} import x\n" + cls(f"A{{k}}{x}") for x in "abc"}, {f"m{{k}}{x}.py": "from support{k} import x\n" + cls(f"A{{k}}{x}") for x in "ab"}, "{d} | support{k}", 3)

# registries
put = "REG{k}['a'] = Alpha{k}\nREG{k}['b'] = Beta{k}\n"
case("manual_registration", put, "REG{k}['a'] = Alpha{k}\n", "REG{k}", 2)
case("injective_type_registry", put, "REG{k}['a'] = Alpha{k}\nREG{k}['b'] = Alpha{k}\n", "{p}:REG{k}", 2)
case("non_injective_type_registry", "REG{k}['a'] = Alpha{k}\nREG{k}['b'] = Alpha{k}\n", put, "{p}:REG{k}", 2)
case("registry_projections", put + "NAMES{k} = ['a', 'b']\n", put + "NAMES{k} = ['a', 'c']\n", "NAMES{k}")
case("registry_policies", put + "NAMES{k} = ['a', 'b']\nMORE{k} = ['b', 'a']\n", put + "NAMES{k} = ['a', 'b']\n", "{p} | REG{k}", 2)
case("premature_registry", "REG{k}['a'] = Alpha{k}\n", put, "REG{k}")
case("parallel_registry_projection", fn("a{k}(x)", "return gather{k}(x, One.items())") + fn("b{k}(x)", "return gather{k}(x, Two.items())"), fn("a{k}(x)", "return gather{k}(x, One.items())") + fn("b{k}(x)", "return gather{k}(x, One.items())"), "{p} | gather{k}:items", 2)
case("type_lineage_map", "MAP{k} = {Alpha: Beta}\n", "MAP{k} = {Alpha: beta}\n", "MAP{k}")

# functions
case("environment_authority_drift", fn("read{k}()", "return os.getenv('E{k}')"), cls("MyEnvironment{k}", method("read(self)", "return os.getenv('E{k}')")), "read{k}.$E{k}")
case("pass_through_wrapper", fn("wrap{k}(a, b)", "return inner(a, b)"), fn("wrap{k}(a, b)", "return inner(b, a)"), "wrap{k}")
case("export_policy_predicate", *twice(*[fn(f"{n}{{k}}({p})", f"return issubclass({p}, Base{{k}}) and {p}.ok{{k}}") for n, p in (("f", "t"), ("g", "kind"))]), "_.ok{k},issubclass(_, Base{k})", 2)
case("subclass_traversal", *twice(*[fn(f"{n}{{k}}()", "return list(Root{k}.__subclasses__())") for n in "fg"]), "flat | Root{k}", 2)
case("runtime_adapter_shell", fn("build{k}(s)", "return Target(a=s.a, b=s.b, c=TABLE[s.c])"), fn("build{k}(s)", "return Target(a=s.a, b=s.b, c=s.c)"), "build{k}")
case("projection_builder", *twice(*[fn(f"{n}{{k}}(s)", "return Rec{k}(a=s.a, b=s.b, c=s.c)") for n in "fg"]), "{p} | Rec{k} | a,b,c", 2)
case("sibling_role_helpers", "".join(fn(f"read_{r}(x)", "open{k}(x)", "close{k}(x)") for r in ("left", "right")), fn("read_left(x)", "open{k}(x)", "close{k}(x)") + fn("read_right(x)", "open{k}(x)", "shut{k}(x)"), "{p} |  | read_* | close{k},open{k}", 2)
case("guard_validators", *twice(*[fn(f"{n}{{k}}(r)", "if not r.x{k}:\n    return False", "if not r.y{k}:\n    return False", "return True") for n in "fg"]), "{p} | x{k},y{k}", 2)
case("all_missing_axes", fn("f{k}(a, b, out)", "if not a and not b:\n    out.append('gone')"), fn("f{k}(a, b, out)", "if not a and b:\n    out.append('gone')"), "f{k}")
case("fail_soft_pipeline", fn("f{k}(a, b)", "if a is None:\n    return None", "if b is None:\n    return None", "return a"), fn("f{k}(a, b)", "if a is None:\n    return None", "return a"), "f{k}")
case("tree_matcher_payoff", fn("f{k}(n)", "isinstance(n, ast.A), isinstance(n, ast.B), isinstance(n, ast.C), isinstance(n, ast.D)"), fn("f{k}(n)", "isinstance(n, ast.A), isinstance(n, ast.B)"), "f{k}")
case("derived_counts", fn("f{k}(xs)", "make{k}(xs=xs, n=len(xs))"), fn("f{k}(xs)", "make{k}(xs=1, n=len(xs))"), "make{k}")
case("nested_builder_shell", fn("f{k}(a, b, c, d, e)", "return Outer(of=Inner(a=a, b=b, c=c, d=d), e=e)"), fn("f{k}(a, b, c, d, e)", "return Outer(of=Inner(a=a, b=b, c=c), e=e)"), "f{k}")
case("concrete_type_union", fn("f{k}(t: type[A] | type[B])"), fn("f{k}(t: type[A] | None)"), "f{k}.t")
case("linear_queries", *twice(*[fn(f"{n}{{k}}(v)", "for x in ITEMS{k}:\n    if x.id == v:\n        return x") for n in "fg"]), "{p} | ITEMS{k}", 2)
case("keyword_bag_adapter", fn("f{k}(r)", "return {'a': r.a, 'b': r.b, 'c': r.c}"), fn("f{k}(r)", "return {'a': r.a, 'b': r.b, 'c': 1}"), "f{k}")
case("named_function_collector", fn("f{k}(m)", "out = []", "for n in _iter_named_functions(m):\n    out.append(Hit(n))", "return tuple(out)"), fn("f{k}(m)", "out = []", "for n in walk(m):\n    out.append(Hit(n))", "return tuple(out)"), "f{k}")
case("stream_collector_boilerplate", fn("f{k}(m)", "out = []", "for n in walk(m):\n    out.append(Hit(n))", "return tuple(out)"), fn("f{k}(m)", "out = []", "for n in walk(m):\n    out.append(n)", "return tuple(out)"), "f{k}")
case("optional_keyword_bag", fn("f{k}(a=None)", "bag = {}", "if a is not None:\n    bag['a'] = a", "return go(**bag)"), fn("f{k}(a=None)", "bag = {}", "if a is not None:\n    bag['a'] = a", "return go(bag)"), "f{k}")
case("tuple_paths_in_calls", fn("f{k}(t)", "go(t[0][1], t[1][0])"), fn("f{k}(t)", "go(t[0][1], t[1])"), "f{k}")
case("bare_function_family", "".join(fn(f"{n}{{k}}(o: Owner{{k}})", "return o.x + o.y") for n in "fgh"), "".join(fn(f"{n}{{k}}(o: Owner{{k}})", "return o.x + o.y") for n in "fg"), "{p} | o:Owner{k} | x,y", 3)
case("latent_function_family", "".join(fn(f"{n}{{k}}(o)", "return o.x + o.y") for n in "fgh"), "".join(fn(f"{n}{{k}}(o)", "return o.x + o.y") for n in "fg"), "{p} | o: | x,y", 3)
case("capability_probes", *twice(*[fn(f"{n}{{k}}(x)", "return hasattr(x, 'shape') and hasattr(x, 'dtype')") for n in "fg"]), "{p} | dtype,shape", 2)
case("attribute_probes", fn("f(x)", "return hasattr(x, 'a') or getattr(x, 'b', None)"), fn("f(x)", "return hasattr(x, 'a')"), "{p}", 2)
case("optional_parameter_branch", fn("f(a{k}=None)", "if a{k} is None:\n    return 1"), fn("f(a{k}=None)", "if a{k}:\n    return 1"), "a{k}")
case("locals_call", fn("f{k}()", "return locals()"), fn("f{k}()", "return globals()"), "f{k}.locals")
case("reflective_builtin_calls", fn("f{k}(x)", "getattr(x, 'a')", "return hasattr(x, 'b')"), fn("f{k}(x)", "return hasattr(x, 'b')"), "{p} |  | f{k}", 2)
case("repeated_structural_annotation", "".join(fn(f"{n}(a: dict[str, Key{{k}}])") for n in "fgh"), "".join(fn(f"{n}(a: dict[str, Key{{k}}])") for n in "fg"), "dict[str, Key{k}]", 3)
case("public_support_functions", {"_m{k}.py": fn("helper{k}()"), "u{k}.py": "helper{k}()\n"}, {"_m{k}.py": fn("helper{k}()")}, "{d}/_m{k}.py")
case("config_attribute_reads", *twice(fn("f{k}()", "return config.a{k}"), fn("g{k}()", "return config.a{k}")), "a{k}", 2)

# calls, constants and layout
case("repeated_builder_call", "make{k}(a=1, b=2, c=3)\nmake{k}(a=4, b=5, c=6)\n", "make{k}(a=1, b=2, c=3)\nmake{k}(a=4, b=5, d=6)\n", "make{k} | a,b,c", 2)
case("repeated_export_dict", "x = {'a{k}': 1, 'b{k}': 2, 'c{k}': 3}\ny = {'a{k}': 4, 'b{k}': 5, 'c{k}': 6}\n", "x = {'a{k}': 1, 'b{k}': 2, 'c{k}': 3}\n", "a{k},b{k},c{k}", 2)
case("literal_schema_owners", *twice(*[fn(f"{n}{{k}}()", "return {'a{k}': 1, 'b{k}': 2}") for n in "fg"]), "a{k},b{k}", 2)
case("sentinel_type", "X{k} = object()\n", "X{k} = thing()\n", "X{k}")
case("runtime_type_generation", "T = type('N{k}', (), {})\n", "T = type(x)\n", "N{k}")
case("dynamic_method_injection", "setattr(Alpha{k}, 'x', f)\n", "setattr(alpha{k}, 'x', f)\n", "Alpha{k}")
case("repeated_regex_literal", "re.compile('ab{k}')\nre.match('ab{k}', x)\nre.search('ab{k}', y)\n".replace("ab{k}", "abcd{k}"), "re.compile('abcd{k}')\nre.match('abcd{k}', x)\n", "abcd{k}", 3)
case("repeated_string_literal", {"m{k}a.py": "f('word{k}')\nf('word{k}')\n", "m{k}b.py": "f('word{k}')\n"}, {"m{k}a.py": "f('word{k}')\nf('word{k}')\nf('word{k}')\n"}, "word{k}", 3)
case("mirrored_constant", {"m{k}a.py": "LIMIT{k} = 7\n", "m{k}b.py": "LIMIT{k} = 7\n"}, {"m{k}a.py": "LIMIT{k} = 7\n", "m{k}b.py": "LIMIT{k} = 8\n"}, "LIMIT{k} | 7", 2)
case("manual_public_api", "__all__ = ['a{k}']\n", "names = ['a{k}']\n", "__all__")
case("tag_tuples", "make(tags=(Tag{k}.A, Tag{k}.B))\nmake(tags=(Tag{k}.A, Tag{k}.B))\n", "make(tags=(Tag{k}.A, Tag{k}.B))\n", "{p} | tags | Tag{k}.A,Tag{k}.B", 2)
case("inline_renderers", "make{k}(a=lambda x: x, b=lambda x: x)\n", "make{k}(a=lambda x: x, b=1)\n", "make{k}")
case("spelled_spec_coordinates", "My{k}FindingSpec(a=x, b=y, c=z)\n", "My{k}FindingSpec(a=x, b=y)\n", "My{k}FindingSpec")
case("runtime_product_record", "R = product_record('Rec{k}', a=int)\n", "R = record('Rec{k}', a=int)\n", "Rec{k}")
case("blank_line_run", "x = 1\n\n\n\n\n\n\ny = 2\n", "x = 1\n\n\n\ny = 2\n", "{p}:2", 6)
case("packed_line", "a = 1; b = 2\n", "a = 1\nb = ';'\n", "{p}:1")
case("syntax_errors", "def f(:\n", "def f():\n    pass\n", "SyntaxError")

GROUP = 19
#: Modules that one task writes and parses.
TASK_MODULES = 20_000


def groups() -> dict[str, list[str]]:
    order = list(CASES)
    return {f"code_findings_{n // GROUP + 1:02}": order[n : n + GROUP] for n in range(0, len(order), GROUP)}


def tree(suppliers: DataFrame, cases: list[str]) -> DataFrame:
    """(path, source) of the cases' files, written for every supplier's key."""
    files = [F.struct(F.lit(f"{n}/{name}").alias("path"), F.lit(source).alias("source"), F.lit(even).alias("even")) for n in cases for even, own in ((True, CASES[n][0]), (False, CASES[n][1])) for name, source in own.items()]
    key = F.col("s_suppkey").cast("string")
    rows = suppliers.select(key.alias("k"), (F.col("s_suppkey") % 2 == 0).alias("_even"), F.explode(F.array(*files)).alias("f")).where("_even = f.even")
    return rows.select(F.replace("f.path", F.lit("{k}"), "k").alias("path"), F.replace("f.source", F.lit("{k}"), "k").alias("source"))


def found(suppliers: DataFrame, cases: list[str]) -> DataFrame:
    """What the cases' detectors find in their tree.

    The number of tasks is stated, since keys and sources are small on disk where parsing them takes long; a detector reads its own
    folder's files alone.
    """
    of_key = sum(len(files) for n in cases for files in CASES[n][:2]) / 2
    tasks = max(1, math.ceil(suppliers.count() * of_key / TASK_MODULES))
    folder = F.substring_index("path", "/", 1).alias("_case")
    rows = tree(suppliers.repartition(tasks, "s_suppkey"), cases)
    modules = settle(code.modules_from_rows(rows).select("*", folder), "planted-modules", by="_case")
    facts = settle(code.facts(code.modules_from_rows(rows)).select("*", folder), "planted-facts", by="_case")
    own = lambda df, n: df.where(F.col("_case") == n).drop("_case")
    every = reduce(DataFrame.unionByName, [of_detector(n, DETECTORS[n](own(facts, n), own(modules, n), LIMITS)) for n in cases])
    return every.groupBy("detector", "subject").agg(F.sum("n").alias("places"))


def expected_sql(cases: list[str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, {quoted(CASES[n][2])}, {CASES[n][3]})" for n in cases)
    return f"""SELECT detector, replace(subject, '{{k}}', s_suppkey::VARCHAR) AS subject, sum(places)::BIGINT AS places
FROM supplier, (VALUES {rows}) AS c(detector, subject, places) WHERE s_suppkey % 2 = 0
GROUP BY ALL"""


def register() -> None:
    """Queries of groups of cases; the places of findings with one subject add up."""
    for name, cases in groups().items():
        registry.CODE_QUERIES[name] = lambda spark, sf_dir, c=cases: found(spark.read.parquet(f"{sf_dir}/supplier.parquet"), c)
        registry.CODE_SQL[name] = expected_sql(cases)


register()
