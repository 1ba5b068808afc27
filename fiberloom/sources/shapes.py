"""Shapes of classes and functions that detectors look for: one predicate over a syntax tree for each family of facts.

A predicate takes a node in its scope and yields (name, value, items) or (name, value, items, numbers) rows; the
families are the names of the predicates.  ``collect`` walks a module once and asks every predicate of the node's kind.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

FUNCTIONS: list[tuple[str, Callable]] = []
CLASSES: list[tuple[str, Callable]] = []
MODULES: list[tuple[str, Callable]] = []


def of(kind: list):
    def put(f):
        kind.append((f.__name__, f))
        return f

    return put


def text(node: ast.AST | None) -> str:
    return ast.unparse(node) if node is not None else ""


def dotted(node: ast.AST | None) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def body(node: ast.AST) -> list[ast.stmt]:
    head = node.body[0] if node.body else None
    said = isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str)
    return node.body[1:] if said else node.body


#: Parts of an expression that nothing looks for.
SIGNS = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)


def children(node: ast.AST) -> list[ast.AST]:
    """The nodes right under one, in order, without operators and contexts; kept, as a parse looks through them many times."""
    found = node.__dict__.get("_children")
    if found is None:
        found = []
        for name in node._fields:
            value = getattr(node, name, None)
            if isinstance(value, list):
                found += [x for x in value if isinstance(x, ast.AST) and not isinstance(x, SIGNS)]
            elif isinstance(value, ast.AST) and not isinstance(value, SIGNS):
                found.append(value)
        node._children = found
    return found


def below(node: ast.AST) -> list[ast.AST]:
    """All nodes under one, in the order of ``ast.walk``."""
    found = list(children(node))
    for x in found:  # it grows meanwhile
        found += children(x)
    return found


def inside(node: ast.AST, *kinds: type) -> list:
    """The nodes under one that are of these very classes; a module, class or function, which many predicates ask, keeps them by class."""
    found = node.__dict__.get("_inside")
    if found is None:
        nodes = below(node)
        if not isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            return [x for x in nodes if type(x) in kinds]
        found = node._inside = {}
        for x in nodes:
            found.setdefault(type(x), []).append(x)
    met = [kind for kind in kinds if kind in found]
    if len(met) > 1:
        return [x for x in below(node) if type(x) in met]
    return found[met[0]] if met else []


def only_return(node: ast.AST) -> ast.expr | None:
    own = body(node)
    return own[0].value if len(own) == 1 and isinstance(own[0], ast.Return) else None


def params(node: ast.AST) -> list[str]:
    return [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]


def marks(node: ast.AST) -> set[str]:
    return {dotted(getattr(d, "func", d)).rpartition(".")[2] for d in node.decorator_list}


def member(node: ast.AST | None) -> tuple[str, str] | None:
    """(enum, case) of ``Name.CASE``."""
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id[:1].isupper() and node.attr.isupper():
        return node.value.id, node.attr
    return None


def is_upper(node: ast.AST | None) -> bool:
    return isinstance(node, ast.Name) and node.id.isupper()


def is_type(node: ast.AST | None) -> bool:
    """A name in capitals and lower case: taken for a class."""
    return isinstance(node, ast.Name) and node.id[:1].isupper() and not node.id.isupper()


def is_none(node: ast.AST | None) -> bool:
    return isinstance(node, ast.Constant) and node.value is None


def of_self(node: ast.AST | None) -> str:
    """x of ``self.x``."""
    return node.attr if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self" else ""


def methods(node: ast.ClassDef) -> list:
    return [x for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]


def returns(node: ast.AST) -> list[ast.expr]:
    return [r.value for r in inside(node, ast.Return) if r.value is not None]


def guards(node: ast.AST) -> list[ast.If]:
    """Statements of the body that only leave with nothing: ``if c: return None`` or ``return False``."""
    leaves = lambda s: len(s.body) == 1 and isinstance(s.body[0], ast.Return) and (s.body[0].value is None or isinstance(s.body[0].value, ast.Constant) and not s.body[0].value.value)
    return [s for s in body(node) if isinstance(s, ast.If) and not s.orelse and leaves(s)]


def keywords(call: ast.Call) -> dict[str, ast.expr]:
    return {k.arg: k.value for k in call.keywords if k.arg}


def type_call(node: ast.AST | None) -> str:
    return node.func.id if isinstance(node, ast.Call) and is_type(node.func) else ""


def called(node: ast.AST) -> list[str]:
    return [n for c in inside(node, ast.Call) if (n := dotted(c.func))]


def class_values(node: ast.ClassDef) -> dict[str, ast.expr]:
    out = {}
    for x in node.body:
        if isinstance(x, ast.Assign):
            out |= {t.id: x.value for t in x.targets if isinstance(t, ast.Name)}
        elif isinstance(x, ast.AnnAssign) and x.value is not None and isinstance(x.target, ast.Name):
            out[x.target.id] = x.value
    return out


def only_assigns(node: ast.ClassDef) -> bool:
    own = body(node)
    return bool(own) and all(isinstance(x, (ast.Assign, ast.AnnAssign)) for x in own)


def base_names(node: ast.ClassDef) -> list[str]:
    return [dotted(b) for b in node.bases if dotted(b)]


# functions


@of(FUNCTIONS)
def callees(f):
    """What a function calls."""
    names = sorted(set(called(f)))
    if names:
        yield f.name, "", names


@of(FUNCTIONS)
def capability(f):
    """Atoms of what a function does: calls, stores, and constructs."""
    atoms = {f"call:{n.rpartition('.')[2]}" for n in called(f)} | {f"store:{x.attr}" for x in inside(f, ast.Attribute) if isinstance(x.ctx, ast.Store)}
    atoms |= {f"construct:{c.func.id}" for c in inside(f, ast.Call) if is_type(c.func)}
    if len(atoms) >= 5:
        yield f.name, "", sorted(atoms)


@of(FUNCTIONS)
def subclass_walk(f):
    roots = [c.func.value for c in inside(f, ast.Call) if isinstance(c.func, ast.Attribute) and c.func.attr == "__subclasses__"]
    if roots:
        yield f.name, "recursive" if f.name in called(f) else "flat", sorted({text(r) for r in roots})


@of(FUNCTIONS)
def adapter_shell(f):
    """A record built from another one: some fields copied, some looked up in a table."""
    value = only_return(f)
    if type_call(value):
        copied = [k for k, v in keywords(value).items() if isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) and v.attr == k]
        looked = [k for k, v in keywords(value).items() if isinstance(v, ast.Subscript) and is_upper(v.value)]
        if len(copied) >= 2 and looked:
            yield f.name, type_call(value), copied + looked


@of(FUNCTIONS)
def assembly_loop(f):
    """A loop over a collector's candidates that appends what is built of each."""
    for loop in (s for s in body(f) if isinstance(s, ast.For)):
        if isinstance(loop.iter, ast.Call) and len(loop.body) == 1 and isinstance(loop.body[0], ast.Expr):
            call = loop.body[0].value
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "append" and call.args and isinstance(call.args[0], ast.Call):
                yield f.name, dotted(call.args[0].func), [dotted(loop.iter.func)]


@of(FUNCTIONS)
def projection_call(f):
    """Records built from attributes of one source, field by field."""
    for c in inside(f, ast.Call):
        words = keywords(c)
        sources = {dotted(v.value) for v in words.values() if isinstance(v, ast.Attribute)}
        if type_call(c) and len(words) >= 3 and len(sources) == 1 and all(isinstance(v, ast.Attribute) for v in words.values()):
            yield type_call(c), f.name, sorted(words)


@of(FUNCTIONS)
def guarded_delegate(f):
    own = body(f)
    if len(own) == 2 and guards(f) and isinstance(own[1], ast.Return) and isinstance(own[1].value, ast.Call):
        yield f.name, dotted(own[1].value.func), [text(own[0].test)]


@of(FUNCTIONS)
def projection_property(f):
    value = only_return(f)
    if "property" in marks(f) and type_call(value) and value.keywords:
        yield f.name, type_call(value), sorted(keywords(value))


@of(FUNCTIONS)
def residual_axis(f):
    """A table indexed by what the function also compares with cases of an enum."""
    tables = {(text(s.slice), s.value.id) for s in inside(f, ast.Subscript) if is_upper(s.value)}
    for c in inside(f, ast.Compare):
        case = member(c.comparators[0])
        for axis, table in sorted(tables):
            if case and axis == text(c.left):
                yield f.name, table, [".".join(case)]


@of(FUNCTIONS)
def enum_subset(f):
    for c in inside(f, ast.Compare):
        if isinstance(c.ops[0], (ast.In, ast.NotIn)) and isinstance(c.comparators[0], (ast.Tuple, ast.Set, ast.List)):
            cases = [member(e) for e in c.comparators[0].elts]
            if len(cases) >= 2 and all(cases) and len({e for e, _ in cases}) == 1:
                yield f.name, text(c.left), sorted(k for _, k in cases)


@of(FUNCTIONS)
def enum_branch(f):
    """Comparisons of one expression with cases of one enum."""
    found: dict[tuple[str, str], set[str]] = {}
    for c in inside(f, ast.Compare):
        if isinstance(c.ops[0], (ast.Eq, ast.Is)) and (case := member(c.comparators[0])):
            found.setdefault((text(c.left), case[0]), set()).add(case[1])
    for m in inside(f, ast.Match):
        for k in m.cases:
            if isinstance(k.pattern, ast.MatchValue) and (case := member(k.pattern.value)):
                found.setdefault((text(m.subject), case[0]), set()).add(case[1])
    for (axis, enum), cases in sorted(found.items()):
        yield f.name, enum, sorted(cases), {"selector": not axis.startswith("self.")}


@of(FUNCTIONS)
def strategy_selector(f):
    """Functions that both select a strategy by ``Type.for_...(x)`` and call something generic."""
    picks = [c for c in inside(f, ast.Call) if isinstance(c.func, ast.Attribute) and is_type(c.func.value) and c.func.attr.startswith(("for_", "select", "from_key"))]
    if picks:
        yield f.name, dotted(picks[0].func), sorted({n for n in called(f) if "." not in n})


@of(FUNCTIONS)
def generic_function(f):
    if "singledispatch" in marks(f):
        yield f.name, "", []


@of(FUNCTIONS)
def constant_selector(f):
    values = returns(f)
    names = {v.id for v in values if is_upper(v)}
    if len(names) >= 2 and len(values) == sum(is_upper(v) for v in values) and inside(f, ast.If, ast.IfExp, ast.Match):
        yield f.name, "", sorted(names)


@of(FUNCTIONS)
def registry_projection(f):
    """``collector(x, Base.accessor())`` as the whole of a function."""
    value = only_return(f)
    last = value.args[-1] if isinstance(value, ast.Call) and value.args else None
    if isinstance(last, ast.Call) and isinstance(last.func, ast.Attribute) and is_type(last.func.value):
        yield f.name, f"{dotted(value.func)}:{last.func.attr}", [last.func.value.id]


@of(FUNCTIONS)
def attribute_guards(f):
    """Validators that leave with False unless attributes of one parameter hold."""
    asked = [g.test.operand for g in guards(f) if isinstance(g.test, ast.UnaryOp) and isinstance(g.test.op, ast.Not)]
    names = [a.attr for a in asked if isinstance(a, ast.Attribute) and isinstance(a.value, ast.Name) and a.value.id in params(f)]
    if len(names) >= 2:
        yield f.name, "", sorted(names)


@of(FUNCTIONS)
def all_missing(f):
    """``if not a and not b: out.append(x)``."""
    absent = lambda v: isinstance(v, ast.UnaryOp) and isinstance(v.op, ast.Not) or isinstance(v, ast.Compare) and isinstance(v.ops[0], ast.Is) and is_none(v.comparators[0])
    for s in inside(f, ast.If):
        if isinstance(s.test, ast.BoolOp) and isinstance(s.test.op, ast.And) and all(map(absent, s.test.values)) and any(isinstance(c.func, ast.Attribute) and c.func.attr == "append" for c in inside(s, ast.Call)):
            yield f.name, "", [text(v.operand if isinstance(v, ast.UnaryOp) else v.left) for v in s.test.values]


@of(FUNCTIONS)
def shape_guards(f):
    """Checks of shape or number of dimensions that raise."""
    if f.name == "validate":
        tests = [s.test for s in body(f) if isinstance(s, ast.If) and len(s.body) == 1 and isinstance(s.body[0], ast.Raise)]
        forms = sorted({text(t) for t in tests if any(a.attr in ("shape", "ndim") for a in inside(t, ast.Attribute))})
        if len(forms) >= 2:
            yield f.name, "", forms


@of(FUNCTIONS)
def stage_tail(f):
    """Names of the calls that the statements of a body make, in order."""
    names = []
    for s in body(f):
        value = getattr(s, "value", None)
        names.append(dotted(value.func).rpartition(".")[2] if isinstance(value, ast.Call) else "")
    if len(names) >= 4 and all(names[-3:]):
        yield f.name, ">".join(names[-3:]), names


@of(FUNCTIONS)
def fail_soft(f):
    tests = [g.test for g in guards(f) if g.body[0].value is None or is_none(g.body[0].value)]
    threaded = [t.left for t in tests if isinstance(t, ast.Compare) and isinstance(t.ops[0], ast.Is) and is_none(t.comparators[0])]
    if len(threaded) >= 2:
        yield f.name, "", [text(t) for t in threaded], {"guards": len(threaded)}


@of(FUNCTIONS)
def tree_matcher(f):
    """Optional exits, guards on kinds of syntax nodes, and checks of a length; the score is their weighted number."""
    exits = sum(r.value is None or is_none(r.value) for r in inside(f, ast.Return))
    kinds = [text(c.args[1]) for c in inside(f, ast.Call) if dotted(c.func) == "isinstance" and len(c.args) == 2 and "ast." in text(c.args[1])]
    lengths = sum(any(dotted(x.func) == "len" for x in inside(c, ast.Call)) for c in inside(f, ast.Compare))
    if kinds:
        yield f.name, "", sorted(set(kinds)), {"score": exits + 2 * len(kinds) + lengths, "exits": exits, "looped": bool(inside(f, ast.For, ast.While)), "kinds": len(kinds)}


@of(FUNCTIONS)
def finding_builder(f):
    value = only_return(f)
    name = dotted(value.func) if isinstance(value, ast.Call) else ""
    if name.rpartition(".")[2] == "build_finding":
        yield f.name, "direct", sorted(keywords(value))
    for c in inside(f, ast.Call):
        if dotted(c.func) == "self.finding_spec.build" and c.args and of_self(c.args[0]) == "detector_id":
            yield f.name, "spec", []


@of(FUNCTIONS)
def counted_keywords(f):
    """``x_count=len(xs)`` beside ``xs=xs`` in one call."""
    for c in inside(f, ast.Call):
        words = keywords(c)
        sized = {k: text(v.args[0]) for k, v in words.items() if isinstance(v, ast.Call) and dotted(v.func) == "len" and v.args}
        given = {text(v) for v in words.values()}
        derived = sorted(k for k, of in sized.items() if of in given)
        if derived:
            yield dotted(c.func), f.name, derived


@of(FUNCTIONS)
def nested_builder(f):
    """A request built around another one that gets most of the parameters as they came."""
    value = only_return(f)
    if type_call(value):
        for k, v in keywords(value).items():
            same = [n for n, x in keywords(v).items() if isinstance(x, ast.Name) and x.id in params(f)] if type_call(v) else []
            if same and len(value.keywords) >= 2:
                yield f.name, f"{type_call(value)}.{k}:{type_call(v)}", same


@of(FUNCTIONS)
def observed_methods(f):
    """Parameters that are only used by calling their methods."""
    for p in params(f):
        if p in ("self", "cls"):
            continue
        uses = [x for x in inside(f, ast.Name) if x.id == p]
        through = [c.func.attr for c in inside(f, ast.Call) if isinstance(c.func, ast.Attribute) and isinstance(c.func.value, ast.Name) and c.func.value.id == p]
        if len(set(through)) >= 2 and len(uses) == len(through):
            yield f.name, p, sorted(set(through))


@of(FUNCTIONS)
def type_union(f):
    """Parameters that take one of several classes themselves."""
    for a in (*f.args.args, *f.args.kwonlyargs):
        parts = []
        todo = [a.annotation]
        while todo:
            x = todo.pop()
            if isinstance(x, ast.BinOp) and isinstance(x.op, ast.BitOr):
                todo += [x.left, x.right]
            elif isinstance(x, ast.Subscript) and dotted(x.value) in ("type", "Type"):
                parts.append(text(x.slice))
        if len(parts) >= 2:
            yield f"{f.name}.{a.arg}", "", sorted(parts)


@of(FUNCTIONS)
def constructor_return(f):
    value = only_return(f)
    if isinstance(value, ast.Call) and value.keywords and (dotted(value.func) == "cls" or is_type(value.func)):
        yield f.name, dotted(value.func), sorted(keywords(value)), {"classmethod": "classmethod" in marks(f)}


@of(FUNCTIONS)
def fold(f):
    """``acc = T()``, a loop that steps it, and ``return acc.result()``."""
    own = body(f)
    if len(own) == 3 and isinstance(own[0], ast.Assign) and type_call(own[0].value) and isinstance(own[1], ast.For) and isinstance(own[2], ast.Return) and isinstance(own[2].value, ast.Call):
        acc = text(own[0].targets[0])
        steps = [c.func.attr for c in inside(own[1], ast.Call) if isinstance(c.func, ast.Attribute) and text(c.func.value) == acc]
        if steps and text(own[2].value.func).startswith(acc + "."):
            yield f.name, type_call(own[0].value), steps


@of(FUNCTIONS)
def catalog_hook(f):
    if f.name == "__init_subclass__":
        names = [t.attr for s in inside(f, ast.Assign) for t in s.targets if isinstance(t, ast.Attribute) and dotted(t.value) == "cls"]
        if names:
            yield f.name, "", sorted(names)


@of(FUNCTIONS)
def regex_group(f):
    for v in returns(f):
        if isinstance(v, ast.Call) and isinstance(v.func, ast.Attribute) and v.func.attr == "group" and v.args and any(isinstance(c.func, ast.Attribute) and c.func.attr in ("match", "search", "fullmatch") for c in inside(f, ast.Call)):
            yield f.name, text(v.args[0]), []


@of(FUNCTIONS)
def dynamic_self(f):
    """Reflection on self with a selector that is no constant."""
    for c in inside(f, ast.Call):
        if dotted(c.func) in ("getattr", "setattr", "hasattr") and len(c.args) >= 2 and dotted(c.args[0]) == "self" and not isinstance(c.args[1], ast.Constant):
            yield f.name, dotted(c.func), [text(c.args[1])]


@of(FUNCTIONS)
def string_lookup(f):
    """Names found through a string that self holds: in globals, in a module, or in a table of types."""
    for s in inside(f, ast.Subscript):
        if isinstance(s.value, ast.Call) and dotted(s.value.func) in ("globals", "locals", "vars") and of_self(s.slice):
            yield f.name, "namespace", [of_self(s.slice)]
    for c in inside(f, ast.Call):
        if dotted(c.func) == "getattr" and len(c.args) >= 2 and dotted(c.args[0]) not in ("", "self") and of_self(c.args[1]):
            yield f.name, "getattr", [of_self(c.args[1])]


@of(FUNCTIONS)
def linear_query(f):
    """``for x in SOURCE: if x.key == k: return x``."""
    for loop in (s for s in body(f) if isinstance(s, ast.For)):
        for s in loop.body:
            if isinstance(s, ast.If) and isinstance(s.test, ast.Compare) and isinstance(s.test.left, ast.Attribute) and isinstance(s.test.ops[0], ast.Eq) and any(isinstance(x, ast.Return) for x in s.body):
                yield f.name, text(loop.iter), [s.test.left.attr]


@of(FUNCTIONS)
def kwargs_adapter(f):
    value = only_return(f)
    if isinstance(value, ast.Dict) and len(value.keys) >= 3 and all(isinstance(k, ast.Constant) for k in value.keys):
        sources = {dotted(v.value) if isinstance(v, ast.Attribute) else "" for v in value.values}
        if len(sources) == 1 and sources <= set(params(f)):
            yield f.name, *sources, [str(k.value) for k in value.keys]


@of(FUNCTIONS)
def private_delegate(f):
    value = only_return(f)
    name = dotted(value.func) if isinstance(value, ast.Call) else ""
    if name.rpartition(".")[2].startswith("_") and not f.name.startswith("_"):
        yield f.name, name, []


@of(FUNCTIONS)
def stream(f):
    """``tuple(... for x in self.things)`` and the like."""
    value = only_return(f)
    if isinstance(value, ast.Call) and dotted(value.func) in ("tuple", "list", "frozenset") and value.args and isinstance(value.args[0], ast.GeneratorExp):
        over = of_self(value.args[0].generators[0].iter)
        part = value.args[0].elt
        if over:
            yield f.name, over, [part.attr if isinstance(part, ast.Attribute) else ""], {"property": "property" in marks(f), "projects": isinstance(part, ast.Attribute)}


@of(FUNCTIONS)
def path_property(f):
    value = only_return(f)
    if "property" in marks(f):
        joined = isinstance(value, ast.BinOp) and isinstance(value.op, ast.Div) and of_self(value.left)
        made = isinstance(value, ast.Call) and dotted(value.func).rpartition(".")[2] == "Path" and value.args and of_self(value.args[0])
        if joined or made:
            yield f.name, of_self(value.left) if joined else of_self(value.args[0]), []


@of(FUNCTIONS)
def template_payload(f):
    value = only_return(f)
    said = value.value if isinstance(value, ast.Constant) and isinstance(value.value, str) else "".join(v.value for v in value.values if isinstance(v, ast.Constant)) if isinstance(value, ast.JoinedStr) else ""
    if said.count("\n") >= 2:
        yield f.name, "", [], {"lines": said.count("\n") + 1}


@of(FUNCTIONS)
def passes_to_collector(f):
    value = only_return(f)
    if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and "candidates" in value.func.id and value.args and all(isinstance(a, ast.Name) and a.id in params(f) for a in value.args):
        yield f.name, value.func.id, [a.id for a in value.args]


@of(FUNCTIONS)
def typed_cast(f):
    own = body(f)
    head = own[0].value if len(own) > 1 and isinstance(own[0], ast.Assign) else None
    if isinstance(head, ast.Call) and dotted(head.func).rpartition(".")[2] == "cast" and len(head.args) == 2 and isinstance(head.args[1], ast.Name) and head.args[1].id in params(f) and head.args[1].id != "self":
        yield f.name, text(head.args[0]), [head.args[1].id]


@of(FUNCTIONS)
def self_cast(f):
    """Attributes reached through a cast of self."""
    for s in inside(f, ast.Assign):
        v = s.value
        if isinstance(v, ast.Call) and dotted(v.func).rpartition(".")[2] == "cast" and len(v.args) == 2 and dotted(v.args[1]) == "self" and isinstance(s.targets[0], ast.Name):
            yield f.name, text(v.args[0]), sorted({a.attr for a in inside(f, ast.Attribute) if dotted(a.value) == s.targets[0].id})


@of(FUNCTIONS)
def stream_collector(f):
    """An accumulator filled from a walk and returned as a tuple."""
    for loop in (s for s in body(f) if isinstance(s, ast.For)):
        walked = dotted(loop.iter.func) if isinstance(loop.iter, ast.Call) else ""
        put = [c for c in inside(loop, ast.Call) if isinstance(c.func, ast.Attribute) and c.func.attr == "append" and c.args and type_call(c.args[0])]
        if walked and put and any(isinstance(v, ast.Call) and dotted(v.func) == "tuple" and v.args and text(v.args[0]) == text(put[0].func.value) for v in returns(f)):
            yield f.name, walked, sorted({type_call(c.args[0]) for c in put})


@of(FUNCTIONS)
def optional_bag(f):
    """A dictionary filled from optional parameters and unpacked into a call."""
    filled: dict[str, list[str]] = {}
    for s in inside(f, ast.If):
        if isinstance(s.test, ast.Compare) and isinstance(s.test.ops[0], ast.IsNot) and is_none(s.test.comparators[0]) and dotted(s.test.left) in params(f):
            for a in s.body:
                if isinstance(a, ast.Assign) and isinstance(a.targets[0], ast.Subscript) and text(a.value) == text(s.test.left):
                    filled.setdefault(text(a.targets[0].value), []).append(dotted(s.test.left))
    for c in inside(f, ast.Call):
        for k in c.keywords:
            if k.arg is None and text(k.value) in filled:
                yield f.name, dotted(c.func), filled[text(k.value)]


@of(FUNCTIONS)
def schema_accessor(f):
    value = only_return(f)
    if isinstance(value, ast.Call) and value.args and (case := member(value.args[0])) and dotted(value.func).startswith("self."):
        yield f.name, case[0], [case[1]]


@of(FUNCTIONS)
def field_projection(f):
    value = only_return(f)
    if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.args and of_self(value.args[0]) and not is_type(value.func):
        yield f.name, value.func.id, [of_self(value.args[0])]


@of(FUNCTIONS)
def tuple_paths(f):
    """Nested positions of a tuple as arguments of calls."""
    paths = [text(a) for c in inside(f, ast.Call) for a in c.args if isinstance(a, ast.Subscript) and isinstance(a.value, ast.Subscript) and isinstance(a.slice, ast.Constant) and isinstance(a.value.slice, ast.Constant)]
    if len(paths) >= 2:
        yield f.name, "", sorted(paths)


@of(FUNCTIONS)
def owner_reads(f):
    """Attributes that a function reads of its first parameter."""
    first = f.args.args[0] if f.args.args else None
    if first is not None and first.arg not in ("self", "cls"):
        read = sorted({a.attr for a in inside(f, ast.Attribute) if isinstance(a.value, ast.Name) and a.value.id == first.arg})
        if len(read) >= 2:
            yield f.name, f"{first.arg}:{text(first.annotation)}", read, {"typed": first.annotation is not None}


@of(FUNCTIONS)
def location_property(f):
    value = only_return(f)
    if "property" not in marks(f) or value is None:
        return
    made = [c for c in [value, *inside(value, ast.Call)] if isinstance(c, ast.Call) and type_call(c) == "SourceLocation"]
    if made and made[0] is value and len(value.args) == 3 and all(map(of_self, value.args)):
        yield f.name, "direct", [of_self(a) for a in value.args]
    zipped = [c for c in inside(value, ast.Call) if dotted(c.func) == "zip"]
    if made and zipped:
        yield f.name, "zipped", [of_self(a) for a in zipped[0].args]


@of(FUNCTIONS)
def probes(f):
    names = sorted({c.args[1].value for c in inside(f, ast.Call) if dotted(c.func) in ("hasattr", "getattr") and len(c.args) >= 2 and isinstance(c.args[1], ast.Constant)})
    if len(names) >= 2:
        yield f.name, "", names


@of(FUNCTIONS)
def selector_use(f):
    """Records built from a selector that the class family sets."""
    for c in inside(f, ast.Call):
        used = [n for a in (*c.args, *(k.value for k in c.keywords)) if (n := of_self(a))]
        if type_call(c) and used:
            yield f.name, type_call(c), sorted(used)


@of(FUNCTIONS)
def policy_predicate(f):
    """A conjunction of tests on one value that a function returns."""
    value = only_return(f)
    if isinstance(value, ast.BoolOp) and isinstance(value.op, ast.And) and len(value.values) >= 2:
        first = params(f)[0] if params(f) else ""
        roles = sorted(re.sub(rf"\b{first}\b", "_", text(v)) if first else text(v) for v in value.values)
        if any("issubclass" in r or "isinstance" in r for r in roles):
            yield f.name, "", roles


@of(FUNCTIONS)
def role_cases(f):
    """Strings that a function compares its parameters with, and the words of its own name."""
    said = sorted({c.comparators[0].value for c in inside(f, ast.Compare) if isinstance(c.comparators[0], ast.Constant) and isinstance(c.comparators[0].value, str) and isinstance(c.ops[0], ast.Eq)})
    if len(said) >= 2:
        yield f.name, f.name.strip("_").rpartition("_")[2], said


@of(FUNCTIONS)
def registry_call(f):
    """Calls of the same accessor on several roots, joined in one collection."""
    for x in inside(f, ast.List, ast.Tuple, ast.Set):
        parts = [e.value for e in x.elts if isinstance(e, ast.Starred) and isinstance(e.value, ast.Call) and isinstance(e.value.func, ast.Attribute) and is_type(e.value.func.value)]
        if len(parts) >= 2 and len({p.func.attr for p in parts}) == 1:
            yield f.name, parts[0].func.attr, sorted({p.func.value.id for p in parts})


# classes


@of(CLASSES)
def helper_class(c):
    """Classes with one method that only calls a helper."""
    if len(methods(c)) == 1 and isinstance(value := only_return(methods(c)[0]), ast.Call) and isinstance(value.func, ast.Name):
        yield c.name, ",".join(base_names(c)), [value.func.id]


@of(CLASSES)
def meta(c):
    """Classes with a metaclass named."""
    for k in c.keywords:
        if k.arg == "metaclass":
            yield c.name, dotted(k.value).rpartition(".")[2], base_names(c), {"methods": len(methods(c))}


@of(CLASSES)
def assigned(c):
    """Names that a class's body assigns, with their values."""
    values = class_values(c)
    if values:
        yield c.name, ",".join(base_names(c)), [f"{k}={text(v)}" for k, v in sorted(values.items())], {"only": only_assigns(c), "count": len(values)}


@of(CLASSES)
def keyed_class(c):
    """Classes that declare a case of an enum as their key."""
    for k, v in class_values(c).items():
        if case := member(v):
            yield c.name, case[0], [case[1]], {}
            yield f"{c.name}.{k}", ",".join(base_names(c)), [".".join(case)], {"keyed_by": 1}


@of(CLASSES)
def registry_class(c):
    """Classes that hold a registry, with the methods that look something up."""
    names = class_values(c)
    lookups = sorted(m.name for m in methods(c) if m.name.startswith(("get", "for_", "lookup", "resolve")))
    if any(k.strip("_") == "registry" for k in names) and lookups:
        yield c.name, "register" if any(m.name.startswith("register") for m in methods(c)) else "", lookups


@of(CLASSES)
def record_class(c):
    """Dataclasses: their fields with types, their defaults, and whether they are frozen."""
    made = [d for d in c.decorator_list if dotted(getattr(d, "func", d)).rpartition(".")[2] == "dataclass"]
    if made:
        fields = [x for x in c.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
        frozen = isinstance(made[0], ast.Call) and "frozen" in keywords(made[0])
        yield c.name, ",".join(base_names(c)), [f"{x.target.id}:{text(x.annotation)}={text(x.value)}" for x in fields], {"frozen": frozen, "methods": len(methods(c)), "defaults": sum(x.value is not None for x in fields)}


@of(CLASSES)
def record_mechanics(c):
    """Methods that dataclasses write by hand though their fields tell them."""
    own = sorted({m.name for m in methods(c)} & {"to_dict", "from_dict", "as_tuple", "merge", "replace", "copy", "equals"})
    if "dataclass" in marks(c) and len(own) >= 2:
        yield c.name, ",".join(base_names(c)), own


@of(CLASSES)
def self_naming(c):
    """``x = builder('x', ...)`` in a class's body."""
    for k, v in class_values(c).items():
        if isinstance(v, ast.Call) and v.args and isinstance(v.args[0], ast.Constant) and v.args[0].value == k:
            yield k, f"{c.name} {dotted(v.func)}", sorted(keywords(v))


@of(CLASSES)
def alias_class(c):
    """Classes that only give other names to functions, or only alias properties."""
    values = class_values(c)
    names = sorted(k for k, v in values.items() if isinstance(v, ast.Name) or isinstance(v, ast.Call) and dotted(v.func) == "staticmethod")
    if len(names) >= 2 and only_assigns(c) and len(names) == len(values):
        yield c.name, "catalog", names
    aliases = [m.name for m in methods(c) if "property" in marks(m) and of_self(only_return(m))]
    if aliases and len(aliases) == len(methods(c)):
        yield c.name, "properties", aliases


@of(CLASSES)
def visitor_stacks(c):
    """Visitors that keep stacks by hand."""
    if any(b.endswith(("NodeVisitor", "NodeTransformer")) for b in base_names(c)):
        stacks = sorted({of_self(t) for m in methods(c) if m.name == "__init__" for s in inside(m, ast.Assign, ast.AnnAssign) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if of_self(t) and isinstance(s.value, ast.List)})
        pushed = {of_self(x.func.value) for m in methods(c) for x in inside(m, ast.Call) if isinstance(x.func, ast.Attribute) and x.func.attr == "append"}
        if pushed & set(stacks):
            yield c.name, "", sorted(pushed & set(stacks))


@of(CLASSES)
def enum_table_property(c):
    """Properties of an enum that read a table by the member itself."""
    if any(b.endswith("Enum") for b in base_names(c)):
        cases = sum(k.isupper() for k in class_values(c))
        for m in methods(c):
            value = only_return(m)
            if "property" in marks(m) and isinstance(value, ast.Subscript) and is_upper(value.value) and dotted(value.slice) == "self":
                yield c.name, value.value.id, [m.name], {"cases": cases}


@of(CLASSES)
def fiber_tag(c):
    """A tag on self that methods branch on by strings, beside other fields."""
    tags: dict[str, set[str]] = {}
    for x in inside(c, ast.Compare):
        if of_self(x.left) and isinstance(x.ops[0], ast.Eq) and isinstance(x.comparators[0], ast.Constant) and isinstance(x.comparators[0].value, str):
            tags.setdefault(of_self(x.left), set()).add(x.comparators[0].value)
    stored = {of_self(t) for m in methods(c) if m.name == "__init__" for s in inside(m, ast.Assign) for t in s.targets if of_self(t)}
    for tag, cases in sorted(tags.items()):
        if len(cases) >= 2 and tag in stored and len(stored) >= 2:
            yield c.name, tag, sorted(cases)


@of(CLASSES)
def derived_views(c):
    """Fields derived from another one when the object is made, and mutators that renew the source alone."""
    derived: dict[str, list[str]] = {}
    for m in methods(c):
        if m.name == "__init__":
            sources = {of_self(t) for s in inside(m, ast.Assign) for t in s.targets if of_self(t) and isinstance(s.value, ast.Name)}
            for s in inside(m, ast.Assign):
                used = {of_self(a) for a in inside(s, ast.Attribute) if isinstance(a.ctx, ast.Load)} | {x.id for x in inside(s.value, ast.Name)}
                for t in s.targets:
                    for source in sorted(sources & used):
                        if of_self(t) and of_self(t) != source and not isinstance(s.value, ast.Name):
                            derived.setdefault(source, []).append(of_self(t))
    for m in methods(c):
        stored = {of_self(t) for s in inside(m, ast.Assign) for t in s.targets if of_self(t)}
        for source, views in sorted(derived.items()):
            if m.name != "__init__" and source in stored and not set(views) <= stored:
                yield c.name, f"{m.name}:{source}", sorted(views)


@of(CLASSES)
def namespace_class(c):
    """Dataclasses that take themselves out of a namespace, field by field."""
    for m in methods(c):
        if m.name == "from_namespace" and isinstance(value := only_return(m), ast.Call):
            same = sorted(k for k, v in keywords(value).items() if isinstance(v, ast.Attribute) and v.attr == k)
            if same:
                yield c.name, "", same


# modules


def tables(m: ast.Module) -> Iterator[tuple[str, ast.expr, ast.stmt]]:
    for s in m.body:
        if isinstance(s, ast.Assign):
            for t in s.targets:
                if isinstance(t, ast.Name):
                    yield t.id, s.value, s
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.value is not None:
            yield s.target.id, s.value, s


@of(MODULES)
def enum_table(m):
    """Tables keyed by cases of one enum, by the kind of their values."""
    for name, v, s in tables(m):
        if isinstance(v, ast.Dict) and v.keys:
            cases = [member(k) for k in v.keys]
            if all(cases) and len({e for e, _ in cases}) == 1:
                kinds = {"type" if is_type(x) else "constructor" if type_call(x) else "callable" if isinstance(x, (ast.Lambda, ast.Name)) or isinstance(x, ast.Attribute) and of_self(x) else "value" for x in v.values}
                yield name, cases[0][0], sorted(k for _, k in cases), {kinds.pop() if len(kinds) == 1 else "mixed": 1}, s


@of(MODULES)
def string_list(m):
    for name, v, s in tables(m):
        if isinstance(v, (ast.List, ast.Tuple, ast.Set)) and v.elts and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in v.elts):
            yield name, "", [e.value for e in v.elts], {}, s


@of(MODULES)
def mutable_global(m):
    for name, v, s in tables(m):
        empty = isinstance(v, (ast.Dict, ast.List, ast.Set)) and not (getattr(v, "keys", None) or getattr(v, "elts", None)) or isinstance(v, ast.Call) and dotted(v.func) in ("dict", "list", "set", "defaultdict", "OrderedDict")
        if name.isupper() and empty:
            yield name, text(v), [], {}, s


@of(MODULES)
def alias(m):
    for name, v, s in tables(m):
        if isinstance(v, (ast.Name, ast.Attribute)) and dotted(v):
            yield name, dotted(v), [], {"member": isinstance(v, ast.Attribute)}, s


@of(MODULES)
def spec_row(m):
    """Module constants built by a constructor from keywords."""
    for name, v, s in tables(m):
        if type_call(v) and v.keywords and not v.args:
            words = keywords(v)
            yield name, type_call(v), [f"{k}={text(x)}" for k, x in sorted(words.items())], {"links": sum(isinstance(x, ast.Name) and x.id.isupper() for x in words.values())}, s


@of(MODULES)
def call_constants(m):
    """Constants and tuples that calls get by keyword."""
    for c in inside(m, ast.Call):
        fixed = [f"{k}={text(v)}" for k, v in sorted(keywords(c).items()) if isinstance(v, ast.Constant)]
        if fixed and dotted(c.func):
            yield dotted(c.func), "constants", fixed, {}, c
        for k, v in keywords(c).items():
            if isinstance(v, ast.Tuple) and len(v.elts) >= 2 and all(member(e) or is_upper(e) for e in v.elts):
                yield k, "tags", [text(e) for e in v.elts], {}, c
        drawn = [k for k, v in keywords(c).items() if isinstance(v, ast.Lambda)]
        if len(drawn) >= 2:
            yield dotted(c.func), "renderers", sorted(drawn), {}, c
        if dotted(c.func).rpartition(".")[2] == "product_record" and c.args:
            yield text(c.args[0]).strip("'\""), "product", sorted(keywords(c)), {}, c
        if dotted(c.func).endswith("FindingSpec") and len(c.keywords) >= 3:
            yield dotted(c.func), "coordinates", sorted(keywords(c)), {}, c


@of(MODULES)
def keyed_rows(m):
    """Tables whose keys are strings, with the keys, and lists of rows that name something by their first argument."""
    for name, v, s in tables(m):
        if isinstance(v, ast.Dict) and v.keys and all(isinstance(k, ast.Constant) and isinstance(k.value, str) for k in v.keys):
            yield name, "table", sorted(k.value for k in v.keys), {}, s
        if isinstance(v, (ast.List, ast.Tuple)) and v.elts and all(isinstance(e, ast.Call) and e.args and isinstance(e.args[0], ast.Constant) for e in v.elts):
            yield name, "rows", sorted(str(e.args[0].value) for e in v.elts), {}, s


def collect(tree: ast.Module) -> list[tuple]:
    """(family, owner, func, name, line, end_line, value, items, numbers) of all predicates over one module."""
    rows = []

    def put(family: str, owner: tuple, funcs: tuple, node: ast.AST, made: tuple) -> None:
        name, value, items, *rest = made
        numbers = rest[0] if rest else {}
        at = rest[1] if len(rest) > 1 else node
        line = getattr(at, "lineno", 1)
        rows.append((family, ".".join(owner), ".".join(funcs), name, line, getattr(at, "end_lineno", None) or line, value, list(items), {k: int(v) for k, v in numbers.items()}))

    for family, f in MODULES:
        for made in f(tree):
            put(family, (), (), tree, made)
    todo: list[tuple[ast.AST, tuple, tuple]] = [(tree, (), ())]
    while todo:
        node, owner, funcs = todo.pop()
        for child in children(node):
            inner = owner, funcs
            if isinstance(child, ast.ClassDef):
                for family, f in CLASSES:
                    for made in f(child):
                        put(family, owner, funcs, child, made)
                inner = (*owner, child.name), funcs
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for family, f in FUNCTIONS:
                    for made in f(child):
                        put(family, owner, funcs, child, made)
                inner = owner, (*funcs, child.name)
            todo.append((child, *inner))
    return rows
