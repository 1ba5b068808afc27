"""Source trees as tables: modules, and the facts parsed out of them in one pass.

Parsing is the only work done in Python workers; everything on facts is declared with DataFrame operators.
A module that does not parse, or is too deep to be looked through, gives one fact of family ``syntax_error``.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberloom.functions.names import is_test_path
from fiberloom.sources import shapes

FACTS = "path string, module string, family string, owner string, func string, name string, line long, end_line long, value string, items array<string>, numbers map<string,long>"
#: A batch of facts ends with the module that brings it to so many rows, or to so many characters of source.
FACT_ROWS, FACT_CHARS = 4000, 4 << 20
#: Directories that a scan leaves out, beside hidden ones and package metadata.
IGNORED = ("__pycache__", "build", "dist", "node_modules", "venv", "site-packages")


def module_name(path: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.py$", ""), "/", "."), r"\.__init__$", "")


def modules(spark: SparkSession, roots: list[str], tests: bool = True) -> DataFrame:
    """(path, module, source, source_hash) of the .py files under the roots; of a path found twice the first root's counts."""
    parts = []
    for n, root in enumerate(roots):
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
        parts.append(files.select(F.col("value").alias("source"), F.expr("_metadata.file_path").alias("_full"), F.lit(n).alias("_root"), F.lit(root.rstrip("/") + "/").alias("_base")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    path = F.expr("substring(_full, instr(_full, _base) + length(_base))")
    kept = every.withColumn("path", path).where(~F.col("path").rlike(r"(^|/)(\.[^/]*|" + "|".join(IGNORED) + r"|[^/]*\.(egg-info|dist-info))/"))
    first = kept.groupBy("_full").agg(F.min_by(F.struct("path", "source"), "_root").alias("m")).select("m.*")
    return modules_from_rows(first if tests else first.where(~is_test_path(F.col("path"))))


def modules_from_rows(rows: DataFrame) -> DataFrame:
    """The same table from (path, source) rows."""
    return rows.select("path", module_name(F.col("path")).alias("module"), "source", F.sha2("source", 256).alias("source_hash"))


def dotted(node: ast.AST) -> str:
    """``a.b.c`` for names and attributes, subscripts by what they subscript; else empty."""
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else ""
    return node.id if isinstance(node, ast.Name) else ""


class Shape(ast.NodeTransformer):
    """Takes names and values out of a function, so that like bodies dump alike."""

    def visit_Name(self, node: ast.Name) -> ast.AST:
        return ast.Name(id="VAR", ctx=node.ctx)

    def visit_arg(self, node: ast.arg) -> ast.AST:
        return ast.arg(arg="ARG", annotation=None)

    def visit_Attribute(self, node: ast.Attribute) -> ast.AST:
        return ast.Attribute(value=self.visit(node.value), attr="ATTR", ctx=node.ctx)

    def visit_Constant(self, node: ast.Constant) -> ast.AST:
        return ast.Constant(value=type(node.value).__name__)


def body_of(node: ast.AST) -> list[ast.stmt]:
    """A body without its docstring."""
    body = node.body
    head = body[0] if body else None
    return body[1:] if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str) else body


class Odd(Exception):
    """A body whose text may not parse back to its own shape."""


def shape(node: ast.AST) -> tuple:
    """A syntax tree without what Shape takes out, as one value."""
    kind = type(node)
    if kind is ast.Name:
        return kind, type(node.ctx)
    if kind is ast.Attribute:
        return kind, shape(node.value), type(node.ctx)
    if kind is ast.arg:
        return (kind,)
    if kind is ast.Constant:
        if isinstance(node.value, int) and node.value.bit_length() > 1000:
            raise Odd
        return kind, type(node.value)
    if kind in ODD:
        raise Odd
    parts = [kind]
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, list):
            parts.append(tuple([shape(x) if isinstance(x, ast.AST) else (type(x), x) for x in value]))
        else:
            parts.append(shape(value) if isinstance(value, ast.AST) else (type(value), value))
    return tuple(parts)


#: Text with expressions in it is written in whatever quotes its values leave.
ODD = tuple(getattr(ast, name) for name in ("JoinedStr", "TemplateStr") if hasattr(ast, name))
#: Fingerprints of shapes met before in this process, and how many are kept.
KNOWN: dict[tuple, str] = {}
MOST_KNOWN = 20_000


def fingerprint(node: ast.AST) -> str:
    """The same for bodies that differ in names and values alone."""
    try:
        key = tuple([shape(s) for s in body_of(node)])
    except Odd:
        key = None
    found = KNOWN.get(key) if key else None
    if found is None:
        fresh = ast.parse(ast.unparse(ast.Module(body=body_of(node), type_ignores=[])))
        found = hashlib.md5(ast.dump(Shape().visit(fresh)).encode()).hexdigest()
        if key and len(KNOWN) < MOST_KNOWN:
            KNOWN[key] = found
    return found


def last_return(node: ast.AST) -> ast.expr | None:
    """What a function returns whose body is one return statement."""
    body = body_of(node)
    return body[0].value if len(body) == 1 and isinstance(body[0], ast.Return) else None


def is_passing_on(value: ast.expr | None, params: list[str]) -> bool:
    """Whether it is a call with all the parameters as they came, and nothing else."""
    if not isinstance(value, ast.Call):
        return False
    given = [*value.args, *(k.value for k in value.keywords)]
    return bool(given) and all(isinstance(a, ast.Name) for a in given) and [a.id for a in given] == [p for p in params if p not in ("self", "cls")]


BRANCHES = (ast.If, ast.For, ast.While, ast.Try, ast.IfExp, ast.Match, ast.AsyncFor)


#: The method of Facts for a class of nodes.
WAYS: dict[type, object] = {}


class Facts(ast.NodeVisitor):
    """Collects (family, owner, func, name, line, end_line, value, items, numbers)."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.classes: list[str] = []
        self.funcs: list[str] = []
        self.seen: set[str] = set()

    def visit(self, node: ast.AST) -> None:
        kind = type(node)
        if kind not in WAYS:
            WAYS[kind] = getattr(Facts, f"visit_{kind.__name__}", Facts.generic_visit)
        WAYS[kind](self, node)

    def generic_visit(self, node: ast.AST) -> None:
        for x in shapes.children(node):
            self.visit(x)

    def put(self, family: str, name: str, node: ast.AST, value: str = "", items: list[str] | None = None, **numbers: int) -> None:
        self.rows.append((family, ".".join(self.classes), ".".join(self.funcs), name, getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or getattr(node, "lineno", 1), value, items or [], {k: int(v) for k, v in numbers.items()}))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        methods = [x for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        bases = [dotted(b) for b in node.bases if dotted(b)]
        abstract = any("abstractmethod" in dotted(d) for m in methods for d in m.decorator_list)
        self.put("class", node.name, node, ",".join(dotted(getattr(d, "func", d)) for d in node.decorator_list), bases, methods=len(methods), abstract=abstract, assignments=sum(isinstance(x, ast.Assign) for x in node.body), members=len(body_of(node)), trivial=all(isinstance(x, (ast.Pass, ast.Expr)) for x in node.body))
        self.decorated(node)
        self.classes.append(node.name)
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                self.put("field", x.target.id, x, ast.unparse(x.annotation), init=0)
            elif isinstance(x, ast.Assign):
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        self.put("class_assignment", t.id, x, ast.unparse(x.value))
        self.generic_visit(node)
        self.classes.pop()

    def decorated(self, node: ast.AST) -> None:
        for d in node.decorator_list:
            name = dotted(getattr(d, "func", d))
            if "register" in name.lower():
                self.put("registration", name.rpartition(".")[0] or name, d, "decorator", [node.name])

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        inside = [x for s in node.body for x in (s, *shapes.below(s))]
        params = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        calls = [x for x in inside if isinstance(x, ast.Call)]
        stages = [dotted(c.func).rpartition(".")[2] for s in body_of(node) for c in [getattr(s, "value", None)] if isinstance(c, ast.Call) and dotted(c.func)]
        marks = {dotted(getattr(d, "func", d)).rpartition(".")[2] for d in node.decorator_list}
        value = last_return(node)
        what = {"property": "property" in marks, "classmethod": "classmethod" in marks, "constant": isinstance(value, ast.Constant), "alias": isinstance(value, ast.Attribute) and dotted(value).startswith("self."), "passing": is_passing_on(value, params)}
        defaults = dict(zip(reversed([a.arg for a in node.args.args]), reversed(node.args.defaults), strict=False))
        empty = {k for k, v in defaults.items() if isinstance(v, ast.Constant) and v.value is None}
        asked = {dotted(x.test.left) for x in inside if isinstance(x, ast.If) and isinstance(x.test, ast.Compare) and isinstance(x.test.ops[0], (ast.Is, ast.IsNot))}
        for name in sorted(empty & asked):
            self.put("optional_branch", name, node)
        for a in (*node.args.args, *node.args.kwonlyargs):
            if isinstance(a.annotation, ast.Subscript):
                self.put("annotation", ast.unparse(a.annotation), a)
        self.put("method" if self.classes and not self.funcs else "function", node.name, node, fingerprint(node), params, statements=len(body_of(node)), branches=sum(isinstance(x, BRANCHES) for x in inside), calls=len(calls), lines=(node.end_lineno or node.lineno) - node.lineno + 1, private=node.name.startswith("_") and not node.name.startswith("__"), abstract=any("abstractmethod" in dotted(d) for d in node.decorator_list), **what)
        if len(stages) >= 2:
            self.put("stages", node.name, node, ">".join(stages), stages)
        self.decorated(node)
        self.funcs.append(node.name)
        if node.name == "__init__" and self.classes:
            for x in inside:
                targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign) else []
                for t in targets:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                        self.put("field", t.attr, x, ast.unparse(x.annotation) if isinstance(x, ast.AnnAssign) else "", init=1)
        self.generic_visit(node)
        self.funcs.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.put("import", a.asname or a.name.split(".")[0], node, a.name if a.asname else a.name.split(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.put("import", a.asname or a.name, node, f"{'.' * node.level}{node.module or ''}.{a.name}".lstrip(".") if not node.level else f"{'.' * node.level}{node.module or ''}.{a.name}")

    def visit_Name(self, node: ast.Name) -> None:
        self.refer(node.id, node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.refer(node.attr, node)
        if dotted(node).startswith(("config.", "self.config.", "cfg.")):
            self.put("config_read", node.attr, node, dotted(node))
        self.generic_visit(node)

    def refer(self, name: str, node: ast.AST) -> None:
        if name not in self.seen:
            self.seen.add(name)
            self.put("reference", name, node)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str) and node.value.strip():
            self.put("string", node.value, node)

    def visit_Assign(self, node: ast.Assign) -> None:
        v = node.value
        for t in node.targets:
            if isinstance(t, ast.Subscript) and isinstance(v, ast.Name) and v.id[:1].isupper():
                self.put("registration", dotted(t.value), node, ast.unparse(t.slice), [v.id])
            if isinstance(t, ast.Name) and t.id == "__all__" and isinstance(v, (ast.List, ast.Tuple)):
                self.put("public_api", t.id, node, "", [e.value for e in v.elts if isinstance(e, ast.Constant)])
            if isinstance(t, ast.Name) and not self.funcs:
                if isinstance(v, (ast.Tuple, ast.List, ast.Set)) and v.elts and all(isinstance(e, ast.Name) for e in v.elts):
                    self.put("roster", t.id, node, "sequence", [e.id for e in v.elts])
                if isinstance(v, ast.Dict) and v.values and all(isinstance(e, ast.Name) for e in v.values):
                    self.put("roster", t.id, node, "mapping", [e.id for e in v.values])
                    for k, e in zip(v.keys, v.values, strict=True):
                        self.put("token", t.id, node, ast.literal_eval(k) if isinstance(k, ast.Constant) and isinstance(k.value, str) else dotted(k or e), ["DICT_KEY"])
                        self.put("token", t.id, node, e.id, ["DICT_VALUE"])
                if isinstance(v, ast.Dict) and v.keys and all(isinstance(e, ast.Name) and e.id[:1].isupper() for e in (*v.keys, *v.values)):
                    self.put("lineage_map", t.id, node, "", [f"{k.id}>{e.id}" for k, e in zip(v.keys, v.values, strict=True)])
                if isinstance(v, ast.Constant):
                    self.put("constant", t.id, node, repr(v.value))
                if isinstance(v, ast.Call) and (dotted(v.func) == "object" or isinstance(v.func, ast.Call) and dotted(v.func.func) == "type"):
                    self.put("sentinel", t.id, node)
        self.generic_visit(node)

    def visit_Dict(self, node: ast.Dict) -> None:
        keys = [k.value for k in node.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)]
        if keys and len(keys) == len(node.keys):
            self.put("export_dict", ",".join(sorted(keys)), node, "", sorted(keys))
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name = dotted(node.func)
        words = [a.value for a in node.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
        if name == "isinstance" and len(node.args) == 2:
            kinds = node.args[1].elts if isinstance(node.args[1], ast.Tuple) else [node.args[1]]
            self.put("isinstance", ast.unparse(node.args[0]), node, "", sorted(filter(None, map(dotted, kinds))))
        if name in ("getattr", "setattr", "hasattr", "delattr", "vars", "locals", "globals"):
            self.put("reflection", name, node, dotted(node.args[0]) if node.args else "")
        same = [k.arg for k in node.keywords if k.arg and isinstance(k.value, ast.Name) and k.value.id == k.arg]
        if len(same) >= 3 and len(same) == len(node.keywords) and not node.args:
            self.put("identity_forward", name, node, ",".join(same), same)
        if name in ("hasattr", "getattr") and words:
            self.put("probe", words[0], node, name)
        if name == "setattr" and node.args and (dotted(node.args[0])[:1].isupper() or dotted(node.args[0]) == "cls"):
            self.put("injection", dotted(node.args[0]), node, words[0] if words else "")
        if name == "type" and len(node.args) == 3:
            self.put("runtime_type", words[0] if words else "", node)
        if name in ("os.getenv", "os.environ.get", "environ.get", "getenv") and words:
            self.put("env_read", words[0], node, name)
        if name.startswith("re.") and words:
            self.put("regex", words[0], node, name)
        if name.rpartition(".")[2] in ("register", "register_class") and node.args and dotted(node.args[-1])[:1].isupper():
            self.put("registration", name.rpartition(".")[0], node, "call", [dotted(node.args[-1])])
        keywords = sorted(k.arg for k in node.keywords if k.arg)
        if name and len(keywords) >= 2:
            self.put("builder_call", name, node, ",".join(keywords), keywords)
        if name:
            self.put("call", name, node)
        for k in node.keywords:
            if k.arg and isinstance(k.value, (ast.Name, ast.Attribute)):
                self.put("forwarded", k.arg, node, dotted(k.value))
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if dotted(node.value) in ("os.environ", "environ") and isinstance(node.slice, ast.Constant):
            self.put("env_read", str(node.slice.value), node, "os.environ[]")
        self.generic_visit(node)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.type is not None and "AttributeError" in ast.unparse(node.type):
            self.put("probe", "AttributeError", node, "except")
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        if not getattr(node, "chained", False):
            cases: dict[tuple[str, str], list[str]] = {}
            step: ast.AST | None = node
            while isinstance(step, ast.If):
                t = step.test
                if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], (ast.Eq, ast.Is)) and isinstance(t.comparators[0], ast.Constant):
                    value = t.comparators[0].value
                    kind = "string" if isinstance(value, str) else "numeric" if isinstance(value, (int, float)) and not isinstance(value, bool) else ""
                    if kind:
                        cases.setdefault((ast.unparse(t.left), kind), []).append(str(value))
                step = step.orelse[0] if len(step.orelse) == 1 and isinstance(step.orelse[0], ast.If) else None
                if step is not None:
                    step.chained = True
            for (subject, kind), values in cases.items():
                self.put("dispatch", subject, node, kind, sorted(set(values)))
        self.generic_visit(node)

    def visit_Match(self, node: ast.Match) -> None:
        values = [c.pattern.value.value for c in node.cases if isinstance(c.pattern, ast.MatchValue) and isinstance(c.pattern.value, ast.Constant)]
        if values:
            self.put("dispatch", ast.unparse(node.subject), node, "string" if all(isinstance(v, str) for v in values) else "numeric", sorted({str(v) for v in values}))
        self.generic_visit(node)


def parse(source: str) -> list[tuple]:
    """The facts of one module."""
    try:
        tree = ast.parse(source)
        found = Facts()
        found.visit(tree)
        return found.rows + shapes.collect(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line = getattr(e, "lineno", None) or 1
        return [("syntax_error", "", "", type(e).__name__, line, line, str(e), [], {})]


def facts(source_modules: DataFrame) -> DataFrame:
    """All facts of the modules, one parse of each."""
    schema = pa.schema([("path", pa.string()), ("module", pa.string()), ("family", pa.string()), ("owner", pa.string()), ("func", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("value", pa.string()), ("items", pa.list_(pa.string())), ("numbers", pa.map_(pa.string(), pa.int64()))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for path, module, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(path, module, *r[:8], list(r[8].items())) for r in parse(source or "")]
                chars += len(source or "")
                if rows and (len(rows) >= FACT_ROWS or chars >= FACT_CHARS):
                    yield batch_of(rows)
                    rows, chars = [], 0
        if rows:
            yield batch_of(rows)

    return source_modules.select("path", "module", "source").mapInArrow(run, FACTS)


def packed_lines(source_modules: DataFrame) -> DataFrame:
    """(path, line, text): lines with two statements or more on them."""
    lines = source_modules.select("path", F.posexplode(F.split("source", "\n")).alias("line", "text"))
    plain = F.regexp_replace("text", r"'[^']*'|\"[^\"]*\"|#.*", "")
    return lines.where(plain.rlike(r";\s*\S")).select("path", (F.col("line") + 1).cast("long").alias("line"), "text")


def family(all_facts: DataFrame, *names: str) -> DataFrame:
    return all_facts.where(F.col("family").isin(*names))


def blank_runs(source_modules: DataFrame, least: int = 4) -> DataFrame:
    """(path, line, n): runs of more than ``least`` blank lines, by islands over the split source."""
    from fiberloom.operators.ranking import runs

    lines = source_modules.select("path", F.posexplode(F.split("source", "\n")).alias("line", "text")).withColumn("blank", F.trim("text") == "")
    return runs(lines, ["path"], ["line"], "blank", least + 1).where("blank").select("path", (F.col("first_line") + 1).cast("long").alias("line"), "n")
