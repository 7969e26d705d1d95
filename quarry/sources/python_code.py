"""Facts of Python files, from one parse of each: functions, classes, imports, names used, and smells of the syntax tree.

A file that does not parse yields one fact of kind error. All other operators on Python code are plans
over these facts.
"""

from __future__ import annotations

import ast
import hashlib
import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import singular_plural

FACTS = "path string, kind string, name string, line int, end_line int, scope string, size int, value string, params array<string>, words array<string>"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTION, ast.ClassDef)
_BRANCH = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert)
_LOGS = {"print", "debug", "info", "warning", "error", "log", "exception", "critical"}

# Smells of the syntax tree and their severity.
SMELLS = {
    "monster_function": "high",
    "dead_function": "medium",
    "inline_class": "medium",
    "deferred_import": "low",
    "lru_cache_mutable": "medium",
    "nested_closure": "medium",
    "mutable_ref_hack": "medium",
    "high_cyclomatic_complexity": "medium",
    "subprocess_no_timeout": "high",
    "unsafe_file_write": "medium",
    "unreachable_code": "high",
    "constant_return": "medium",
    "noop_function": "high",
    "sys_exit_in_library": "high",
    "import_path_mutation": "high",
    "import_env_mutation": "medium",
    "import_runtime_init": "medium",
    "silent_except": "high",
    "empty_except": "high",
    "swallowed_error": "high",
    "optional_param_sprawl": "medium",
    "mutable_class_var": "high",
    "star_import": "medium",
}
# Calls that make something mutable, methods that change it, and attributes that every host has.
MUTABLE = {"set", "list", "dict", "defaultdict", "OrderedDict", "Counter"}
CHANGES = {"append", "extend", "insert", "pop", "remove", "clear", "update", "setdefault", "add", "discard"}
HOSTED = {"logger"}
#: Rows of facts that a worker hands on at once.
ROWS = 20_000
# Kinds of facts that need every node, and fields that hold no nodes but contexts, operators and plain values.
_DEEP = {"function", "body", "class", "import", "use", "dict", "constant", "key", "smell"}
_FLAT = {"ctx", "op", "ops", "id", "attr", "arg", "module", "level", "asname", "kind", "type_comment", "simple", "conversion", "is_async"}
_FIELDS: dict[type, tuple[str, ...]] = {ast.Constant: ()}
_DUNDERS = {f"__{n}__" for n in "init str repr enter exit del hash eq lt le gt ge ne bool len".split()}


def _children(node: ast.AST) -> list[ast.AST]:
    """Child nodes in order, without contexts and operators."""
    kind = type(node)
    if (fields := _FIELDS.get(kind)) is None:
        fields = _FIELDS[kind] = tuple(f for f in kind._fields if f not in _FLAT)
    out = []
    for f in fields:
        value = getattr(node, f, None)
        if isinstance(value, list):
            out.extend(v for v in value if isinstance(v, ast.AST))
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def _walk(node: ast.AST) -> list[ast.AST]:
    """A node and all below it, level by level."""
    out = [node]
    for n in out:
        out.extend(_children(n))
    return out


def _dotted(node: ast.AST) -> str:
    """a.b.c of a name or attribute; empty for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else ""
    return ""


def _callee(node: ast.AST) -> str:
    return _dotted(node.func) if isinstance(node, ast.Call) else ""


def _is_text(stmt: ast.stmt) -> bool:
    return isinstance(stmt, ast.Expr) and isinstance(stmt.value, ast.Constant)


def _nothing(stmt: ast.stmt) -> bool:
    return isinstance(stmt, ast.Pass) or isinstance(stmt, ast.Return) and (stmt.value is None or isinstance(stmt.value, ast.Constant) and stmt.value.value is None)


def _logs(stmt: ast.stmt) -> bool:
    return isinstance(stmt, ast.Expr) and isinstance(stmt.value, ast.Call) and (_callee(stmt.value).rpartition(".")[2] or getattr(stmt.value.func, "attr", "")) in _LOGS


def _trivial(stmt: ast.stmt) -> bool:
    return _nothing(stmt) or _logs(stmt) or isinstance(stmt, ast.If) and all(map(_trivial, [*stmt.body, *stmt.orelse]))


def cyclomatic(node: ast.AST) -> int:
    return 1 + sum(isinstance(n, _BRANCH) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in _walk(node))


def normalised(source: list[str]) -> list[str]:
    """Lines of a body without comments, blank lines and lines that only log."""
    out = []
    for line in source:
        line = re.sub(r"\s+#.*$|^#.*$", "", line.strip())
        if line and not re.match(r"(print|log(ger|ging)?\.\w+)\s*\(", line):
            out.append(line)
    return out


class _Facts:
    def __init__(self, path: str, text: str, kinds: Collection[str] | None = None):
        self.path, self.lines, self.rows, self.kinds = path, text.splitlines(), [], kinds
        self.tree = ast.parse(text)
        self.walked: dict[ast.AST, list[ast.AST]] = {}
        self.mutable = {t.id for s in self.tree.body if isinstance(s, (ast.Assign, ast.AnnAssign)) and isinstance(s.value, (ast.List, ast.Dict, ast.Set, ast.Call)) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)}

    def wants(self, *kinds: str) -> bool:
        return self.kinds is None or any(k in self.kinds for k in kinds)

    def below(self, node: ast.AST) -> list[ast.AST]:
        """_walk(), once for each node."""
        if node not in self.walked:
            self.walked[node] = _walk(node)
        return self.walked[node]

    def add(self, kind: str, name: str, node: ast.AST, scope: str = "", size: int = 0, value: str = "", params: list[str] | None = None, words: list[str] | None = None) -> None:
        if self.kinds is None or kind in self.kinds:
            self.rows.append((self.path, kind, name, node.lineno, getattr(node, "end_lineno", node.lineno), scope, size, value, params or [], words or []))

    def smell(self, name: str, node: ast.AST, value: str = "") -> None:
        self.add("smell", name, node, value=value)

    def all(self) -> list[tuple]:
        if self.wants(*_DEEP):
            self.scan(self.tree, "")
        if self.wants("smell"):
            self.at_import()
        self.whole()
        for block in _walk(self.tree) if self.wants("smell") else ():
            for field in ("body", "orelse", "finalbody"):
                stmts = getattr(block, field, None)
                if isinstance(stmts, list):
                    for a, b in zip(stmts, stmts[1:], strict=False):
                        if isinstance(a, (ast.Return, ast.Raise, ast.Break, ast.Continue)) and not _is_text(b):
                            self.smell("unreachable_code", b)
        return self.rows

    def scan(self, node: ast.AST, scope: str) -> None:
        todo = [(child, scope) for child in reversed(_children(node))]
        while todo:
            child, scope = todo.pop()
            self.visit(child, scope)
            within = f"{scope}.{child.name}".strip(".") if isinstance(child, _SCOPES) else scope
            todo.extend((c, within) for c in reversed(_children(child)))

    def visit(self, node: ast.AST, scope: str) -> None:
        if isinstance(node, _FUNCTION):
            if self.wants("function", "body", "smell"):
                self.function(node, scope)
        elif isinstance(node, ast.ClassDef):
            if self.wants("class", "smell"):
                self.klass(node, scope)
        elif isinstance(node, ast.Import):
            for a in node.names:
                self.add("import", a.name, node, scope, value=a.asname or a.name.partition(".")[0])
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            for a in node.names:
                self.add("import", base, node, scope, size=1, value=a.asname or a.name, words=[a.name])
                if a.name == "*":
                    self.smell("star_import", node, base)
        elif isinstance(node, ast.ExceptHandler):
            self.handler(node)
        elif isinstance(node, ast.Call):
            callee = _callee(node)
            if callee.startswith("subprocess.") and callee[11:] in ("run", "Popen", "call", "check_call", "check_output") and all(k.arg != "timeout" for k in node.keywords):
                self.smell("subprocess_no_timeout", node, callee)
            if callee in ("sys.exit", "exit", "quit") and not re.search(r"(^|/)(__main__|cli|main|manage|setup)\.py$|/(commands|scripts|bin|tests?)/", self.path):
                self.smell("sys_exit_in_library", node, callee)
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            self.add("use", node.id, node, scope)
        elif isinstance(node, ast.Attribute):
            self.add("use", node.attr, node, scope)
        elif isinstance(node, ast.Dict):
            keys = sorted({k.value for k in node.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)})
            if len(keys) >= 3:
                self.add("dict", "", node, scope, size=len(keys), words=keys)
        elif isinstance(node, ast.Assign) and not scope and isinstance(node.value, ast.Constant):
            for t in node.targets:
                if isinstance(t, ast.Name) and t.id.isupper():
                    self.add("constant", t.id, node, value=repr(node.value.value))
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            self.add("key", node.slice.value, node, scope, value="write" if isinstance(node.ctx, ast.Store) else "read", words=[node.value.id])

    def handler(self, node: ast.ExceptHandler) -> None:
        name = _dotted(node.type) if node.type else ""
        if all(isinstance(s, (ast.Pass, ast.Continue)) for s in node.body):
            self.smell("silent_except", node, name)
            if any(isinstance(s, ast.Pass) for s in node.body):
                self.smell("empty_except", node, name)
        elif all(map(_logs, node.body)):
            self.smell("swallowed_error", node, name)

    def klass(self, node: ast.ClassDef, scope: str) -> None:
        methods = [s for s in node.body if isinstance(s, _FUNCTION)]
        first = next((m for m in methods if m.name == "__init__"), None)
        attributes = sorted({t.attr for n in self.below(first) if isinstance(n, (ast.Assign, ast.AnnAssign)) for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Attribute) and _dotted(t.value) == "self"}) if first else []
        bases = [b for b in map(_dotted, node.bases) if b and b not in ("object", "ABC") and not b.endswith("Mixin")]
        self.add("class", node.name, node, scope, size=len(methods), value=",".join(bases), params=attributes, words=[m.name for m in methods])
        if not any((_callee(d) or _dotted(d)).rpartition(".")[2] == "dataclass" for d in node.decorator_list):
            for s in node.body:
                if isinstance(s, (ast.Assign, ast.AnnAssign)) and isinstance(s.value, (ast.List, ast.Dict, ast.Set)):
                    self.smell("mutable_class_var", s, node.name)

    def function(self, node: ast.FunctionDef, scope: str) -> None:
        a = node.args
        params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        body = normalised(self.lines[node.body[0].lineno - 1 : node.end_lineno])
        loc, name = node.end_lineno - node.lineno + 1, node.name
        decorators = [_callee(d) or _dotted(d) for d in node.decorator_list]
        self.add("function", name, node, scope, size=loc, value=ast.unparse(node.returns) if node.returns else "", params=params, words=body)
        self.add("body", name, node, scope, size=len(body), value=hashlib.md5("\n".join(body).encode()).hexdigest(), words=decorators)
        if not self.wants("smell"):
            return
        real = node.body[1:] if _is_text(node.body[0]) else node.body
        if loc > 150:
            self.smell("monster_function", node, f"{name}: {loc} lines")
        if (cc := cyclomatic(node)) > 12:
            self.smell("high_cyclomatic_complexity", node, f"{name}: {cc}")
        if not decorators:
            if len(real) == 1 and len(node.body) <= 2 and _nothing(real[0]):
                self.smell("dead_function", node, name)
            if len(real) >= 3 and name not in _DUNDERS and all(map(_trivial, real)):
                self.smell("noop_function", node, name)
            self.constant(node, loc)
        inner = self.below(node)[1:]
        late = [n for n in inner if isinstance(n, (ast.Import, ast.ImportFrom)) and getattr(n, "module", "") not in ("typing", "typing_extensions", "__future__")]
        if late and not re.search(r"(^|/)(tests?/|test_|conftest)", self.path):
            self.smell("deferred_import", min(late, key=lambda n: n.lineno), name)
        for s in node.body:
            if isinstance(s, ast.ClassDef):
                self.smell("inline_class", s, name)
        self.closures(node, inner)
        cells = {s.targets[0].id: s for s in node.body if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.List) and len(s.value.elts) == 1}
        nested = [n for f in inner if isinstance(f, (*_FUNCTION, ast.Lambda)) for n in self.below(f)] if cells else []
        for cell in sorted({n.value.id for n in nested if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and isinstance(n.slice, ast.Constant) and n.slice.value == 0} & set(cells)):
            self.smell("mutable_ref_hack", cells[cell], cell)
        calls = [n for n in inner if isinstance(n, ast.Call)]
        if not any(_callee(c) in ("os.replace", "os.rename", "shutil.move") for c in calls):
            for c in calls:
                if isinstance(c.func, ast.Attribute) and c.func.attr in ("write_text", "write_bytes"):
                    self.smell("unsafe_file_write", c, name)
        if any(d.rpartition(".")[2] in ("lru_cache", "cache") for d in decorators):
            if read := sorted({n.id for n in inner if isinstance(n, ast.Name) and n.id in self.mutable and n.id not in params}):
                self.smell("lru_cache_mutable", node, read[0])
        optional = len(a.defaults) + sum(d is not None for d in a.kw_defaults)
        total = len(a.posonlyargs) + len(a.args) - (1 if a.args and a.args[0].arg in ("self", "cls") else 0) + len(a.kwonlyargs)
        if optional >= 4 and total >= 5 and 2 * optional > total and not name.startswith("test_"):
            self.smell("optional_param_sprawl", node, name)

    def constant(self, node: ast.FunctionDef, loc: int) -> None:
        returns = [n for n in self.below(node) if isinstance(n, ast.Return)]
        branches = any(isinstance(n, (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.ExceptHandler)) for n in self.below(node))
        if loc >= 4 and branches and len(returns) >= 2 and all(isinstance(r.value, ast.Constant) for r in returns):
            values = {repr(r.value.value) for r in returns}
            if len(values) == 1 and values != {"None"}:
                self.smell("constant_return", node, values.pop())

    def closures(self, node: ast.FunctionDef, inner: list[ast.AST]) -> None:
        """Three inner functions, or one inside another."""
        own = [n for n in inner if isinstance(n, (*_FUNCTION, ast.Lambda))]
        defs = [n for n in own if isinstance(n, _FUNCTION)]
        deep = any(m is not n and isinstance(m, (*_FUNCTION, ast.Lambda)) for n in defs for m in self.below(n))
        if deep or len(defs) >= 3:
            self.smell("nested_closure", node, node.name)

    def at_import(self) -> None:
        """Calls that run when the module is imported."""
        todo = [s for s in self.tree.body if not (isinstance(s, ast.If) and "__name__" in ast.unparse(s.test) and "__main__" in ast.unparse(s.test))]
        while todo:
            n = todo.pop()
            if isinstance(n, (*_SCOPES, ast.Lambda)):
                continue
            if isinstance(n, ast.Call):
                name = _callee(n)
                if name in ("sys.path.insert", "sys.path.append"):
                    self.smell("import_path_mutation", n, name)
                elif name.rpartition(".")[2] == "load_dotenv":
                    self.smell("import_env_mutation", n, name)
                elif name.rpartition(".")[2] in ("setup_logging", "basicConfig", "dictConfig", "fileConfig"):
                    self.smell("import_runtime_init", n, name)
            todo.extend(_children(n))

    def whole(self) -> None:
        """Facts of the file as a whole: its length, what its functions call and import, its globals with their changes, and what mixins expect of their hosts."""
        if self.wants("module"):
            self.rows.append((self.path, "module", "", 1, len(self.lines), "", len(self.lines), "", [], []))
        if self.wants("calls"):
            self.calls()
        if self.wants("global", "change"):
            self.globals_()
        for node in self.tree.body if self.wants("mixin") else ():
            if isinstance(node, ast.ClassDef):
                self.mixin(node)

    def calls(self) -> None:
        roots = {}
        for stmt in self.tree.body:
            for a in stmt.names if isinstance(stmt, (ast.Import, ast.ImportFrom)) else ():
                first = a.name.partition(".")[0]
                module = first if isinstance(stmt, ast.Import) else (stmt.module or "").partition(".")[0] or first
                roots[a.asname or (first if isinstance(stmt, ast.Import) else a.name)] = module
        tops = [n for n in self.tree.body if isinstance(n, _FUNCTION)]
        names = {n.name for n in tops}
        for fn in tops:
            inside = self.below(fn)
            called = {n.func.id for n in inside if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)} & names - {fn.name}
            used = {roots[n.id] for n in inside if isinstance(n, ast.Name) and n.id in roots}
            self.add("calls", fn.name, fn, params=sorted(called), words=sorted(used))

    def globals_(self) -> None:
        for stmt in self.tree.body:
            if isinstance(stmt, (ast.Assign, ast.AnnAssign)):
                for t in stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target]:
                    if isinstance(t, ast.Name) and not re.match(r"^_?[A-Z][A-Z0-9_]+$", t.id) and (stmt.value is not None and _changeable(stmt.value) or isinstance(stmt, ast.AnnAssign) and _optional(stmt.annotation)):
                        self.add("global", t.id, stmt)
        for fn in _walk(self.tree):
            if not isinstance(fn, _FUNCTION):
                continue
            own = {a.arg for a in (*fn.args.args, *fn.args.posonlyargs, *fn.args.kwonlyargs)}
            inside = self.below(fn)
            declared = {name for n in inside if isinstance(n, ast.Global) for name in n.names}
            for n in inside:
                targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AugAssign) else []
                for t in targets:
                    if isinstance(t, ast.Name) and t.id in declared - own:
                        self.add("change", t.id, n, fn.name, value="rebind")
                    elif isinstance(n, ast.Assign) and isinstance(t, ast.Subscript) and isinstance(t.value, ast.Name) and t.value.id not in own:
                        self.add("change", t.value.id, n, fn.name, value="inside")
                if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in CHANGES and isinstance(n.func.value, ast.Name) and n.func.value.id not in own:
                    self.add("change", n.func.value.id, n, fn.name, value="inside")

    def mixin(self, node: ast.ClassDef) -> None:
        if not (node.name.endswith("Mixin") or "/phases/" in self.path.replace("\\", "/")) or any(_dotted(getattr(b, "value", b) if isinstance(b, ast.Subscript) else b).rpartition(".")[2].endswith("Protocol") for b in node.bases):
            return
        reads, writes = set(), {s.target.id for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)}
        for n in (n for stmt in node.body if isinstance(stmt, _FUNCTION) for n in self.below(stmt)):
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self":
                (reads if isinstance(n.ctx, ast.Load) else writes).add(n.attr)
            elif _callee(n) == "setattr" and len(n.args) > 1 and _dotted(n.args[0]) == "self" and isinstance(n.args[1], ast.Constant) and isinstance(n.args[1].value, str):
                writes.add(n.args[1].value)
        wanted = sorted(a for a in reads - writes - HOSTED if not a.startswith("__"))
        self.add("mixin", node.name, node, size=len(wanted), words=wanted)


def _changeable(value: ast.AST) -> bool:
    """Whether a value is a list, dict or set, makes one, or is None, in whose place something will come."""
    if isinstance(value, ast.Call):
        return _callee(value).rpartition(".")[2] in MUTABLE
    return isinstance(value, (ast.List, ast.Dict, ast.Set)) or isinstance(value, ast.Constant) and value.value is None


def _optional(note: ast.AST) -> bool:
    none = lambda n: isinstance(n, ast.Constant) and n.value is None
    return isinstance(note, ast.Subscript) and _dotted(note.value).rpartition(".")[2] == "Optional" or isinstance(note, ast.BinOp) and isinstance(note.op, ast.BitOr) and (none(note.left) or none(note.right))


def file_facts(path: str, text: str | None, kinds: Collection[str] | None = None) -> list[tuple]:
    try:
        return _Facts(path, text or "", kinds).all()
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "error", type(e).__name__, 0, 0, "", 0, str(e)[:200], [], [])]


def facts(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """The facts of files (path, content): all, or those of some kinds with errors. What other kinds alone need is not looked for."""
    types = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in FACTS.split(", ")])
    wanted = None if kinds is None else frozenset(kinds)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows.extend(file_facts(path, text, wanted))
                while len(rows) >= ROWS:
                    yield batch(rows[:ROWS])
                    rows = rows[ROWS:]
        yield batch(rows)

    return files.select("path", "content").mapInArrow(run, FACTS)


def functions(found: DataFrame) -> DataFrame:
    """(id, file, name, line, loc, params, returns, body) of facts."""
    rows = found.filter("kind = 'function'")
    key = F.concat_ws("::", "path", F.concat_ws(".", F.when(F.col("scope") != "", F.col("scope")), "name"), F.col("line"))
    return rows.select(key.alias("id"), F.col("path").alias("file"), "name", "line", F.col("size").alias("loc"), "params", F.col("value").alias("returns"), F.array_join("words", "\n").alias("body"))


def smells(found: DataFrame) -> DataFrame:
    """(smell_id, path, severity, n, lines) of facts, by file."""
    severity = F.create_map(*[F.lit(x) for kv in SMELLS.items() for x in kv])
    rows = found.filter("kind = 'smell'").groupBy(F.col("name").alias("smell_id"), "path").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("line")), 1, 10).alias("lines"))
    return rows.withColumn("severity", severity[F.col("smell_id")])


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, deferred): imports between files (path). A name imported from a package is its submodule if there is one, or the package; x.py goes before x/__init__.py; an import inside a function or class is deferred."""
    rows = found.filter("kind = 'import'").select(F.col("path").alias("src"), F.col("name").alias("module"), (F.col("size") == 1).alias("named"), F.get("words", 0).alias("member"), (F.col("scope") != "").alias("deferred"))
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    folder = F.split(F.regexp_replace("src", r"/?[^/]*$", ""), "/")
    up = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0))), "/")
    bare = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    base = F.when(dots > 0, F.concat_ws("/", F.when(up != "", up), F.when(bare != "", bare))).otherwise(bare)
    rows = rows.withColumn("base", base).withColumn("k", F.xxhash64("src", "module", "named", "member", "deferred"))
    inner = F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), "member")
    ways = F.array(*[F.struct(F.lit(i).alias("rank"), p.alias("dst")) for i, p in enumerate((F.when(F.col("named"), F.concat(inner, F.lit(".py"))), F.when(F.col("named"), F.concat(inner, F.lit("/__init__.py"))), F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py"))))])
    tried = rows.select("k", "src", "deferred", F.explode(F.filter(ways, lambda x: x["dst"].isNotNull())).alias("w")).select("k", "src", "deferred", "w.*")
    hit = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    best = hit.groupBy("k", "src", "deferred").agg(F.min_by("dst", "rank").alias("dst")).filter("src <> dst")
    return best.groupBy("src", "dst").agg(F.bool_and("deferred").alias("deferred"))


def uncalled(found: DataFrame, least: int = 4) -> DataFrame:
    """(path, name, line): private top-level functions without decorators, of four lines or more, whose name nothing uses or imports."""
    plain = found.filter("kind = 'body' and size(words) = 0").select("path", "name", "line")
    rows = found.filter("kind = 'function' and scope = ''").filter(F.col("name").startswith("_") & ~F.col("name").startswith("__") & (F.col("size") >= least)).join(plain, ["path", "name", "line"], "left_semi")
    used = found.filter("kind = 'use'").select("name").unionByName(found.filter("kind = 'import'").select(F.get("words", 0).alias("name")))
    return rows.join(used.distinct(), "name", "left_anti").select("path", "name", "line")


def private_imports(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, name): private names that a file imports from a file in another folder."""
    rows = found.filter("kind = 'import' and size = 1").select(F.col("path").alias("src"), F.get("words", 0).alias("member"), F.element_at(F.split("name", r"\."), -1).alias("module")).filter(F.col("member").startswith("_") & ~F.col("member").startswith("__"))
    up = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    far = edges.filter(up(F.col("src")) != up(F.col("dst"))).withColumn("module", F.regexp_replace(F.regexp_replace("dst", r"/__init__\.py$", ""), r"^.*/|\.py$", ""))
    return rows.join(far, ["src", "module"]).select("src", "dst", F.col("member").alias("name")).distinct()


def duplicate_constants(found: DataFrame) -> DataFrame:
    """(name, value, files): constants of equal name and value in several files."""
    rows = found.filter("kind = 'constant'").groupBy("name", "value").agg(F.countDistinct("path").alias("files"))
    return rows.filter("files > 1")


def key_flow(found: DataFrame) -> DataFrame:
    """(path, scope, variable, key, kind): keys of a variable that a scope writes and never reads (dead_write), or reads and never writes though it writes others (phantom_read); pairs written~read of such keys that differ in two letters or in number (near_miss); and keys written again before anything reads them (overwritten_key)."""
    group = ["path", "scope", "variable"]
    rows = found.filter("kind = 'key'").withColumn("variable", F.get("words", 0))
    line = lambda what: F.array_sort(F.collect_list(F.when(F.col("value") == what, F.col("line"))))  # noqa: E731  the lines of one key in one scope
    keys = rows.groupBy(*group, F.col("name").alias("key")).agg(line("write").alias("w"), line("read").alias("r"))
    # The keys of one variable in one scope are few: they are compared in place.
    sets = keys.groupBy(*group).agg(F.collect_list(F.struct("key", "w", "r")).alias("ks"))
    only = lambda a, b: F.transform(F.filter("ks", lambda k: (F.size(k[a]) > 0) & (F.size(k[b]) == 0)), lambda k: k["key"])
    any_of = lambda a: F.exists("ks", lambda k: F.size(k[a]) > 0)
    none = F.array().cast("array<string>")
    parts = sets.select(*group, "ks", F.when(any_of("r"), only("w", "r")).otherwise(none).alias("dead"), F.when(any_of("w"), only("r", "w")).otherwise(none).alias("phantom"))
    alike = lambda x, y: (F.levenshtein(x, y) <= 2) | singular_plural(x, y)
    near = F.flatten(F.transform("dead", lambda d: F.transform(F.filter("phantom", lambda p: alike(d, p)), lambda p: F.concat_ws("~", d, p))))
    again = lambda k: F.filter(k["w"], lambda x, i: (i > 0) & ~F.exists(k["r"], lambda y: (y > F.get(k["w"], i - 1)) & (y <= x)))
    twice = F.flatten(F.transform("ks", lambda k: F.transform(again(k), lambda _: k["key"])))
    named = lambda keys, kind: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))
    out = F.concat(named(F.col("dead"), "dead_write"), named(F.col("phantom"), "phantom_read"), named(near, "near_miss"), named(twice, "overwritten_key"))
    return parts.select(*group, F.explode(out).alias("x")).select(*group, "x.key", "x.kind")


def _parts(names: list[str], called: list[list[str]]) -> list[int]:
    """Sizes of the components that calls put names together in; equal names are one."""
    root = {n: n for n in names}

    def top(n: str) -> str:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for n, to in zip(names, called, strict=True):
        for m in to:
            root.setdefault(m, m)
            root[top(m)] = top(n)
    known = set(names)
    return list(Counter(top(n) for n in known).values())


def cohesion(found: DataFrame, least_loc: int = 200, least: int = 8) -> DataFrame:
    """(path, functions, components, families, imports): long files of many top-level functions that fall apart: into three components by calls, the largest with two thirds at most (65 in 100, rounded down), or into two with four beginnings of names or three sets of imported packages.

    Calls stay within a file, so each file is put together on its own.
    """
    calls = F.when(F.col("kind") == "calls", F.struct("name", "params", "words"))
    files = found.filter("kind in ('module', 'calls')").groupBy("path").agg(F.max(F.when(F.col("kind") == "module", F.col("size"))).alias("loc"), F.collect_list(calls).alias("fns"))
    many = files.filter((F.col("loc") >= least_loc) & (F.size("fns") >= least)).select("path", F.col("fns.name").alias("names"), F.col("fns.params").alias("called"), F.col("fns.words").alias("used"))
    schema = "path string, functions long, components long, families long, imports long, largest long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, names, called, used in zip(*(b.column(c).to_pylist() for c in ("path", "names", "called", "used")), strict=True):
                sizes = _parts(names, called)
                # Functions of one name in a file are one.
                rows.append((path, len(names), len(sizes), len({n.split("_")[0] for n in names}), len({tuple(u) for u in used if u}), max(sizes)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["path", "functions", "components", "families", "imports", "largest"])

    apart = (F.col("components") >= 3) & (F.col("largest") <= F.floor(F.col("functions") * 0.65))
    mixed = (F.col("components") >= 2) & ((F.col("families") >= 4) | (F.col("imports") >= 3))
    return many.mapInArrow(run, schema).filter(apart | mixed).select("path", "functions", "components", "families", "imports")


def mutable_globals(found: DataFrame) -> DataFrame:
    """(path, name, line, changes, rebound): names of a module that hold something mutable, or nothing yet, and that its functions change, at how many places, and whether they rebind them."""
    change = F.col("kind") == "change"
    agg = found.filter("kind in ('global', 'change')").groupBy("path", "name").agg(
        F.max(F.when(F.col("kind") == "global", F.col("line"))).alias("line"), F.size(F.collect_set(F.when(change, F.col("line")))).cast("long").alias("changes"), F.bool_or(F.when(change, F.col("value") == "rebind")).alias("rebound")
    )
    return agg.filter("line is not null and changes > 0")


def _ends(dotted: Column, first: int) -> Column:
    """A dotted name and its ends at each dot, without the first ones."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i > first), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def stale_imports(found: DataFrame) -> DataFrame:
    """(path, name, line, source): imports of a name that its module rebinds, so that the importer keeps what it was. Modules are told by the ends of their dotted names.

    One of the two dotted names is an end of the other, so they meet at that end.
    """
    dotted = F.replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))
    both = found.filter("kind in ('global', 'change') or kind = 'import' and size = 1").select("path", "kind", "line", "size", "value", "words", "name")
    rebound = mutable_globals(both).filter("rebound").select(dotted.alias("source"), F.col("name").alias("member"))
    rows = both.filter("kind = 'import'").select("path", "line", F.get("words", 0).alias("member"), F.regexp_replace("name", r"^\.+", "").alias("module"))
    short = rebound.withColumn("end", F.col("source"))
    longer = rebound.select("source", "member", F.explode(_ends(F.col("source"), 1)).alias("end"))
    inner = rows.select("path", "line", "member", F.explode(_ends(F.col("module"), 0)).alias("end")).join(short, ["member", "end"])
    outer = rows.withColumnRenamed("module", "end").join(longer, ["member", "end"])
    columns = ["path", F.col("member").alias("name"), "line", "source"]
    return inner.select(*columns).unionByName(outer.select(*columns))


def mixin_contracts(found: DataFrame, least: int = 3) -> DataFrame:
    """(path, name, line, wanted, tier, confidence): mixins that read three attributes or more of self that they neither set nor declare."""
    rows = found.filter("kind = 'mixin'").filter(F.col("size") >= least)
    many = F.col("size") >= 6
    return rows.select("path", "name", "line", F.col("words").alias("wanted"), F.when(many, 4).otherwise(3).alias("tier"), F.when(many, "high").otherwise("medium").alias("confidence"))


def indent_unit(widths: list[int]) -> int:
    """The greatest common divisor of indents from 1 to 16; 4 without any."""
    return reduce(math.gcd, [w for w in widths if 1 <= w <= 16], 0) or 4


def nesting(text: str) -> int:
    """How many units the deepest line is indented."""
    widths = [len(x) - len(x.lstrip(" ")) for x in (text or "").expandtabs(4).splitlines() if x.strip()]
    return max(widths, default=0) // indent_unit(widths)
