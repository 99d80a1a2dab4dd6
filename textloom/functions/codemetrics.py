"""Structure and complexity of Python source, from one parse: published definitions, on the standard library's ``ast``."""

from __future__ import annotations

import ast
import io
import math
import tokenize
from collections import Counter

_LOOPS = (ast.For, ast.While)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)

#: What an empty or unparsable source has.
DEFAULTS = {
    "max_loop_depth": 0, "total_loops": 0, "for_loops": 0, "while_loops": 0, "loops_at_depth": {}, "has_recursion": False, "recursive_functions": [],
    "function_names": [], "nested_block_depth": 0, "cyclomatic": 1, "functions_count": 0, "token_cyclomatic": 1, "nloc": 0, "token_count": 0, "parameters": 0, "path_cyclomatic": 1, "cognitive": 0,
    "halstead_difficulty": 1.0, "halstead_volume": 0.0, "halstead_effort": 0.0, "halstead_bugs": 0.0, "halstead_time": 0.0, "maintainability": 100.0, "blocks": [],
}
SCHEMA = (
    "max_loop_depth int, total_loops int, for_loops int, while_loops int, loops_at_depth map<int,int>, has_recursion boolean, recursive_functions array<string>, function_names array<string>, "
    "nested_block_depth int, cyclomatic int, functions_count int, token_cyclomatic int, nloc int, token_count int, parameters int, path_cyclomatic int, cognitive int, "
    "halstead_difficulty double, halstead_volume double, halstead_effort double, halstead_bugs double, halstead_time double, maintainability double, "
    "blocks array<struct<name:string,complexity:int,lineno:int,type:string>>, error string"
)


def loops(tree: ast.AST) -> dict:
    """Plain loops by depth; what stands in a loop, its ``else`` included, is one deeper, also across functions."""
    at, kinds = Counter(), Counter()

    def walk(node: ast.AST, depth: int) -> None:
        if isinstance(node, _LOOPS):
            depth += 1
            at[depth] += 1
            kinds[type(node)] += 1
        for child in ast.iter_child_nodes(node):
            walk(child, depth)

    walk(tree, 0)
    return {"max_loop_depth": max(at, default=0), "total_loops": sum(at.values()), "for_loops": kinds[ast.For], "while_loops": kinds[ast.While], "loops_at_depth": dict(at)}


def recursion(tree: ast.AST) -> dict:
    """Functions that call themselves by name, directly from their own body."""
    found = set()

    def walk(node: ast.AST, name: str | None) -> None:
        if isinstance(node, ast.FunctionDef):
            name = node.name
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == name:
            found.add(name)
        for child in ast.iter_child_nodes(node):
            walk(child, name)

    walk(tree, None)
    return {"has_recursion": bool(found), "recursive_functions": sorted(found)}


def nesting(node: ast.AST, depth: int = 0) -> int:
    """Depth of nested if, for, while and with; an ``elif`` is an ``if`` within the one before."""
    depth += isinstance(node, (ast.If, ast.For, ast.While, ast.With))
    return max([depth, *(nesting(x, depth) for x in ast.iter_child_nodes(node))])


def _decisions(node: ast.AST) -> int:
    """Branch points below a node, without those of functions and classes in it."""
    total = 0
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (*_FUNCTIONS, ast.ClassDef)):
            continue
        if isinstance(child, ast.Try):
            total += len(child.handlers) + bool(child.orelse)
        elif isinstance(child, ast.BoolOp):
            total += len(child.values) - 1
        elif isinstance(child, (ast.If, ast.IfExp, ast.Assert)):
            total += 1
        elif isinstance(child, (ast.For, ast.While, ast.AsyncFor)):
            total += 1 + bool(child.orelse)
        elif isinstance(child, ast.comprehension):
            total += 1 + len(child.ifs)
        elif isinstance(child, ast.Match):
            total += len(child.cases) - any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in child.cases)
        total += _decisions(child)
    return total


def cyclomatic_blocks(tree: ast.AST) -> list[dict]:
    """Functions (F), methods (M) and classes (C: mean of the methods, plus 1 if there are several) that stand alone."""
    out = []

    def block(node: ast.AST, kind: str) -> int:
        body = ast.Module([x for x in node.body], [])
        value = 1 + _decisions(body)
        out.append({"name": node.name, "complexity": value, "lineno": node.lineno, "type": kind})
        return value

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _FUNCTIONS):
                block(child, "F")
            elif isinstance(child, ast.ClassDef):
                mine = [block(x, "M") for x in child.body if isinstance(x, _FUNCTIONS)]
                own = 1 + _decisions(child) + sum(mine)
                out.append({"name": child.name, "complexity": own // len(mine) + (len(mine) > 1) if mine else own, "lineno": child.lineno, "type": "C"})
                walk(ast.Module([x for x in child.body if isinstance(x, ast.ClassDef)], []))
            else:
                walk(child)

    walk(tree)
    return out


def token_metrics(tree: ast.AST, source: str) -> dict:
    """By tokens, for each function: 1 + branching words; lines and tokens of the longest, parameters of the most."""
    words = {"if", "elif", "for", "while", "and", "or", "except", "finally"}
    tokens = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT, tokenize.ENDMARKER)]
    spans = [(x.lineno, x.end_lineno, x) for x in ast.walk(tree) if isinstance(x, _FUNCTIONS)]
    out = {"token_cyclomatic": 1, "nloc": 0, "token_count": 0, "parameters": 0}
    # A line's tokens belong to the function that begins last of those it stands in: one sweep over lines and functions.
    mine: dict[int, list] = {i: [] for i in range(len(spans))}
    order, open_, at = sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1])), [], 0
    for t in tokens:
        line = t.start[0]
        while at < len(order) and spans[order[at]][0] <= line:
            open_.append(order[at])
            at += 1
        while open_ and spans[open_[-1]][1] < line:
            open_.pop()
        if open_:
            mine[open_[-1]].append(t)
    for i, (_, _, node) in enumerate(spans):
        own, args = mine[i], node.args
        out["token_cyclomatic"] = max(out["token_cyclomatic"], 1 + sum(t.type == tokenize.NAME and t.string in words for t in own))
        out["nloc"] = max(out["nloc"], len({t.start[0] for t in own}))
        out["token_count"] = max(out["token_count"], len(own))
        out["parameters"] = max(out["parameters"], len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg))
    return out


def _paths(body: list[ast.stmt]) -> int:
    """Additional paths through statements in a control-flow graph; expressions are one node."""
    total = 0
    for x in body:
        if isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While)):
            total += 1 + _paths(x.body) + _paths(x.orelse)
        elif isinstance(x, (ast.Try, ast.TryStar)):
            total += 1 + len(x.handlers) + _paths(x.body) + sum(_paths(h.body) for h in x.handlers) + _paths(x.orelse)
        elif isinstance(x, (ast.With, ast.AsyncWith)):
            total += _paths(x.body)
        elif isinstance(x, _FUNCTIONS):
            total += 1 + _paths(x.body)
        elif isinstance(x, ast.ClassDef):
            total += _paths(x.body)
    return total


def path_cyclomatic(tree: ast.Module) -> int:
    """The largest graph complexity of a function, a method, or a branching statement of the module."""
    best = 1

    def graphs(body: list[ast.stmt]) -> None:
        nonlocal best
        for x in body:
            if isinstance(x, _FUNCTIONS):
                best = max(best, 1 + _paths(x.body))
            elif isinstance(x, ast.ClassDef):
                graphs(x.body)
            elif isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try)):
                best = max(best, 1 + _paths([x]))
            elif isinstance(x, (ast.With, ast.AsyncWith)):
                graphs(x.body)

    graphs(tree.body)
    return best


def cognitive(tree: ast.AST) -> int:
    """Breaks in linear flow, each weighed by its nesting: the file's total."""

    def of(node: ast.AST, depth: int) -> int:
        total, inner = 0, depth
        if isinstance(node, ast.If):
            total += 1 + depth + of(node.test, depth) + sum(of(x, depth + 1) for x in node.body)
            rest = node.orelse
            while len(rest) == 1 and isinstance(rest[0], ast.If):
                total += 1 + of(rest[0].test, depth) + sum(of(x, depth + 1) for x in rest[0].body)
                rest = rest[0].orelse
            return total + (1 + sum(of(x, depth + 1) for x in rest) if rest else 0)
        if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            parts = [node.test] if isinstance(node, ast.While) else [node.target, node.iter]
            total = 1 + depth + sum(of(x, depth) for x in parts) + sum(of(x, depth + 1) for x in node.body)
            return total + (1 + sum(of(x, depth + 1) for x in node.orelse) if node.orelse else 0)
        if isinstance(node, (ast.ExceptHandler, ast.IfExp, ast.Match)):
            total, inner = 1 + depth, depth + 1
        elif isinstance(node, ast.BoolOp):
            total = 1
        elif isinstance(node, (*_FUNCTIONS, ast.Lambda)):
            inner = depth + 1 if of.within else depth
            of.within += 1
            total = sum(of(x, inner) for x in ast.iter_child_nodes(node))
            of.within -= 1
            return total
        return total + sum(of(x, inner) for x in ast.iter_child_nodes(node))

    of.within = 0
    return of(tree, 0)


def halstead(tree: ast.AST) -> dict:
    """Counts over unary, binary, boolean and comparing operations and augmented assignments of the whole file."""
    operators, operands, n1, n2 = set(), set(), 0, 0

    def operand(x: ast.AST, where: str) -> None:
        operands.add((where, x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else repr(x.value) if isinstance(x, ast.Constant) else ast.dump(x)))

    def walk(node: ast.AST, where: str) -> None:
        nonlocal n1, n2
        if isinstance(node, _FUNCTIONS):
            where = node.name
        kinds, sides = [], []
        if isinstance(node, ast.BinOp):
            kinds, sides = [node.op], [node.left, node.right]
        elif isinstance(node, ast.UnaryOp):
            kinds, sides = [node.op], [node.operand]
        elif isinstance(node, ast.BoolOp):
            kinds, sides = [node.op], node.values
        elif isinstance(node, ast.AugAssign):
            kinds, sides = [node.op], [node.target, node.value]
        elif isinstance(node, ast.Compare):
            kinds, sides = node.ops, [node.left, *node.comparators]
        n1, n2 = n1 + len(kinds), n2 + len(sides)
        operators.update(type(x).__name__ for x in kinds)
        for x in sides:
            operand(x, where)
        for child in ast.iter_child_nodes(node):
            walk(child, where)

    walk(tree, "")
    h1, h2 = len(operators), len(operands)
    volume = (n1 + n2) * math.log2(h1 + h2) if h1 + h2 else 0.0
    difficulty = h1 * n2 / (2 * h2) if h2 else 0.0
    return {
        "halstead_difficulty": difficulty or 1.0, "halstead_volume": volume, "halstead_effort": difficulty * volume, "halstead_bugs": volume / 3000, "halstead_time": difficulty * volume / 18,
    }


def maintainability(tree: ast.AST, source: str, volume: float) -> float:
    """Index from 0 to 100 of volume, branches, logical lines and the share of comment lines (docstrings included)."""
    logical = sum(isinstance(x, ast.stmt) for x in ast.walk(tree))
    if volume <= 0 or logical <= 0:
        return 100.0
    lines = [x.strip() for x in source.splitlines()]
    texts = [x.value for x in ast.walk(tree) if isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)]
    comments = sum(x.startswith("#") for x in lines) + sum(x.end_lineno - x.lineno + 1 for x in texts if x.end_lineno > x.lineno)
    code = max(1, sum(bool(x) and not x.startswith("#") for x in lines))
    share = math.sqrt(2.46 * math.radians(100.0 * comments / code))
    total = 1 + _decisions(tree) + sum(b["complexity"] - 1 for b in cyclomatic_blocks(tree) if b["type"] != "C")
    index = 171 - 5.2 * math.log(volume) - 0.23 * total - 16.2 * math.log(logical) + 50 * math.sin(share)
    return min(max(0.0, index * 100 / 171), 100.0)


#: Names and what joins them without a sign: a comma, or a word of the language that words of prose may also be.
_WORDS = (ast.Name, ast.Load, ast.Tuple, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.Compare, ast.In, ast.NotIn, ast.Is, ast.IsNot, ast.IfExp)


def prose(tree: ast.Module) -> bool:
    """Whether all that a source says are bare words: it assigns, calls, defines and calculates nothing.

    Such a text parses by chance, as where everything after its first word is a comment.
    """
    return bool(tree.body) and all(isinstance(x, ast.Expr) and all(isinstance(y, _WORDS) for y in ast.walk(x.value)) for x in tree.body)


def measure(source: str | None) -> dict:
    """All metrics of a source; an empty or unparsable one has the defaults and an error, never a null metric.

    So has one of bare words: it is no program.
    """
    if not source or not source.strip():
        return {**DEFAULTS, "error": "empty source"}
    try:
        tree = ast.parse(source)
        if prose(tree):
            return {**DEFAULTS, "error": "no program: bare words"}
        blocks = cyclomatic_blocks(tree)
        effort = halstead(tree)
        return {
            **loops(tree), **recursion(tree), "function_names": sorted({x.name for x in ast.walk(tree) if isinstance(x, _FUNCTIONS)}), "nested_block_depth": nesting(tree), "cyclomatic": max([1, *(b["complexity"] for b in blocks)]), "functions_count": len(blocks), **token_metrics(tree, source),
            "path_cyclomatic": path_cyclomatic(tree), "cognitive": cognitive(tree), **effort, "maintainability": maintainability(tree, source, effort["halstead_volume"]), "blocks": blocks, "error": None,
        }
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError) as error:
        return {**DEFAULTS, "error": f"{type(error).__name__}: {error}"}
