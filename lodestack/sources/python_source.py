"""Python files as units: the module's docstring, classes and their methods, functions."""

from __future__ import annotations

import ast

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _first_line(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def _unit(lines: list[str], node: ast.stmt, last: int, kind: str, **locator) -> list[tuple]:
    text = "\n".join(lines[_first_line(node) - 1 : last])
    if not text.strip():
        return []
    return [(text, kind, {"name": node.name, "lineno": node.lineno, **locator}, {"docstring": ast.get_docstring(node) or ""})]


def _header_end(node: ast.ClassDef) -> int:
    """Last line of a class's signature, with its docstring if it has one."""
    first = node.body[0]
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return first.end_lineno
    return max(_first_line(node), first.lineno - 1)


def units(source: str) -> list[tuple]:
    """(text, unit_type, locator, extra); the whole source where it doesn't parse or defines nothing.

    A class with methods gives its header and each method; its attributes, nested classes and statements
    outside definitions are left out.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [(source, "raw_python", {"reason": "syntax_error"}, {})]
    lines, out = source.splitlines(), []
    if doc := ast.get_docstring(tree):
        out.append((doc, "module_docstring", {"lineno": 1}, {}))
    for node in tree.body:
        if isinstance(node, DEFS):
            out += _unit(lines, node, node.end_lineno, "function")
        elif isinstance(node, ast.ClassDef):
            methods = [x for x in node.body if isinstance(x, DEFS)]
            out += _unit(lines, node, _header_end(node) if methods else node.end_lineno, "class")
            for m in methods:
                out += _unit(lines, m, m.end_lineno, "function", class_name=node.name)
    return out or [(source, "raw_python", {"reason": "no_top_level_defs"}, {})]
