"""SQL text of column expressions, from which functions with a SQL body are made."""

from __future__ import annotations

from pyspark.sql import Column

_INFIX = {"+", "-", "*", "/", "%", "=", "<=>", "<", "<=", ">", ">=", "and", "or"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _literal(node) -> str:
    value = node.value()
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0")
        return f"'{escaped}'"
    kind = node.dataType().get().typeName() if node.dataType().isDefined() else ""
    return f"{value!r}{'D' if isinstance(value, float) else 'L' if kind == 'long' else ''}"


def _function(node) -> str:
    name, args = node.functionName(), [_node(a) for a in _items(node.arguments())]
    low = name.lower()
    if low in _INFIX and len(args) == 2:
        return f"({args[0]} {low} {args[1]})"
    if low in ("!", "not") and len(args) == 1:
        return f"(NOT {args[0]})"
    if low in ("-", "negative") and len(args) == 1:
        return f"(- {args[0]})"
    if low == "in":
        return f"({args[0]} IN ({', '.join(args[1:])}))"
    if low == "when":
        cases = [f"WHEN {args[i]} THEN {args[i + 1]}" for i in range(0, len(args) - 1, 2)]
        return f"(CASE {' '.join(cases)}{' ELSE ' + args[-1] if len(args) % 2 else ''} END)"
    return f"{name}({', '.join(args)})"


def _node(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        return _literal(node)
    if kind == "UnresolvedAttribute":
        return ".".join(f"`{x}`" for x in _items(node.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return f"`{node.name()}`"
    if kind == "LambdaFunction":
        names = [f"`{a.name()}`" for a in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_node(node.function())}"
    if kind == "CaseWhenOtherwise":
        cases = [f"WHEN {_node(b._1())} THEN {_node(b._2())}" for b in _items(node.branches())]
        other = node.otherwise()
        return f"(CASE {' '.join(cases)}{' ELSE ' + _node(other.get()) if other.isDefined() else ''} END)"
    if kind == "Cast":
        return f"CAST({_node(node.child())} AS {node.dataType().sql()})"
    if kind == "UnresolvedExtractValue":
        return f"{_node(node.child())}[{_node(node.extraction())}]"
    if kind == "Alias":
        return _node(node.child())
    if kind == "UnresolvedFunction":
        return _function(node)
    raise ValueError(f"no SQL text for {kind}")


def sql_text(column: Column) -> str:
    return _node(column._jc.node())
