"""JSON inside text: objects in a model's answer, cut ones repaired, and every string of a tree."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any


def _loads(text: str) -> tuple[bool, Any]:
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def _strip_fence(text: str) -> str:
    inside = re.search(r"```[A-Za-z]*\s*\n?(.*?)(?:```|\Z)", text, re.S)
    return inside[1] if inside and "{" in inside[1] else text


def _closed(text: str) -> str | None:
    """A cut object, ended after its last complete value: containers still open there are closed."""
    stack: list[str] = []
    last: tuple[int, str] | None = None  # where a value ended, and what closes the containers open there
    in_string = escaped = False
    is_key = False

    def mark(end: int) -> None:
        nonlocal last
        last = (end, "".join(reversed(stack)))

    i = 0
    while i < len(text):
        c = text[i]
        if in_string:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                in_string = False
                after = re.compile(r"\s*(.?)", re.S).match(text, i + 1)[1]
                is_key = bool(stack) and stack[-1] == "}" and after in (":", "") and _expects_key(text, i)
                if not is_key:
                    mark(i + 1)
        elif c == '"':
            in_string = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            mark(i + 1)
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            mark(i + 1)
            if not stack:
                return text[: i + 1]
        else:
            scalar = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null").match(text, i)
            if scalar:
                if scalar.end() < len(text):  # a number at the very end may go on
                    mark(scalar.end())
                i = scalar.end()
                continue
        i += 1
    return text[: last[0]] + last[1] if last else None


def _expects_key(text: str, end: int) -> bool:
    """Whether the string that ends at end stands where an object's key does."""
    start = end - 1
    while start >= 0 and not (text[start] == '"' and (len(text[:start]) - len(text[:start].rstrip("\\"))) % 2 == 0):
        start -= 1
    return text[:start].rstrip()[-1:] in ("{", ",")


def extract_json(text: str | None) -> Any:
    """The object in a text: as it is, inside a fence or between braces, else a cut one repaired; null for none."""
    t = (text or "").strip()
    for candidate in (t, _strip_fence(t).strip()):
        ok, value = _loads(candidate)
        if ok and isinstance(value, (dict, list)):
            return value
        start = candidate.find("{")
        if start < 0:
            continue
        end = candidate.rfind("}")
        ok, value = _loads(candidate[start : end + 1]) if end > start else (False, None)
        if ok:
            return value
        fixed = _closed(candidate[start:])
        ok, value = _loads(fixed) if fixed else (False, None)
        if ok:
            return value
    return None


def strings(tree: Any, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, string) of every string value of a tree; keys are not values."""
    if isinstance(tree, str):
        yield path, tree
    elif isinstance(tree, dict):
        for k, v in tree.items():
            yield from strings(v, (*path, k))
    elif isinstance(tree, list):
        for i, v in enumerate(tree):
            yield from strings(v, (*path, i))


def replaced(tree: Any, new: Callable[[tuple, str], str], path: tuple = ()) -> Any:
    """The tree with each string value replaced."""
    if isinstance(tree, str):
        return new(path, tree)
    if isinstance(tree, dict):
        return {k: replaced(v, new, (*path, k)) for k, v in tree.items()}
    if isinstance(tree, list):
        return [replaced(v, new, (*path, i)) for i, v in enumerate(tree)]
    return tree


def decoded_strings(text: str, depth: int = 4) -> Iterator[str]:
    """A text; or, where it is JSON, the strings of it (keys too), each decoded again as far as depth goes."""
    ok, tree = _loads(text) if depth > 0 and text.lstrip()[:1] in ("{", "[", '"') else (False, None)
    if not ok:
        yield text
        return
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            yield from decoded_strings(node, depth - 1)
        elif isinstance(node, dict):
            for k, v in reversed(node.items()):
                stack += [v, k]
        elif isinstance(node, list):
            stack += reversed(node)


def readable(text: str) -> str:
    """The strings of a JSON text, keys and values, a line each; any other text as it is."""
    return "\n".join(decoded_strings(text, 1))
