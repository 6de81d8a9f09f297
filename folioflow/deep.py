"""Work whose calls nest as deeply as its text, on a stack of its own; JSON of any depth."""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable
from json.scanner import py_make_scanner
from typing import Any

#: Bytes of the stack (reserved, used as far as a text nests).
STACK = 256 << 20


def on_deep_stack(work: Callable[[], Any], size: int) -> Any:
    """work(), on a thread with room for the calls that a text of `size` characters can nest (no level has fewer than three)."""
    done: list[Any] = []
    failed: list[BaseException] = []

    def run() -> None:
        try:
            done.append(work())
        except BaseException as e:
            failed.append(e)

    limit, stack = sys.getrecursionlimit(), threading.stack_size(STACK)
    try:
        sys.setrecursionlimit(max(limit, 1000 + 4 * size))
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        sys.setrecursionlimit(limit)
        threading.stack_size(stack)
    if failed:
        raise failed.pop()
    return done.pop()


class _Decoder(json.JSONDecoder):
    """The library's decoder in Python alone: the one in C has a fixed depth."""

    def __init__(self) -> None:
        super().__init__()
        self.parse_object, self.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
        self.scan_once = py_make_scanner(self)


def loads(s: str) -> Any:
    try:
        return json.loads(s)
    except RecursionError:
        return on_deep_stack(lambda: _Decoder().decode(s), len(s))


#: Trees hold no cycles, so nothing looks for them.
_compact = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":")).encode


class _Mark(str):
    """What is put out as it stands."""

    __slots__ = ()


def dumps(x: Any) -> str:
    """Compact JSON."""
    try:
        return _compact(x)
    except RecursionError:
        pass
    out: list[str] = []
    todo = [x]
    while todo:
        x = todo.pop()
        if isinstance(x, _Mark):
            out.append(x)
        elif isinstance(x, dict) and x:
            todo.append(_Mark("}"))
            for k, v in reversed(x.items()):
                todo += v, _Mark(_compact(k) + ":"), _Mark(",")
            todo[-1] = _Mark("{")
        elif isinstance(x, (list, tuple)) and x:
            todo.append(_Mark("]"))
            for v in reversed(x):
                todo += v, _Mark(",")
            todo[-1] = _Mark("[")
        else:
            out.append(_compact(x))
    return "".join(out)
