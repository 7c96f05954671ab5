"""Requests as JSON lines answered over a built map."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame

from quarrydeck.sources import snapshots

from .code_map import CodeMap

MAX_LINE = 4 << 20


#: Rows of a page of an answer.
PAGE = 200


def _page(df, order: list[str], p: dict) -> dict:
    """One page of rows in a total order, with the number of all; the next page begins at ``offset`` + the rows shown."""
    at, most = max(0, int(p.get("offset", 0))), max(1, min(PAGE, int(p.get("limit", PAGE))))
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).offset(at).limit(most).collect()]
    return {"rows": rows, "total": df.count(), "offset": at}


def methods(m: CodeMap) -> dict[str, Callable[[dict], Any]]:
    return {
        "map.render": lambda p: _page(m.top(int(p.get("count", 20))).select("rank", "path", "score"), ["rank"], p),
        "map.status": lambda p: {"files": m.files.count(), "parsed": m.parsed.count(), "symbols": m.symbols.count(), "edges": m.edges.count()},
        "map.find": lambda p: _page(m.find(p["name"], p.get("kind"), p.get("file")), ["rank"], p),
        "map.context": lambda p: _page(m.context(p["name"]), ["line"], p),
        "map.impact": lambda p: _page(m.impact(p["path"]), ["path"], p),
        "map.explain": lambda p: _page(m.explain(p["path"]), ["component"], p),
        "map.queue": lambda p: _page(m.read_queue(), ["priority"], p),
        "map.task": lambda p: _page(m.task(p["goal"]), ["rank"], p),
    }


def answer(m: CodeMap, lines: Iterable[str], current: Callable[[CodeMap], CodeMap] | None = None) -> Iterator[str]:
    """One JSON-RPC answer for each request line; bad requests get an error and the loop goes on.

    Before each answer ``current`` may give another map in place of one whose files have changed (see ``rebuilt``).
    """
    known = methods(m)
    for line in lines:
        if current is not None and (now := current(m)) is not m:
            m, known = now, methods(now)
        number = None
        try:
            if len(line) > MAX_LINE:
                raise ValueError("the line is too long")
            request = json.loads(line)
            number = request.get("id")
            if request.get("method") not in known:
                out: dict[str, Any] = {"error": {"code": -32601, "message": "no such method"}}
            else:
                out = {"result": known[request["method"]](request.get("params") or {})}
        except KeyError as e:
            out = {"error": {"code": -32602, "message": f"missing parameter {e}"}}
        except (ValueError, AttributeError) as e:
            out = {"error": {"code": -32700, "message": str(e)}}
        yield json.dumps({"jsonrpc": "2.0", "id": number, **out}, default=str)


def rebuilt(listing: Callable[[], DataFrame], build: Callable[[DataFrame], CodeMap]) -> Callable[[CodeMap], CodeMap]:
    """A check for ``answer``: the map itself while all (path, sha256) of the listing are its own, else one built anew."""

    def current(m: CodeMap) -> CodeMap:
        now = listing()
        stale = not snapshots.status(m.files, now).where("status <> 'fresh'").isEmpty()
        return build(now) if stale else m

    return current
