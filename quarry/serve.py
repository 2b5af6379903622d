"""The library as a server: JSON-RPC 2.0 requests for tools and resources, line by line on standard streams or by HTTP.

A tool is a method of Library; its result goes out as text and as structure, and an error of the library as a tool's error. Spark
plans and runs each request; the server only translates.
"""

from __future__ import annotations

import hmac
import ipaddress
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, Any

from quarry import library as L

PROTOCOL = "2025-06-18"
_TEXT, _NUMBER, _FLAG, _TEXTS = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}, {"type": "array", "items": {"type": "string"}}


class Server:
    """Answers requests over one library."""

    def __init__(self, library: L.Library):
        self.library = library
        one = {"archive": _TEXT, "path": _TEXT}
        search = {"query": _TEXT, "archives": _TEXTS, "mode": {"enum": list(L.MODES)}, "limit": _NUMBER, "cursor": _TEXT, "snippet_chars": _NUMBER, "min_score": {"type": "number"}, "or_fallback": _FLAG}
        context = {"query": _TEXT, "archives": _TEXTS, "budget_chars": _NUMBER, "per_hit_chars": _NUMBER, "max_hits": _NUMBER}
        article = {**one, "form": {"enum": ["markdown", "text"]}, "max_chars": _NUMBER, "offset": _NUMBER, "section": _TEXT}
        #: name: (method, rendering, properties, required ones)
        self.tools = {
            "list_archives": (library.list_archives, L.render_archives, {"term": _TEXT}, []),
            "search": (library.search, L.render_search, search, ["query"]),
            "read_article": (library.read_article, L.render_article, article, ["archive", "path"]),
            "outline": (library.outline, L.render_outline, one, ["archive", "path"]),
            "suggest": (library.suggest, L.render_suggest, {"prefix": _TEXT, "archives": _TEXTS, "limit": _NUMBER}, ["prefix"]),
            "context": (library.context, L.render_context, context, ["query"]),
            "links": (library.links, L.render_links, {**one, "limit": _NUMBER, "offset": _NUMBER}, ["archive", "path"]),
            "archive_health": (library.health, L.render_health, {"archive": _TEXT, "verify": {"enum": ["none", "quick", "full"]}}, []),
        }

    def call(self, name: str, arguments: dict) -> dict:
        if name not in self.tools:
            raise KeyError(name)
        method, render, properties, required = self.tools[name]
        missing, unknown = [k for k in required if k not in arguments], [k for k in arguments if k not in properties]
        try:
            if missing or unknown:
                raise L.Invalid(f"missing {missing}, unknown {unknown}")
            page = method(**{k: v for k, v in arguments.items() if v is not None})
        except L.LibraryError as e:
            return {"content": [{"type": "text", "text": f"error: {type(e).__name__}: {e}"}], "isError": True}
        return {"content": [{"type": "text", "text": render(page)}], "structuredContent": json.loads(page.to_json()), "isError": False}

    def _answer(self, method: str, params: dict) -> Any:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "serverInfo": {"name": "quarry", "version": "1"}, "capabilities": {"tools": {}, "resources": {}}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": (m.__doc__ or n).strip().split("\n")[0], "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (m, _, p, r) in self.tools.items()]}
        if method == "tools/call":
            return self.call(params["name"], params.get("arguments") or {})
        page = self.library.list_resources()
        if method == "resources/list":
            return {"resources": [{"uri": r["uri"], "name": r["name"], "mimeType": r["mime"]} for r in page.rows]}
        if method == "resources/templates/list":
            return {"resourceTemplates": [{"uriTemplate": t, "name": t} for t in page.more["templates"]]}
        if method == "resources/read":
            return {"contents": [{"uri": params["uri"], "text": self.library.read_resource(params["uri"])}]}
        raise LookupError(method)

    def handle(self, request: Any) -> dict | None:
        """The answer to one request; null for a notification."""
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return _error(None, -32600, "no request")
        number, params = request.get("id"), request.get("params") or {}
        try:
            result = self._answer(request["method"], params)
        except LookupError as e:  # a method or tool that there is not, or a parameter that is missing
            return _error(number, -32601 if not isinstance(e, KeyError) else -32602, f"unknown or missing: {e}") if number is not None else None
        except L.LibraryError as e:
            return _error(number, -32002, f"{type(e).__name__}: {e}") if number is not None else None
        return {"jsonrpc": "2.0", "id": number, "result": result} if number is not None else None

    def handle_text(self, text: str | bytes) -> str | None:
        try:
            request = json.loads(text)
        except ValueError as e:
            return json.dumps(_error(None, -32700, str(e)))
        answer = self.handle(request)
        return None if answer is None else json.dumps(answer, ensure_ascii=False, default=str)


def _error(number, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def run_stdio(library: L.Library, source: IO[str], out: IO[str]) -> None:
    """A request a line, until the other side ends."""
    server = Server(library)
    for line in source:
        if line.strip() and (answer := server.handle_text(line)) is not None:
            out.write(answer + "\n")
            out.flush()


def http_server(library: L.Library, host: str = "127.0.0.1", port: int = 0, token: str | None = None, path: str = "/mcp") -> ThreadingHTTPServer:
    """Requests by POST to `path`, behind a bearer token if there is one, and an open GET /healthz. Other machines are served with a token only.

    Full verification reads whole archives on request; it is switched off here.
    """
    try:
        local = host == "localhost" or ipaddress.ip_address(host).is_loopback
    except ValueError:
        local = False
    if not local and not token:
        raise L.Invalid(f"{host} is open to other machines: set a token")
    library.full_verify = False
    server = Server(library)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: str, **headers: str) -> None:
            data = body.encode()
            self.send_response(code)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(data)), **headers}.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/healthz":
                self._send(200, json.dumps({"ok": True, "archives": len(library.rows)}))
            else:
                self._send(404, "{}")

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            given = (self.headers.get("Authorization") or "").removeprefix("Bearer ").strip()
            if token and not hmac.compare_digest(given.encode(), token.encode()):
                self._send(401, '{"error": "send Authorization: Bearer <token>"}', WWW_Authenticate="Bearer")
            elif self.path != path:
                self._send(404, "{}")
            else:
                answer = server.handle_text(body)
                self._send(202 if answer is None else 200, answer or "")

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
