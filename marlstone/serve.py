"""HTTP in front of anything that has ``handle(method, path, body, query)``: a node or a proxy."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

#: Bytes of a request's body at most.
MOST_BODY = 64 << 20


def server(target, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that isn't started yet; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            url = urlsplit(self.path)
            try:
                if length > MOST_BODY:
                    raise ValueError("the body is too long")
                body = json.loads(self.rfile.read(length)) if length else {}
                if not isinstance(body, dict):
                    raise ValueError("the body must be an object")
            except ValueError as e:
                status, answer = 400, {"error": f"invalid JSON: {e}"}
            else:
                status, answer = target.handle(self.command, unquote(url.path), body, dict(parse_qsl(url.query)))
            raw = json.dumps(answer, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_PUT = do_POST = do_DELETE = _answer  # noqa: N815

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
