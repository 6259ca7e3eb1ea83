"""An engine behind HTTP, for clients that aren't Spark programs.

GET /status; GET /load?uris=&collection=&delta=&from=&to=&store=, POST /load with
an Arrow IPC stream, DELETE /load?collection=; GET and DELETE /index; GET
/points?collection=&bounds=&p=&budget= gives an Arrow IPC stream. Executors are
the cluster's business, so /workers lists none and takes none.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from ..sources.ipc import send_stream
from .engine import Engine, NotFound

STREAM = "application/vnd.apache.arrow.stream"
#: Bytes of a request's body at most.
BODY = 1 << 30


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, not yet running; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _answer(self, code: int, body=b"", kind: str = "application/json") -> None:
            body = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _stream(self, df: DataFrame) -> None:
            """The rows as an Arrow IPC stream, batch by batch; the connection's end is the stream's."""
            self.send_response(200)
            self.send_header("Content-Type", STREAM)
            self.send_header("Connection", "close")
            self.end_headers()
            send_stream(df, self.wfile)
            self.close_connection = True

        def _do(self) -> None:
            url = urlsplit(self.path)
            q = {k: v[-1] for k, v in parse_qs(url.query).items()}
            routes = {
                ("GET", "/status"): lambda: engine.status(),
                ("GET", "/workers"): lambda: [],
                ("GET", "/load"): lambda: self._load(q),
                ("POST", "/load"): lambda: self._push(q),
                ("DELETE", "/load"): lambda: engine.drop(q.get("collection", "default")),
                ("GET", "/index"): lambda: engine.build_index(q.get("collection", "default")) and None,
                ("DELETE", "/index"): lambda: engine.drop_index(q.get("collection")),
                ("GET", "/points"): lambda: self._points(q),
            }
            run = routes.get((self.command, url.path))
            try:
                if run is None:
                    raise NotFound(url.path)
                out = run()
                if isinstance(out, DataFrame):
                    self._stream(out)
                else:
                    self._answer(200, out)
            except BrokenPipeError:  # the client has gone
                self.close_connection = True
            except NotFound as e:
                self._answer(404, {"error": f"not found: {e.args[0]}"})
            except (ValueError, KeyError) as e:
                self._answer(400, {"error": str(e)})
            except Exception as e:  # whatever Spark raises is the server's fault
                self._answer(500, {"error": str(e)[:2000]})

        do_GET = do_POST = do_DELETE = _do

        def _load(self, q: dict) -> None:
            engine.load(q["uris"], q.get("collection", "default"), q.get("delta"), float(q.get("from", 0)), float(q.get("to", 1)), store=q.get("store"))

        def _push(self, q: dict) -> None:
            size = int(self.headers.get("Content-Length", 0))
            if size > BODY:
                raise ValueError(f"a body has {BODY} bytes at most")
            engine.append(self.rfile.read(size), q.get("collection", "default"), q.get("delta"))

        def _points(self, q: dict) -> DataFrame:
            p, budget = q.get("p"), q.get("budget")
            return engine.points(q.get("bounds"), float(p) if p else None, q.get("collection", "default"), int(budget) if budget else None)

    return ThreadingHTTPServer((host, port), Handler)
