import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from quarry import library as L
from quarry import serve
from tests.test_library import ROWS
from tests.test_zim import build


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("serve")
    (d / "a.zim").write_bytes(build(ROWS, 5))
    L.build(spark, [str(d / "a.zim")], str(d / "t"))
    return L.Library(spark, str(d / "t"))


def ask(method, **params):
    return {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}


def test_requests(lib):
    s = serve.Server(lib)
    get = lambda method, **p: s.handle(ask(method, **p))["result"]
    assert get("initialize")["serverInfo"]["name"] == "quarry" and get("ping") == {}
    assert len(get("tools/list")["tools"]) == 8 and all(t["description"] for t in get("tools/list")["tools"])
    found = get("tools/call", name="search", arguments={"query": "yellow"})
    assert not found["isError"] and found["structuredContent"]["rows"][0]["path"] == "Banana" and "Banana" in found["content"][0]["text"]
    assert get("tools/call", name="outline", arguments={"archive": "fruit_en", "path": "Apple"})["structuredContent"]["rows"][1]["title"] == "Growing"
    for args in ({"archive": "none", "path": "x"}, {"path": "x"}, {"archive": "fruit_en", "path": "Apple", "more": 1}):
        bad = get("tools/call", name="read_article", arguments=args)
        assert bad["isError"] and bad["content"][0]["text"].startswith("error: ")
    assert get("resources/list")["resources"][0]["uri"] == "zim://fruit_en" and len(get("resources/templates/list")["resourceTemplates"]) == 3
    assert "An apple" in get("resources/read", uri="zim://fruit_en/Apple")["contents"][0]["text"]
    for request, code in ((ask("nothing"), -32601), (ask("tools/call", name="nothing"), -32602), (ask("resources/read", uri="zim://fruit_en/No"), -32002), ([], -32600)):
        assert s.handle(request)["error"]["code"] == code
    assert s.handle({"method": "notifications/initialized"}) is None and json.loads(s.handle_text("{"))["error"]["code"] == -32700


def test_stdio(lib):
    out = io.StringIO()
    serve.run_stdio(lib, io.StringIO(json.dumps(ask("ping")) + "\n\n" + json.dumps({"method": "notifications/x"}) + "\n" + json.dumps(ask("tools/list")) + "\n"), out)
    assert len(out.getvalue().splitlines()) == 2


def test_http(lib):
    with pytest.raises(L.Invalid):
        serve.http_server(lib, "0.0.0.0")
    server = serve.http_server(lib, token="secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(request, token="secret", path="/mcp"):
        r = urllib.request.Request(base + path, json.dumps(request).encode(), {"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, f.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    try:
        with urllib.request.urlopen(base + "/healthz") as f:
            assert json.load(f) == {"ok": True, "archives": 1}
        assert json.loads(post(ask("ping"))[1])["result"] == {} and post({"method": "notifications/x"})[0] == 202
        assert post(ask("ping"), "wrong")[0] == post(ask("ping"), None)[0] == 401 and post(ask("ping"), path="/other")[0] == 404
        refused = json.loads(post(ask("tools/call", name="archive_health", arguments={"verify": "full"}))[1])["result"]
        assert refused["isError"] and "switched off" in refused["content"][0]["text"]
    finally:
        server.shutdown()
        server.server_close()
        lib.full_verify = True
