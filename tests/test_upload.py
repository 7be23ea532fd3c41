"""Uploads to a service that runs beside the test."""

import json
import re
import threading
from datetime import date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest

from meterwise import cli
from meterwise.options import BadSetting, MissingSetting
from meterwise.plans import gather
from meterwise.sinks import landing
from meterwise.sinks.commits import Span
from meterwise.sinks.upload import Endpoint, UploadFailed, pending, upload

DAY = datetime(2024, 1, 1)


@pytest.fixture
def service():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if self.path == "/token":
                form = parse_qs(body.decode())
                self.server.tokens.append(form)
                self.answer(200 if form["client_secret"] == ["s3"] else 401, b'{"access_token": "T"}')
                return
            name = re.search(rb'filename="(.*?)"\r\nContent-Type: (.*?)\r\n\r\n(.*)\r\n--', body, re.S)
            refused = self.headers["Authorization"] != "Bearer T" or any(x in name[1].decode() for x in self.server.refuse)
            if not refused:
                self.server.got[name[1].decode()] = name[3]
            self.answer(413 if refused else 202, b"no" if refused else b"ok")

        def answer(self, status, text):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.tokens, server.got, server.refuse = [], {}, []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_shipments_are_sent_once(spark, tmp_path, service, monkeypatch, capsys):
    path, at = str(tmp_path / "landed"), f"http://127.0.0.1:{service.server_address[1]}"
    rows = spark.range(12).selectExpr("CAST(id AS string) AS id", "concat('h', id) AS host_name", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id * 4 AS int)) AS modified")
    for install in ("i", "j"):
        landing.ship_slices(gather.sliced(rows, "modified", DAY, DAY + timedelta(days=2)), path, "job_host_summary", install, rows=3, covers=[Span(DAY, DAY + timedelta(days=2))])
    days = [date(2024, 1, 1), date(2024, 1, 2)]
    endpoint = Endpoint(f"{at}/upload", f"{at}/token", "me")
    service.refuse.append("j-2024-01-02")
    n = pending(spark, path, "job_host_summary", days).count()
    with pytest.raises(UploadFailed, match="413, no"):
        upload(spark, path, "job_host_summary", days, endpoint, "s3")
    assert {r.install_uuid for r in pending(spark, path, "job_host_summary", days).collect()} == {"j"}
    service.refuse.clear()
    before = len(service.got)
    (tmp_path / "endpoint.json").write_text(json.dumps({"upload_url": endpoint.upload_url, "token_url": endpoint.token_url, "client_id": "me"}))
    monkeypatch.setenv("METERWISE_CLIENT_SECRET", "s3")
    assert cli.main(["upload", "job_host_summary", "--path", path, "--endpoint", str(tmp_path / "endpoint.json"), "--since", "2024-01-01", "--until", "2024-01-02"]) == 0
    assert "files sent" in capsys.readouterr().out and len(service.got) == n > before and service.tokens[0]["grant_type"] == ["client_credentials"]
    for file in (tmp_path / "landed").glob("data/*/*/*/*.tar.gz"):
        assert service.got[file.name] == file.read_bytes()
    assert upload(spark, path, "job_host_summary", days, endpoint, "s3") == 0
    with pytest.raises(Exception, match="401"):
        landing.ship_slices(gather.sliced(rows, "modified", DAY, DAY + timedelta(days=2)), path, "job_host_summary", "k", covers=[Span(DAY, DAY + timedelta(days=2))])
        upload(spark, path, "job_host_summary", days, endpoint, "wrong")


def test_endpoints():
    with pytest.raises(MissingSetting):
        Endpoint.of('{"upload_url": "u", "token_url": "t"}')
    with pytest.raises(BadSetting):
        Endpoint.of('{"where": "u"}')
