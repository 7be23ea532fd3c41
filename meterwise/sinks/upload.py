"""Landed shipments sent on to a service over HTTPS: a bearer token by client credentials, then a multipart post of each tarball.

Tasks send the tarballs that count, so their number and size do not pass the driver. A shipment is marked when all of its
tarballs are accepted, and then never sent again; a tarball whose task was repeated may arrive twice, under the same name.
"""

from __future__ import annotations

import json
import ssl
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from urllib import error, parse, request

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import BadSetting, MissingSetting
from . import commits
from .commits import day_folder
from .files import create_text, file_system, names_in

#: Tarballs that a task sends one after another, and characters of an answer that are kept.
TASK_FILES, ANSWER = 16, 500


class UploadFailed(RuntimeError):
    """Tarballs were not accepted; their shipments are sent again by the next upload."""


@dataclass(frozen=True)
class Endpoint:
    """A service: where to post, where to get a token and for whom. Without token_url no token is asked for. certificate is a file
    of trusted authorities, proxy the URL of a proxy for HTTPS; seconds bounds each request."""

    upload_url: str
    token_url: str = ""
    client_id: str = ""
    content_type: str = "application/gzip"
    proxy: str = ""
    certificate: str = ""
    seconds: float = 31.0

    @classmethod
    def of(cls, text: str) -> Endpoint:
        try:
            found = cls(**json.loads(text))
        except TypeError as wrong:
            raise BadSetting(f"settings of an endpoint: {wrong}") from None
        if found.token_url and not found.client_id:
            raise MissingSetting("an endpoint with token_url needs client_id")
        return found

    def opener(self) -> request.OpenerDirector:
        context = ssl.create_default_context(cafile=self.certificate or None)
        return request.build_opener(request.HTTPSHandler(context=context), request.ProxyHandler({"https": self.proxy} if self.proxy else {}))

    def token(self, opener: request.OpenerDirector, secret: str) -> str:
        form = {"client_id": self.client_id, "client_secret": secret, "grant_type": "client_credentials"}
        with opener.open(request.Request(self.token_url, parse.urlencode(form).encode()), timeout=self.seconds) as answer:
            return json.load(answer)["access_token"]

    def post(self, opener: request.OpenerDirector, token: str, name: str, data: bytes) -> tuple[int, str]:
        """The status and the beginning of the answer; a status below 300 is acceptance."""
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: {self.content_type}\r\n\r\n'
        headers = {"Content-Type": f"multipart/form-data; boundary={mark}"} | ({"Authorization": f"Bearer {token}"} if token else {})
        try:
            with opener.open(request.Request(self.upload_url, head.encode() + data + f"\r\n--{mark}--\r\n".encode(), headers), timeout=self.seconds) as answer:
                return answer.status, answer.read(ANSWER).decode("utf-8", "replace")
        except error.HTTPError as refused:
            return refused.code, refused.read(ANSWER).decode("utf-8", "replace")


def pending(spark: SparkSession, path: str, table: str, days: Sequence[date]) -> DataFrame:
    """(install_uuid, shipment, file) of the tarballs that count on some days and whose shipments are not marked as sent."""
    _, root = file_system(path)
    sent, rows = {}, []
    for day, folder in commits.live_folders(path, days, table).items():
        for (install, shipment, _), files in folder.live.items():
            if install not in sent:
                sent[install] = set(names_in(f"{path.rstrip('/')}/sent/{install}"))
            if f"{shipment}.json" not in sent[install]:
                rows += [(install, shipment, f"{day_folder(root, day)}/{f}") for f in files]
    return spark.createDataFrame(rows, "install_uuid string, shipment string, file string")


def send(files: DataFrame, path: str, endpoint: Endpoint, secret: str = "") -> DataFrame:
    """files with the status and the answer of the service when evaluated; a task asks for one token. A service that cannot be
    reached fails the task, which Spark repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, opener, token = file_system(path)[0], endpoint.opener(), None
        for batch in batches:
            answers = []
            for file in batch.column("file").to_pylist():
                if token is None:
                    token = endpoint.token(opener, secret) if endpoint.token_url else ""
                with where.open_input_file(file) as source:
                    answers.append(endpoint.post(opener, token, file.rpartition("/")[2], source.read()))
            yield batch.append_column("status", pa.array([a[0] for a in answers], pa.int32())).append_column("answer", pa.array([a[1] for a in answers], pa.string()))

    return files.mapInArrow(run, "install_uuid string, shipment string, file string, status int, answer string")


def upload(spark: SparkSession, path: str, table: str, days: Sequence[date], endpoint: Endpoint, secret: str = "") -> int:
    """Sends the pending tarballs of some days and marks the shipments that are accepted whole; how many tarballs were sent. Raises
    UploadFailed after all have been tried if some were refused."""
    from ..operators.components import checkpointed

    files = pending(spark, path, table, days)
    tasks = max(1, -(-files.count() // TASK_FILES))
    results = checkpointed(send(files.repartition(tasks, "file"), path, endpoint, secret))  # so that nothing is sent twice
    refused = F.count_if(F.col("status") >= 300).alias("refused")
    for r in results.groupBy("install_uuid", "shipment").agg(refused, F.count("*").alias("files")).where("refused = 0").toLocalIterator():
        create_text(f"{path.rstrip('/')}/sent/{r.install_uuid}/{r.shipment}.json", json.dumps({"table": table, "files": r.files}))
    first = results.where("status >= 300").select("file", "status", "answer").first()
    if first:
        raise UploadFailed(f"{first.file}: status {first.status}, {first.answer}")
    return results.count()
