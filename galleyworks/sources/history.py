"""Paginated histories as a Spark data source, in batches or as a stream, and the sinks that submit links."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit
from urllib.request import Request, urlopen

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from galleyworks.functions.client import MOST_LINKS

SCHEMA = "start string, page int, body string, error string"


def with_offset(url: str, offset) -> str:
    parts = urlsplit(url)
    return urlunsplit(parts._replace(query=urlencode(dict(parse_qsl(parts.query, keep_blank_values=True)) | {"offset": str(offset)})))


#: Seconds from one round of a watcher to the next, and the least that is allowed.
INTERVAL, LEAST_INTERVAL = 1800, 60


class HistorySource(DataSource):
    """`history`: pages of histories, as rows of SCHEMA. Options: starts (a JSON array of addresses), headers (a JSON object), max_pages (of a round), timeout, pause (seconds between pages).

    One partition a start, as a page's successor is known from the page alone. A start ends at its last page, where the
    next offset is missing, empty or the same; a page that fails comes as a row with its error and ends its start.

    As a stream a round is read after another, a batch `batch_pages` pages of each start, and a round begins `interval` seconds (LEAST_INTERVAL at least) after the one before it has ended,
    also if it has ended in an error: then the error is a row, and the query goes on. More options: positions (a folder that driver and executors share),
    rounds (0 for no end). An offset counts the batches of each start. Where a batch begins is written below `positions` by the batch before it, so
    that a restart resumes with the page at which the query was; a batch that is read again after a failure begins at the same page.
    """

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return HistoryStreamReader(self.options)


class Pages:
    """How pages are asked for."""

    def __init__(self, options: dict[str, str]):
        self.starts = list(dict.fromkeys(json.loads(options["starts"])))
        self.headers = {k: str(v) for k, v in json.loads(options.get("headers", "{}")).items() if v is not None}
        self.max_pages, self.timeout, self.pause = int(options.get("max_pages", 1)), float(options.get("timeout", 20)), float(options.get("pause", 1))

    def chain(self, start: str, page: int, offset, end: int) -> Iterator[tuple[tuple, object]]:
        """(row, next offset) of the pages from `page` on, before `end`; the offset is None after the last page and after an error."""
        while page < end:
            try:
                request = Request(start if offset is None else with_offset(start, offset), headers=self.headers)
                with urlopen(request, timeout=self.timeout) as answer:
                    body = answer.read().decode("utf-8", "replace")
                data = json.loads(body)
            except (OSError, ValueError) as e:
                yield (start, page, None, str(e)), None
                return
            following = data.get("next_offset") if isinstance(data, dict) else None
            last = following in (None, "", offset) or page + 1 >= self.max_pages
            yield (start, page, body, None), None if last else following
            if last:
                return
            page, offset = page + 1, following
            if page < end:
                time.sleep(self.pause)


class HistoryReader(Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(start) for start in self.starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row, _ in self.chain(partition.value, 0, None, self.max_pages):
            yield row


class Positions:
    """Small JSON documents by (start, number) in a folder; one appears whole or not at all."""

    def __init__(self, uri: str):
        self.files, self.base = fs.FileSystem.from_uri(uri)

    def _folder(self, start: str) -> str:
        return f"{self.base}/{hashlib.sha256(start.encode()).hexdigest()[:32]}"

    def numbers(self, start: str) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(self._folder(start), allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def read(self, start: str, number: int) -> dict:
        with self.files.open_input_stream(f"{self._folder(start)}/{number}") as f:
            return json.loads(f.read())

    def write(self, start: str, number: int, value: dict) -> None:
        folder = self._folder(start)
        self.files.create_dir(folder, recursive=True)
        with self.files.open_output_stream(temporary := f"{folder}/{uuid.uuid4().hex}.tmp") as f:
            f.write(json.dumps(value).encode())
        self.files.move(temporary, f"{folder}/{number}")

    def forget(self, start: str, before: int) -> None:
        for n in self.numbers(start):
            if n < before:
                self.files.delete_file(f"{self._folder(start)}/{n}")


class HistoryStreamReader(Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.uri, self.rounds, self.batch_pages = options["positions"], int(options.get("rounds", 0)), max(1, int(options.get("batch_pages", 1)))
        self.interval = max(LEAST_INTERVAL, float(options.get("interval", INTERVAL)))

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.starts, 0)

    def latestOffset(self) -> dict:
        """For each start the batch after the newest one whose beginning is known, if its time has come."""
        known, out = Positions(self.uri), {}
        for start in self.starts:
            newest = max(known.numbers(start), default=0)
            at = known.read(start, newest) if newest else {"round": 0, "not_before": 0}
            due = time.time() >= at["not_before"] and not (self.rounds and at["round"] >= self.rounds)
            out[start] = newest + due
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((s, n)) for s in self.starts for n in range(start.get(s, 0), end.get(s, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        (start, number), known = partition.value, Positions(self.uri)
        at = known.read(start, number) if number else {"round": 0, "page": 0, "offset": None}
        offset, page = at["offset"], at["page"]
        for row, offset in self.chain(start, page, offset, page + self.batch_pages):
            page = row[1] + 1
            yield row
        ended = {"round": at["round"] + 1, "page": 0, "offset": None, "not_before": time.time() + self.interval}
        known.write(start, number + 1, ended if offset is None else {"round": at["round"], "page": page, "offset": offset, "not_before": 0})

    def commit(self, end: dict) -> None:
        known = Positions(self.uri)
        for start, number in end.items():
            known.forget(start, number)


def posted(address: str, password: str, links: list[str], timeout: float, key: str | None = None) -> str:
    """What the receiver says of links; a refusal is an error. The receiver may know a request that it had before by its key."""
    headers = {"Content-Type": "application/json"} | ({"Idempotency-Key": key} if key else {})
    request = Request(address, json.dumps({"password": password, "links": links}).encode(), headers)
    with urlopen(request, timeout=timeout) as answer:
        said = json.loads(answer.read())
    if not said.get("success"):
        raise RuntimeError(f"submit failed: {said.get('message')}")
    return said.get("message") or "ok"


@dataclass
class Sent(WriterCommitMessage):
    links: int
    requests: int


class SubmitSink(DataSource):
    """`submit`: a stream's links (url) as requests of at most MOST_LINKS. Options: address, password, timeout, checks (a folder that gets a JSON document a batch: batch, links, requests, at).

    A request bears a key of its batch and its links, so that a receiver that knows keys takes what a task or a batch
    sends again after a failure once; sort the links of a partition, so that they are sent in the same requests.
    """

    @classmethod
    def name(cls) -> str:
        return "submit"

    def schema(self) -> str:
        return "url string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return SubmitWriter(self.options)


class SubmitWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.address, self.password, self.timeout, self.checks = options["address"], options.get("password", ""), float(options.get("timeout", 20)), options.get("checks")

    def write(self, iterator) -> Sent:
        task = TaskContext.get()
        batch = task.getLocalProperty("streaming.sql.batchId") if task else None
        query = task.getLocalProperty("sql.streaming.queryId") if task else None
        waiting, links, requests = [], 0, 0

        def send() -> None:
            nonlocal links, requests
            key = hashlib.sha256("\n".join([query or "", batch or "", *waiting]).encode()).hexdigest()
            posted(self.address, self.password, waiting, self.timeout, key)
            links, requests = links + len(waiting), requests + 1
            waiting.clear()

        for row in iterator:
            waiting.append(row[0])
            if len(waiting) == MOST_LINKS:
                send()
        if waiting:
            send()
        return Sent(links, requests)

    def commit(self, messages, batchId: int) -> None:
        if self.checks:
            sent = [m for m in messages if m]
            said = {"batch": batchId, "links": sum(m.links for m in sent), "requests": sum(m.requests for m in sent), "at": time.time()}
            Positions(self.checks).write("checks", batchId, said)


def submitted(links: DataFrame, address: str, password: str, timeout: float = 20) -> DataFrame:
    """n, message: posts url in requests of at most MOST_LINKS links, each partition its own; a refusal fails the task, so Spark tries it again.

    A request may be sent twice that way; the receiver drops links it has.
    """

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []

        def send(batch: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"n": [len(batch)], "message": [posted(address, password, batch, timeout)]})

        for frame in frames:
            waiting += frame["url"].tolist()
            while len(waiting) >= MOST_LINKS:
                yield send(waiting[:MOST_LINKS])
                del waiting[:MOST_LINKS]
        if waiting:
            yield send(waiting)

    return links.select("url").mapInPandas(post, "n long, message string")
