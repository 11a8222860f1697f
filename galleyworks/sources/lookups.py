"""Lookups over the network with limits: each host is asked by one task, at its pace, with a deadline for each answer."""

from __future__ import annotations

import time
from collections import defaultdict, deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Semaphore
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that an answer may take, of a page and of a check of an address, and between two requests to a host.
PAGE_SECONDS, CHECK_SECONDS, PACE = 20.0, 5.0, 2.0
#: Rows of which a task holds the answers at once.
WINDOW = 256


def answer(url: str | None, headers: dict[str, str], seconds: float) -> tuple[str | None, str | None]:
    """(body, error) of a GET; the error names what went wrong. The deadline holds for the whole answer, also one that comes in drops."""
    deadline = time.monotonic() + seconds
    try:
        with urlopen(Request(url or "", headers=headers), timeout=seconds) as response:
            pieces = []
            while piece := response.read1(1 << 16):
                pieces.append(piece)
                if time.monotonic() > deadline:
                    raise TimeoutError
            return b"".join(pieces).decode(response.headers.get_content_charset() or "utf-8", "replace"), None
    except Exception as e:  # noqa: BLE001, whatever fails is the row's error
        return None, type(e).__name__


class _Pacer:
    """Order and times of a task's requests: the host whose turn comes first goes next, `pace` seconds after its request before, and not before one of `at_once` requests is free, so that none waits on its way and bunches with the next."""

    def __init__(self, pace: float, at_once: int):
        self.pace, self.turn, self.free = pace, defaultdict(float), Semaphore(at_once)

    def ordered(self, rows: list[tuple[str, str | None]]) -> Iterator[int]:
        """Places of (host, url) rows, each given when it may be asked."""
        waiting = defaultdict(deque)
        for i, (host, _) in enumerate(rows):
            waiting[host].append(i)
        while waiting:
            self.free.acquire()
            host = min(waiting, key=lambda h: self.turn[h])
            time.sleep(max(0.0, self.turn[host] - time.monotonic()))
            self.turn[host] = time.monotonic() + self.pace
            yield waiting[host].popleft()
            if not waiting[host]:
                del waiting[host]


def answers(requests: DataFrame, key: str, url: Column, headers: dict[str, str] | None = None, pace: float = PACE, seconds: float = PAGE_SECONDS, at_once: int = 8, body: str = "body") -> DataFrame:
    """key, body, error: the answer to each distinct (key, url) of the requests; a failure is an error row of its own, never an exception.

    All rows of a host go to one task, since its pace must be kept there; a task asks several hosts, `at_once` requests under way, and holds WINDOW answers.
    A host with a third of all rows takes as long as its pace demands, whatever the number of machines; its rows stream through. Rows without a url or with one that has no host are errors without
    a request, dealt by their key. A task that runs again asks again: requests are reads. An empty table gives an empty one.
    """
    sent = dict(headers or {})
    host = F.nullif(F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = requests.select(F.col(key).alias(key), url.alias("_url"), host.alias("_host")).distinct()
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.repartition(F.coalesce("_host", F.col(key).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = _Pacer(pace, at_once)
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, WINDOW):
                    part = batch.slice(at, WINDOW)
                    asked = list(zip(part.column("_host").to_pylist(), part.column("_url").to_pylist(), strict=True))
                    places = [i for i, (h, _) in enumerate(asked) if h is not None]
                    under_way = {}
                    for i in pacer.ordered([asked[i] for i in places]):
                        under_way[places[i]] = pool.submit(answer, asked[places[i]][1], sent, seconds)
                        under_way[places[i]].add_done_callback(lambda _: pacer.free.release())
                    found = [under_way[i].result() if i in under_way else (None, "ValueError") for i in range(part.num_rows)]
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array([b for b, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=[key, body, "error"])

    return rows.mapInArrow(run, f"`{key}` {kind}, `{body}` string, error string")
