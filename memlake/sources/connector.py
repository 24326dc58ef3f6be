"""A polling connector as a streaming source.

    spark.dataSource.register(PollingSource)
    spark.readStream.format("memlake_poll").option("command", "python feed.py").load()

The command gets the cursor as its last argument and prints {"items": [{"id":
..., "payload": ...}], "cursor": "..."}.  The stream's offset is the cursor; the
first poll only seeds it, so what was there before fires nothing.
"""

from __future__ import annotations

import json
import shlex
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

TIMEOUT_S = 60


def poll(command: str, cursor: str | None, timeout: float = TIMEOUT_S) -> tuple[list[tuple[str, str]], str]:
    done = subprocess.run([*shlex.split(command), cursor or ""], capture_output=True, text=True, timeout=timeout, check=True)
    got = json.loads(done.stdout)
    items = [(str(x["id"]), json.dumps(x.get("payload"))) for x in got.get("items", [])]
    return items, str(got.get("cursor", cursor or ""))


class PollingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "memlake_poll"

    def schema(self) -> str:
        return "id string, payload string"

    def simpleStreamReader(self, schema) -> PollingReader:
        return PollingReader(self.options["command"])


class PollingReader(SimpleDataSourceStreamReader):
    def __init__(self, command: str):
        self.command = command

    def initialOffset(self) -> dict:
        _, cursor = poll(self.command, None)
        return {"cursor": cursor}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        items, cursor = poll(self.command, start["cursor"])
        return iter(items), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        items, _ = poll(self.command, start["cursor"])
        return iter(items)
