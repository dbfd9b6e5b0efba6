"""Calls of a JSON-RPC tool server, one per key, from the tasks that hold the keys."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame

#: Version, method and header names are the public protocol's (fixed values).
PROTOCOL = "2025-03-26"


class Session:
    """One session with the server: handshake first, then numbered calls, each sent again after a failure."""

    def __init__(self, url: str, retries: int = 2, backoff: float = 1.0, timeout: float = 15.0):
        if not url.startswith(("http://", "https://")):
            raise ValueError(f"not an HTTP address: {url}")
        self.url, self.retries, self.backoff, self.timeout = url, retries, backoff, timeout
        self.ids, self.session = itertools.count(1), None
        hello = {"protocolVersion": PROTOCOL, "capabilities": {}, "clientInfo": {"name": "sparkloom", "version": "1"}}
        headers, _ = self._post({"jsonrpc": "2.0", "id": next(self.ids), "method": "initialize", "params": hello})
        self.session = headers.get("Mcp-Session-Id")
        if not self.session:
            raise RuntimeError("the server gave no session")
        self._post({"jsonrpc": "2.0", "method": "notifications/initialized"})

    def _post(self, message: dict) -> tuple[object, str]:
        headers = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"}
        if self.session:
            headers["Mcp-Session-Id"] = self.session
        for left in range(self.retries, -1, -1):
            try:
                with urlopen(Request(self.url, json.dumps(message).encode(), headers), timeout=self.timeout) as reply:
                    return reply.headers, reply.read().decode()
            except OSError as e:  # refused, timed out, or a status of 400 and more
                if not left:
                    raise RuntimeError(f"request failed: {e}") from e
                time.sleep(self.backoff)
        raise AssertionError

    def call(self, tool: str, arguments: dict) -> str:
        """Body of the reply to one call."""
        return self._post({"jsonrpc": "2.0", "id": next(self.ids), "method": "tools/call", "params": {"name": tool, "arguments": arguments}})[1]


def call_each(keys: DataFrame, key: str, url: str, tool: str, argument: str, retries: int = 2, backoff: float = 1.0, timeout: float = 15.0) -> DataFrame:
    """key (string), body: one call for each row of ``keys``, with one session per task.

    A task that runs again calls again, so this is for tools that only read; land the
    result before it is used twice. ``decode.unwrap_reply`` reads the bodies and tells
    errors in them. No keys: no session, no rows. A null key is passed as null.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = None
        for batch in batches:
            values = [None if v is None or v != v else v for v in batch[key]]
            if values:
                session = session or Session(url, retries, backoff, timeout)
                yield pd.DataFrame({key: values, "body": [session.call(tool, {argument: v}) for v in values]}, dtype=object)

    return keys.select(keys[key].cast("string").alias(key)).mapInPandas(work, f"`{key}` string, body string")
