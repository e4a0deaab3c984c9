"""An optional caller for requests that no recorded response answers. Off by default: no query uses it."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docscope.sources.tables import RESPONSES

#: Seconds before the second, third, ... try, each varied by a quarter either way. Fixed values of the contract.
PAUSES = (5.0, 20.0, 60.0)
UNAVAILABLE = (402, 403, 404)

#: Takes a payload, returns (body, error, status); it must not raise.
Post = Callable[[str], tuple[str | None, str | None, int | None]]


def pause(attempt: int, rng: random.Random) -> float:
    return PAUSES[min(attempt, len(PAUSES) - 1)] * rng.uniform(0.75, 1.25)


def call(post: Post, payload: str, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> tuple[str, bool, float]:
    """(body, is_failure, seconds) of one request. An unavailable model is not tried again; what is given up is recorded."""
    rng = rng or random.Random()
    began = time.monotonic()
    error = ""
    for attempt in range(len(PAUSES) + 1):
        if attempt:
            sleep(pause(attempt - 1, rng))
        body, error, status = post(payload)
        if body is not None:
            return body, False, time.monotonic() - began
        if status in UNAVAILABLE:
            break
    record = {"_failure": True, "error": {"message": error, "code": status}, "attempts": attempt + 1}
    return json.dumps(record), True, time.monotonic() - began


def call_missing(requests: DataFrame, post: Post) -> DataFrame:
    """Responses for ``requests (arm, request_key, payload)``, in the response table's schema, a partition at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [call(post, p) for p in frame["payload"]]
            yield pd.DataFrame({"arm": frame["arm"], "request_key": frame["request_key"], "body": [r[0] for r in rows], "is_failure": [r[1] for r in rows], "latency_s": [r[2] for r in rows]})

    return requests.select("arm", "request_key", "payload").mapInPandas(run, RESPONSES)
