"""A page cache over a stream of requests, its state kept by the engine (an extension of the batch replay)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.traces import POLICIES


def cache_stream(requests: DataFrame, policy: str = "LRU", slots: int = 16) -> DataFrame:
    """Running hits and faults by pe_id of a stream (pe_id, rw_order, op_type, page_id); each batch is taken in order."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = pickle.loads(state.get[0]) if state.exists else POLICIES[policy](slots)
        for pdf in sorted(frames, key=lambda f: f["rw_order"].min()):
            for p, op in zip(*[pdf.sort_values("rw_order")[c] for c in ("page_id", "op_type")]):
                cache.request(int(p), op == "WRITE")
        state.update((pickle.dumps(cache),))
        yield pd.DataFrame({"pe_id": [key[0]], "hits": [cache.hits], "faults": [cache.faults]})

    return requests.groupBy("pe_id").applyInPandasWithState(step, "pe_id int, hits long, faults long", "cache binary", "update", GroupStateTimeout.NoTimeout)
