"""The same identity resolver on a stream, with its state kept for each video."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.resolver import OUT, Params, Resolver, gallery_arrays

_COLUMNS = [f.split()[0] for f in OUT.split(", ")]


def resolve_stream(rows: DataFrame, gallery: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows as in ``resolve``, with frames of a video arriving in order; a frame lies in one micro-batch as a whole.

    A frame older than the last one its video has had is late: it is not resolved and comes out with gid null.
    """
    gids, centroids = gallery_arrays(gallery)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, last = pickle.loads(state.get[0]) if state.exists else (Resolver(gids, centroids, p), None)
        got = pd.concat(list(parts)).sort_values(["chunk_id", "frame_idx", "obj_id"])
        out = []
        for at, frame in got.groupby(["chunk_id", "frame_idx"], sort=True):
            rows = [{k: None if v is None or (isinstance(v, float) and v != v) else v for k, v in r.items()} for r in frame.to_dict("records")]
            if last is not None and at < last:
                out += [{c: r.get(c) for c in _COLUMNS} | {"gid": None, "demoted": False} for r in rows]
                continue
            out += machine(rows)
            last = at
        state.update((pickle.dumps((machine, last)),))
        frame = pd.DataFrame(out, columns=_COLUMNS)
        yield frame.astype({"gid": "Int64"})

    return rows.groupBy("video_id").applyInPandasWithState(step, OUT, "state binary", "append", GroupStateTimeout.NoTimeout)
