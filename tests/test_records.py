import numpy as np

from larkspur.operators import kalman
from larkspur.sources import records


def _matrix_filter(seen, last):
    """The same model with whole matrices, a frame at a time."""
    move = np.kron(np.array([[1.0, 1.0], [0.0, 1.0]]), np.eye(4))
    look = np.hstack([np.eye(4), np.zeros((4, 4))])
    drift, blur = np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001, 0.0001]), np.diag([1.0, 1, 10, 10])
    state, cov, out = None, np.diag([10.0] * 4 + [1e4] * 4), {}
    for frame in range(last + 1):
        if state is not None:
            state, cov = move @ state, move @ cov @ move.T + drift
        if frame in seen:
            z = np.array(seen[frame], float)
            if state is None:
                state = np.append(z, np.zeros(4))
            else:
                gain = cov @ look.T @ np.linalg.inv(look @ cov @ look.T + blur)
                state, cov = state + gain @ (z - look @ state), (np.eye(8) - gain @ look) @ cov
            out[frame] = state[:4].copy()
    return out


def test_box_filter_against_matrices(spark):
    boxes = {0: (0, 0, 10, 20), 1: (2, 1, 12, 22), 5: (9, 4, 21, 25), 6: (11, 5, 22, 25), 40: (70, 30, 85, 52)}
    rows = [(1, 1, f, *b) for f, b in boxes.items()] + [(1, 2, 3, 0, 0, 4, 4), (1, 2, None, 0, 0, 4, 4), (1, 2, 4, None, 0, 4, 4)]
    d = spark.createDataFrame(rows, "video_id long, obj_id long, frame_idx long, x1 long, y1 long, x2 long, y2 long")
    got = {(r.obj_id, r.frame_idx): r.filtered for r in kalman.filtered_boxes(d).collect()}
    centred = {f: ((a + c) / 2, (b + e) / 2, c - a, e - b) for f, (a, b, c, e) in boxes.items()}
    assert set(got) == {(1, f) for f in boxes} | {(2, 3)}
    assert got[2, 3] == [0, 0, 4, 4]
    for f, (x, y, w, h) in _matrix_filter(centred, 40).items():
        np.testing.assert_allclose(got[1, f], [x - w / 2, y - h / 2, x + w / 2, y + h / 2], rtol=1e-9)


def test_proposals_round_trip(spark):
    rows = [(1, 5, 2, 0, 0, 4, 4, 7), (1, 5, 1, 1, 1, 3, 3, None), (2, 5, 1, 1, 1, 3, 3, 0)]
    tracks = spark.createDataFrame(rows, "video_id long, frame_idx long, obj_id long, x1 long, y1 long, x2 long, y2 long, gid long")
    texts = records.proposals(tracks)
    assert texts.count() == 2
    assert sorted(map(tuple, records.operator_ids(texts).collect()), key=str) == sorted([(1, 5, 2, 7), (1, 5, 1, None), (2, 5, 1, 0)], key=str)
    assert records.proposals(tracks.limit(0)).collect() == []


def test_log_is_written_by_kind(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 0.5)], "frame_idx long, score double"), spark.createDataFrame([(2, 3)], "frame_idx long, gid long")
    log = records.telemetry(gate=a, rebind=b)
    records.write_log(log, None)
    records.write_log(log, str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert {(r.kind, r.frame_idx, r.score, r.gid) for r in back.collect()} == {("gate", 1, 0.5, None), ("rebind", 2, None, 3)}
