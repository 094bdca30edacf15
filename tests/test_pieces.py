"""Sessions walked in pieces give the rows of one walk, in far fewer steps."""

import numpy as np
import pyarrow as pa
import pytest

from trackloom.operators.tracking.blocks import BlockRunner
from trackloom.operators.tracking.job import SESSION
from trackloom.operators.tracking.rectangles import RectangleConfig, RectangleTracker
from trackloom.operators.tracking.tracker import DET, LABELS, Tracker, TrackerConfig


def scene(frames: int, still: bool = False) -> pa.Table:
    """One session: boxes that jump among places, or ``still`` ones beside them that are never lost."""
    rng, rows = np.random.default_rng(3), []
    for f in range(frames):
        for i in range(3):
            fixed = still and i == 0
            x, y = (0.5, 0.5) if fixed else 0.1 * rng.integers(0, 6, 2)
            rows.append((f, i, 0.9 if fixed else float(rng.uniform(0.3, 0.9)), x, y, x + 0.2, y + 0.3, "rectangle" if i == 2 else "person"))
    cols = list(zip(*rows))
    n = len(rows)
    return pa.table({"slot_id": pa.array(np.zeros(n, np.int32)), "grp": [""] * n, "session": pa.array(np.zeros(n, np.int64)),
                     "frame_id": pa.array(np.array(cols[0])), "ord": pa.array(np.array(cols[0]) + 1), "is_inf": [True] * n,
                     "kind": pa.array(np.full(n, DET, np.int32)), "det_idx": pa.array(np.array(cols[1], np.int32)),
                     "confidence": list(cols[2]), "x1": list(cols[3]), "y1": list(cols[4]), "x2": list(cols[5]), "y2": list(cols[6]), "label": list(cols[7])})


def walk(engine, table: pa.Table, pieces: bool, cuts=()):
    engine.pieces, steps, plain = pieces, [0], engine.step

    def counted(*args):
        steps[0] += 1
        return plain(*args)

    engine.step = counted
    runner, out = BlockRunner(engine, SESSION, LABELS), []
    bounds = [0, *cuts, table.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        out += list(runner.feed(table.slice(a, b - a)))
    rows = pa.Table.from_batches(out).sort_by([(c, "ascending") for c in ("frame_id", "birth_frame", "birth_det")])
    return rows, steps[0]


@pytest.mark.parametrize("name", ["hungarian", "greedy", "auto", "rectangles"])
@pytest.mark.parametrize("still", [False, True])
def test_pieces_give_the_rows_of_one_walk(name, still):
    configs = {"greedy": {"strategy": "greedy"}, "auto": {"filter": "auto"}}
    def engine():
        if name == "rectangles":
            return RectangleTracker(RectangleConfig(), False)
        return Tracker(TrackerConfig(**configs.get(name, {})), (), SESSION)

    table = scene(1500, still)
    one, _ = walk(engine(), table, False)
    for cuts in ((), (1200, 3300)):
        cut, _ = walk(engine(), table, True, cuts)
        assert cut.equals(one)


@pytest.mark.parametrize("kind", ["ukf", "auto"])
def test_a_long_session_takes_few_steps(kind):
    """Every numpy step costs the same for one piece as for hundreds; before, a session took a step a frame."""
    _, steps = walk(Tracker(TrackerConfig(filter=kind), (), SESSION), scene(6000), True)
    assert steps < 2000
