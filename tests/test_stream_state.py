"""State of streams that handle rows in order: each row is written and read a few times, however long the time of a batch."""

import numpy as np
import pandas as pd
import pytest

from fieldlens.streaming import operators as X


class States:
    """Stands for Spark's handle: states are dictionaries that count what is written."""

    def __init__(self):
        self.all, self.writes, self.largest = {}, 0, 0

    def getMapState(self, name, key, value):  # noqa: N802
        states, own = self, self.all.setdefault(name, {})

        class Map:
            def updateValue(self, k, v):  # noqa: N802
                own[k] = v
                states.writes += 1

            def getValue(self, k):  # noqa: N802
                return own.get(k)

            def removeKey(self, k):  # noqa: N802
                del own[k]

            def iterator(self):
                return iter(list(own.items()))

        return Map()

    def getValueState(self, name, schema):  # noqa: N802
        own = self.all.setdefault(name, {})

        class Value:
            get = lambda self: own.get("v")
            update = lambda self, v: own.update(v=v)
            clear = lambda self: own.clear()

        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.all["timer"] = {at: 1}

    def deleteTimer(self, at):  # noqa: N802
        del self.all["timer"][at]


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


class Plain(X.InOrder):
    """Gives rows as they come to be handled, and in the order of handling which ones together."""

    columns, output = (("frame", "long"), ("id", "long"), ("v", "double")), "key long, frame long, id long, v double"
    rows_held, most_stretches, stretch_ms, finer = 200, 8, 1000, 4

    def own_states(self, handle):
        self.held = []

    def forget(self):
        self.held.append("forget")

    def handle(self, rows):
        self.held.append((int(rows["at"][0]), len(rows)))
        return [r[:3] for r in rows.tolist()]


def frames_of(rows, size=50):
    for k in range(0, len(rows), size):
        own = rows[k : k + size]
        yield pd.DataFrame({"frame": own[:, 0], "id": own[:, 1], "v": own[:, 1] / 4, "whole": True, "ts": pd.to_datetime(own[:, 2], unit="ms")})


def started():
    processor, states = Plain(10**12), States()
    processor.init(states)
    return processor, states


@pytest.mark.parametrize("n", [1000, 8000])
def test_writes_grow_as_rows(n):
    rng = np.random.default_rng(n)
    rows = np.array([(k // 5, 2**60 + k, 10**12 + k // 5 * 300) for k in range(n)])
    processor, states = started()
    list(processor.handleInputRows((3,), frames_of(rng.permutation(rows)), Now(0)))
    assert states.all["timer"] == {10**12: 1}
    got = pd.concat(processor.handleExpiredTimer((3,), Now(10**13), None))
    assert [tuple(r) for r in got.itertuples(index=False)] == [(3, f, i, i / 4) for f, i, _ in rows.tolist()]
    assert all(a[0] < b[0] for a, b in zip(processor.held, processor.held[1:])) and max(k for _, k in processor.held) <= 600
    assert states.writes < 0.5 * n and not states.all["parts"] and not states.all["counts"]


def test_in_order_over_many_times():
    """Batches at random, timers at random times and of dense and sparse stretches: all rows in order, a frame's together."""
    rng = np.random.default_rng(5)
    at = 10**12 + np.cumsum(rng.choice([0, 1, 40, 9000, 10**6], 3000, p=[0.5, 0.2, 0.2, 0.09, 0.01]))
    at[1000:2000] = at[1000] + np.arange(1000) // 4
    at[2000:] += max(0, at[1999] - at[2000]) + 1
    frame = np.cumsum(np.diff(at, prepend=at[0]) > 0)
    rows = np.column_stack([frame, np.arange(3000), at])
    place, rows = np.argsort(rng.integers(0, 400, 3000) + np.arange(3000)), rows
    processor, states = started()
    out = []
    for k in range(0, 3000, 300):
        list(processor.handleInputRows((3,), frames_of(rows[place[k : k + 300]]), Now(0)))
        left = place[k + 300 :]
        now = int(at[left.min()]) - 1 if len(left) else 10**15
        if next(iter(states.all["timer"])) <= now:
            out += list(processor.handleExpiredTimer((3,), Now(now), None))
            waiting = at[np.setdiff1d(place[: k + 300], pd.concat(out)["id"] if out else [])]
            assert (waiting > now).all() and next(iter(states.all["timer"])) == (waiting.min() if len(waiting) else at.max() + 10**12 + 1)
    got = pd.concat(out)
    assert got["id"].tolist() == list(range(3000))
    assert "forget" not in processor.held
    assert len({t for t, _ in processor.held}) == len(processor.held)
