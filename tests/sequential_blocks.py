"""The sequential plan of balanced blocks, for comparison."""

from voxlake.operators.blocks import SLACK
from voxlake.operators.folds import Fold


class Forward(Fold):
    """Cheapest tiling up to every segment; output is (position, position before the block that ends there)."""

    def __init__(self, target: float, min_len: float, max_len: float):
        self.target, self.min_len, self.max_len = target, min_len, max_len

    def start(self, key):
        # Open boundaries, nearest first: [segments before it, seconds of the segment before it, cost up to it].
        return {"n": 0, "open": [[0, 0.0, 0.0]]}

    def step(self, state, key, row):
        seconds = float(row[0])
        state["n"] += 1
        length, best, source, reach = 0.0, float("inf"), -1, 0
        later = seconds
        for at, before, cost in state["open"]:
            length += later
            if length > self.max_len + SLACK:
                break
            reach += 1
            deviation = length - self.target
            if length + SLACK >= self.min_len and cost + deviation * deviation < best:
                best, source = cost + deviation * deviation, at
            later = before
        # Boundaries beyond the longest block cannot be reached from later segments either.
        state["open"] = [[state["n"], seconds, best], *state["open"][:reach]]
        return state, [(state["n"], source)]


class Backward(Fold):
    """Follows the pointers from the last segment; output is (first position, last position) of each block."""

    def start(self, key):
        return None

    def step(self, state, key, row):
        position, source = int(row[0]), int(row[1])
        if state is not None and position != state:
            return state, ()
        if source < 0:
            # Only the last segment can lack a pointer on the path: then there is no tiling at all.
            return -1, ()
        return source, [(source + 1, position)]
