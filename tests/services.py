"""Services for tests; tasks import them by name."""

import os

import pyarrow as pa

from marginalia.sources import sink


class Tree:
    """Blocks named by their path: ``r`` has 250 children, the hundredth and two hundredth 3, and those one each; ``even`` has exactly 200.
    The first child of both says that it has children, and has none."""

    SIZES = {"r": 250, "even": 200, "none": 0}

    def children(self, parent, cursor, size):
        depth = parent.count(".")
        n = self.SIZES.get(parent, 0) if depth == 0 else 3 if depth == 1 and parent.endswith("00") else 1 if depth == 2 else 0
        at = cursor or 0
        here = range(at, min(n, at + size))
        names = [f"{parent}.{i}" for i in here]
        more = [depth == 0 and i % 100 == 0 or depth == 1 for i in here]
        page = pa.table({"block_id": pa.array(names, pa.string()), "parent_id": pa.array([parent] * len(names), pa.string()), "type": pa.array(["toggle"] * len(names), pa.string()), "text": pa.array([None] * len(names), pa.string()), "has_children": pa.array(more, pa.bool_()), "pos": pa.array(list(here), pa.int64())})
        return page, at + size if at + size < n else None


class Loop:
    """A block within itself."""

    def children(self, parent, cursor, size):
        return pa.table({"block_id": ["x"], "parent_id": [parent], "type": ["toggle"], "text": ["t"], "has_children": [True], "pos": pa.array([0], pa.int64())}), None


class Databases:
    """Three databases of 130 pages each; refuses to be asked about the one called closed."""

    def __init__(self, path):
        self.path = path

    def databases(self):
        return ["a", "b", "closed"]

    def query(self, database_id, wanted, cursor, size):
        if database_id == "closed":
            raise ValueError("asked about closed")
        with open(f"{self.path}/asked-{os.getpid()}-{cursor}-{database_id}", "w") as out:
            out.write(repr(sorted(wanted.items())))
        ids = [i for i in range(130) if wanted.get("tag") in (None, f"t{i % 2}") and wanted.get("title") in (None, f"T{i % 3}")]
        at = cursor or 0
        here = ids[at : at + size]
        page = pa.table({"database_id": [database_id] * len(here), "page_id": [f"{database_id}{i}" for i in here], "title": [f"T{i % 3}" for i in here], "tag": [f"t{i % 2}" for i in here], "archived": [False] * len(here)})
        return page, at + size if at + size < len(ids) else None


class Flaky(sink.Outbox):
    """Refuses each request once, and breaks off in the middle of one if a file ``broken`` lies beside the outbox."""

    def send(self, request_id, kind, body):
        once = f"{self._root}-refused-{request_id}"
        if kind == "refuse" and not os.path.exists(once):
            open(once, "w").close()
            raise sink.Refused
        if kind == "always":
            raise sink.Refused
        if kind == "break" and os.path.exists(f"{self._root}-broken"):
            raise OSError("the line went dead")
        return super().send(request_id, kind, body)
