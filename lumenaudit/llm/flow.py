"""Minimum-cost flow on small networks."""

from __future__ import annotations

from collections import deque


class Network:
    """Directed arcs with capacity and cost; successive shortest augmenting paths."""

    def __init__(self) -> None:
        self.head: dict[object, list[int]] = {}
        self.to: list[object] = []
        self.cap: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: object, b: object, cap: int, cost: float = 0.0) -> int:
        """Adds an arc and gives its number."""
        n = len(self.to)
        for node, end, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.head.setdefault(node, []).append(len(self.to))
            self.head.setdefault(end, [])
            self.to.append(end)
            self.cap.append(c)
            self.cost.append(w)
        return n

    def flow(self, arc: int) -> int:
        return self.cap[arc ^ 1]

    def send(self, source: object, sink: object) -> tuple[int, float]:
        """(amount, cost) of a maximum flow of least cost. Costs must allow no negative cycle."""
        amount, total = 0, 0.0
        while True:
            dist, via, queue, waiting = {source: 0.0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.head.get(a, []):
                    if self.cap[e] > 0 and dist[a] + self.cost[e] < dist.get(self.to[e], float("inf")) - 1e-9:
                        dist[self.to[e]] = dist[a] + self.cost[e]
                        via[self.to[e]] = e
                        if self.to[e] not in waiting:
                            waiting.add(self.to[e])
                            queue.append(self.to[e])
            if sink not in via:
                return amount, total
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            step = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= step
                self.cap[e ^ 1] += step
            amount += step
            total += step * dist[sink]
