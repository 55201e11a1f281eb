"""Eight calls over a stored index, by name, each answered in an envelope as JSON."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import drift, neighborhood, queries
from ..operators.graph import FORWARD, CallGraph
from ..sources.index import read_index

#: Most candidates that a name with several matches lists for calls without a limit of their own.
CANDIDATES = 200


class Service:
    """An index, loaded once; sources are compared with its manifest before each answer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        symbols, edges, self.manifest = read_index(spark, root)
        self.graph = CallGraph(symbols.persist(), edges)

    def _told(self, answer):
        envelope = answer.envelope()
        answer.release()
        return envelope

    def _sent(self, envelope) -> str:
        return envelope.with_stale(drift.diverged_files(self.spark, self.manifest, self.root)).to_json()

    def find(self, name: str, limit: int = queries.LIMIT):
        """(id, None), or (None, candidates): a known number, else an exact path, else a fragment.

        Whether a fragment is unique is decided by its total, not by the limited list.
        """
        digits = name.removeprefix("+")
        if digits.isascii() and digits.isdigit() and int(digits) < 1 << 64:
            row = self.graph.symbols.filter(F.col("id") == F.lit(digits).cast("decimal(20,0)")).select("id").first()
            if row:
                return row["id"], None
        row = self.graph.symbols.filter(F.col("fq_path") == name).select("id").first()
        if row:
            return row["id"], None
        found = queries.resolve(self.graph, name, max(limit, 1)).envelope()
        if found.total == 1:
            return found.data[0]["id"], None
        return None, found.remap(found.data[:limit]).with_truncated(found.total > limit)

    def _about(self, name, limit, ask):
        symbol, candidates = self.find(name, limit)
        return self._sent(candidates if candidates is not None else self._told(ask(symbol)))

    def resolve_symbol(self, query: str, limit: int = queries.LIMIT) -> str:
        return self._sent(queries.resolve(self.graph, query, limit).envelope())

    def direct_calls(self, symbol: str, limit: int = queries.LIMIT) -> str:
        return self._about(symbol, limit, lambda s: queries.direct_calls(self.graph, s, limit))

    def reachability(self, symbol: str, direction: str = FORWARD, limit: int = queries.LIMIT) -> str:
        return self._about(symbol, limit, lambda s: queries.reachability(self.graph, s, direction, limit))

    def call_paths(self, source: str, target: str, max_depth: int = queries.MAX_DEPTH, max_paths: int = queries.MAX_PATHS) -> str:
        first, candidates = self.find(source, CANDIDATES)
        if candidates is None:
            last, candidates = self.find(target, CANDIDATES)
        if candidates is not None:
            return self._sent(candidates)
        found = self._told(queries.call_paths(self.graph, first, last, max_depth, max_paths))
        ids = {i for row in found.data for i in row["path"]}
        known = {r["id"]: r.asDict(recursive=True) for r in self.graph.symbols.filter(F.col("id").isin(list(ids))).collect()} if ids else {}
        return self._sent(found.remap([{"nodes": [known[i] for i in row["path"]]} for row in found.data]))

    def affected_tests(self, symbol: str, limit: int = queries.LIMIT) -> str:
        return self._about(symbol, limit, lambda s: queries.affected_tests(self.graph, s, limit))

    def reachable_unsafe(self, symbol: str, limit: int = queries.LIMIT) -> str:
        return self._about(symbol, limit, lambda s: queries.reachable_unsafe(self.graph, s, limit))

    def impact(self, symbol: str, limit: int = queries.LIMIT) -> str:
        return self._about(symbol, limit, lambda s: queries.impact(self.graph, s, limit))

    def neighborhood_graph(self, symbol: str, depth: int = queries.RADIUS, node_limit: int = queries.NODE_LIMIT) -> str:
        focus, candidates = self.find(symbol, CANDIDATES)
        if candidates is not None:
            return self._sent(candidates)
        found = neighborhood.neighborhood(self.graph, focus, depth, node_limit).envelope()
        return self._sent(found.remap(found.data[0]["text"]))
