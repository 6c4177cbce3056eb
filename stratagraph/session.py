"""The serving surface: named actions over one scan's tables, batches with an error per action, and text presets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clinic, constraint, cycles, impact, mesh, primitives, render, retrieval
from .sources.store import Store


@dataclass
class Tables:
    """One scan. Tables that no action reads are never computed."""

    components: DataFrame
    edges: DataFrame
    symbols: DataFrame
    calls: DataFrame
    files: DataFrame | None = None
    commits: DataFrame | None = None
    interfaces: DataFrame | None = None
    impls: DataFrame | None = None
    layers: list[str] = field(default_factory=list)
    rules: list[tuple[str, str, bool]] = field(default_factory=list)
    limits: DataFrame | None = None
    roles: DataFrame | None = None
    accepted: DataFrame | None = None
    coverage: DataFrame | None = None


class Session:
    def __init__(self, spark: SparkSession, tables: Tables, store: Store | None = None, repo: str = "", sha: str = ""):
        self.spark, self.t, self.store, self.repo, self.sha = spark, tables, store, repo, sha
        self._roles: DataFrame | None = None
        self.actions: dict[str, Callable[..., DataFrame]] = {
            "hot_spots": lambda top_n=10, **_: retrieval.top_churn(self.t.components, int(top_n)),
            "deps": lambda component, **_: retrieval.dependencies(self.t.edges, component),
            "coupling": lambda sort_by="fan_in", top_n=20, **_: retrieval.coupling_table(self.t.components, self.t.edges, sort_by, int(top_n)),
            "cycles": lambda max_len=None, **_: cycles.elementary_cycles(self.t.edges, int(max_len) if max_len else None),
            "violations": lambda layers=None, **_: self._layers(layers),
            "callers": lambda symbol, **_: retrieval.callers(self.t.calls, symbol),
            "callees": lambda symbol, **_: retrieval.callees(self.t.calls, symbol),
            "call_path": lambda start, goal, **_: self._path(start, goal),
            "component": lambda component, **_: retrieval.component_detail(self.t.components, self.t.edges).where(F.col("component") == component),
            "search": lambda query, **_: retrieval.search_components(self.t.components, query),
            "symbol_search": lambda pattern, **_: retrieval.search_symbols(self.t.symbols, pattern),
            "risk_scores": lambda **_: impact.risk_scores(self.t.edges, self.t.components, self.t.coverage),
            "preset": lambda name, **_: self.preset(name),
            "impact": lambda component, **_: impact.impact(self.t.edges, self.t.components).where(F.col("component") == component),
            "symbol_graph": lambda **_: self.t.calls,
            "pipelines": lambda min_length=3, **_: self._pipelines(int(min_length)),
            "pattern_scan": lambda **_: clinic.pattern_scan(self.t.edges, accepted=self.t.accepted),
            "pattern_catalog": lambda filter="", **_: clinic.pattern_catalog(self.spark, filter),
            "hexa_validate": lambda **_: clinic.hexa_violations(self.t.edges, self.roles()),
            "solid_scan": lambda **_: self._solid()["violations"],
            "symbol_quality": lambda **_: clinic.symbol_quality(self.t.symbols),
            "vocab_map": lambda **_: clinic.vocabulary(self.t.symbols),
            "blast_radius": lambda files, **_: impact.blast_radius(self.t.edges, self.t.components, files),
            "import_direction": lambda **_: constraint.import_direction(self.t.edges),
            "trust_boundaries": lambda **_: self._zones(),
            "budgets": lambda **_: constraint.budgets(self.t.components, self.t.edges, self._need("limits")),
            "mod_dependencies": lambda **_: self._need("files"),
            "symbol_blast": lambda symbol, **_: impact.symbol_blast(self.t.calls, symbol)["transitive"],
            "interface_metrics": lambda **_: constraint.interface_metrics(self._need("interfaces"), self._need("impls"))["interfaces"],
            "leverage": lambda component, **_: impact.leverage(self.t.edges, self.t.components).where(F.col("component") == component),
            "api_surface": lambda **_: constraint.api_surface(self.t.components),
            "conventions": lambda **_: self._conventions(),
            "gaps": lambda **_: constraint.gaps(self._need("files")),
            "consolidate": lambda theta=0.7, **_: impact.cohesion_clusters(self.t.edges, float(theta)),
            "drift": lambda **_: constraint.drift(self.t.edges, self.t.components, self.t.layers, self.t.rules, self._need("limits")),
            "what_if": self._what_if,
            "diff_intelligence": lambda packages, **_: impact.diff_intelligence(self.t.symbols, self.t.calls, packages),
        }

    def _need(self, name: str) -> DataFrame:
        df = getattr(self.t, name)
        if df is None:
            raise ValueError(f"this scan has no table {name}")
        return df

    def _layers(self, layers: list[str] | None) -> DataFrame:
        from .operators.graph import layer_violations

        return layer_violations(self.t.edges, layers or self.t.layers)

    def _path(self, start: str, goal: str) -> DataFrame:
        path, hops = retrieval.call_path(self.t.calls, start, goal)
        return self.spark.createDataFrame([(path, hops)], "path array<string>, hops int")

    def _pipelines(self, min_length: int) -> DataFrame:
        from .operators.kernels import typed_pipelines

        return typed_pipelines(self.t.calls, min_length)

    def _what_if(self, moves: list[dict] | None = None, **_) -> DataFrame:
        if moves is None:
            raise ValueError("what_if needs its moves; it is no batch action")
        return impact.what_if(self.t.edges, self.t.components, moves)["edge_diff"]

    def _zones(self) -> DataFrame:
        zones = constraint.trust_zones(self.t.components, self.t.edges.select(F.col("src").alias("component"), F.col("dst").alias("target")), self.t.roles)
        return constraint.zone_crossings(self.t.edges, zones)

    def _conventions(self) -> DataFrame:
        from .sources.scanners import conventions

        return conventions(self._need("files"))

    def roles(self) -> DataFrame:
        """The desired roles over the classified ones."""
        if self._roles is None:
            base = self.t.components
            for c, v in (("has_main", False), ("n_interfaces", 0), ("n_types", 0), ("external", False)):
                base = base if c in base.columns else base.withColumn(c, F.lit(v))
            found = clinic.hexa_roles(base, self.t.edges)
            self._roles = found if self.t.roles is None else clinic.resolve_roles(found, self.t.roles)
        return self._roles

    def _solid(self) -> dict[str, DataFrame]:
        parts = [clinic.srp(self.t.components, self.t.edges, self.roles(), self.t.accepted), clinic.dip(self.t.edges, self.roles(), self.t.accepted)]
        if self.t.interfaces is not None:
            parts.append(clinic.isp(self.t.interfaces, self.t.accepted))
        return clinic.solid_scan(*parts)

    def run(self, action: str, **params) -> DataFrame:
        if action not in self.actions:
            raise ValueError(f"unknown action {action!r}; known: {', '.join(sorted(self.actions))}")
        return self.actions[action](**params)

    def batch(self, actions: list[tuple[str, dict]]) -> list[dict]:
        """[{action, result | error}]: an action that fails doesn't stop the others."""
        out = []
        for name, params in actions:
            try:
                if name == "what_if":
                    raise ValueError("what_if is no batch action")
                out.append({"action": name, "result": self.run(name, **params)})
            except Exception as e:  # noqa: BLE001
                out.append({"action": name, "error": str(e)})
        return out

    def answer(self, question: str) -> str:
        """The action that a question asks for."""
        return self.spark.range(1).select(retrieval.route(F.lit(question)).alias("a")).first()["a"]

    def save(self, intent: str = "") -> None:
        """Writes the scan; the key holds the intent on both sides."""
        if self.store is None:
            raise ValueError("no store")
        for name in ("components", "edges", "symbols", "calls"):
            self.store.put(name, self.repo, self.sha, getattr(self.t, name), intent)

    # -- primitives ---------------------------------------------------------------------------------------
    def probe(self, symbol: str) -> DataFrame:
        return primitives.probe(self.t.symbols, self.t.calls, symbol)

    def scenario(self, symbol: str, max_depth: int = 3, stress: bool = False, top_n: int | None = None):
        return primitives.scenario(self.t.symbols, self.t.calls, symbol, max_depth, stress, top_n)

    def convergence(self, symbols: list[str], top_n: int | None = None):
        return primitives.convergence(self.t.symbols, self.t.calls, symbols, top_n)

    def isolate(self, symbol: str) -> DataFrame:
        return primitives.isolate(self.t.symbols, self.t.calls, symbol)

    def islands(self) -> DataFrame:
        return primitives.islands(self.t.symbols, self.t.calls)

    def mesh(self) -> DataFrame:
        return mesh.mesh_nodes(mesh.ancestors(self.t.symbols, self.t.components))

    def diagnose(self, symbol: str, book_nodes: DataFrame, book_edges: DataFrame) -> dict:
        """Vitals and the knowledge-graph entries that fit them."""
        row = self.probe(symbol).first()
        if row is None:
            return {"vitals": None, "entries": None}
        words = primitives.diagnosis_keywords(row.asDict())
        return {"vitals": row.asDict(), "entries": retrieval.book_query(book_nodes, book_edges, " ".join(words), 1)["nodes"]}

    def diagram(self, kind: str, **more) -> DataFrame:
        base = {"components": self.t.components, "edges": self.t.edges, "calls": self.t.calls, "nodes": self.t.symbols}
        if kind in ("dependency", "c4", "tree", "layers", "zones", "dsm", "symbol_dsm", "coupling", "churn"):
            return render.render(kind, components=base["components"], edges=base["edges"], **more)
        if kind in ("sequence", "callgraph", "dataflow"):
            return render.render(kind, calls=base["calls"], nodes=base["nodes"], **more)
        if kind == "hexa":
            return render.render(kind, roles=self.roles(), violations=clinic.hexa_violations(self.t.edges, self.roles()))
        return render.render(kind, **more)

    # -- presets ------------------------------------------------------------------------------------------
    #: What each text report is made of.
    PRESETS = {
        "architecture_review": ("coupling", "cycles", "violations"),
        "health_check": ("hot_spots", "risk_scores"),
        "onboarding": ("api_surface", "coupling"),
        "pre_pr": ("violations", "cycles", "hot_spots"),
        "normative": ("hexa_validate", "solid_scan"),
        "pre_refactor": ("risk_scores", "consolidate", "coupling"),
        "full_clinic": ("pattern_scan", "hexa_validate", "solid_scan", "symbol_quality"),
        "code_health": ("hot_spots", "symbol_quality", "vocab_map"),
    }

    def preset(self, name: str) -> DataFrame:
        """(section, text): a table of all of each section's rows."""
        if name not in self.PRESETS:
            raise ValueError(f"unknown preset {name!r}; known: {', '.join(self.PRESETS)}")
        out = None
        for section in self.PRESETS[name]:
            df = self.run(section)
            plain = df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
            text = render.markdown_table(plain, plain.columns, list(plain.columns)).select(F.lit(section).alias("section"), "text")
            out = text if out is None else out.union(text)
        return out
